"""Best-fit packing of token sequences, after Martello-Toth dominance reduction of the sizes."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE, ROW, gapless, materialize, text_groups, with_row_key
from .tokens import END, GROUP_CHARS, encoder

Bins = list[tuple[int, tuple[int, ...]]]


def _sums(sizes: list[int], capacity: int) -> int:
    """Bit mask of what two or more of the sizes, each as often as liked, add up to."""
    every, full = 1, (1 << (capacity + 1)) - 1
    for a in sizes:
        step = a
        while step <= capacity:
            every |= every << step & full
            step *= 2
    out = 0
    for a in sizes:
        out |= ((every ^ 1) << a) & full
    return out


def reduce_dominated(count: np.ndarray, capacity: int) -> Bins:
    """Takes from count (by size) the sets that some best packing holds; (number of bins, sizes) of each.

    For a size s, largest first, with t the largest other item that fits beside it: {s, t} dominates every other bin
    with s if no two or more items that fit beside s add up to more than t (so whatever stands beside s can change
    places with t). {s} dominates if nothing fits beside it. Repeats until nothing more can be fixed.
    """
    fixed: Bins = []
    sums, known = 0, None
    again = True
    while again:
        again = False
        for s in range(capacity, 0, -1):
            while count[s]:
                count[s] -= 1
                rest = np.flatnonzero(count[: capacity - s + 1])
                count[s] += 1
                if not len(rest):
                    fixed.append((int(count[s]), (s,)))
                    count[s] = 0
                    again = True
                    break
                t = int(rest[-1])
                if t < capacity - s and 2 * int(rest[0]) <= capacity - s:
                    sizes = tuple(np.flatnonzero(count).tolist())
                    if sizes != known:
                        sums, known = _sums(list(sizes), capacity), sizes
                    if sums >> (t + 1) & ((1 << (capacity - s - t)) - 1):
                        break
                n = int(count[s] // 2 if s == t else min(count[s], count[t]))
                fixed.append((n, (s, t)))
                count[s] -= n
                count[t] -= n
                again = True
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> Bins:
    """Best-fit decreasing by size, bins of one content together: each item goes where the least room is left."""
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for s in range(capacity, 0, -1):
        left = int(count[s])
        while left:
            room = min((r for r in open_ if r >= s), default=None)
            if room is None:
                each = capacity // s
                for n, m in ((left // each, each), (1, left % each)):
                    if n and m:
                        open_.setdefault(capacity - m * s, []).append((n, (s,) * m))
                left = 0
                break
            n, sizes = open_[room].pop()
            if not open_[room]:
                del open_[room]
            take = min(n, left)
            if n > take:
                open_.setdefault(room, []).append((n - take, sizes))
            open_.setdefault(room - s, []).append((take, (*sizes, s)))
            left -= take
    return [b for group in open_.values() for b in group]


def plan_bins(count: np.ndarray, capacity: int) -> Bins:
    """How many bins of which sizes hold all items: dominance reduction, then best fit. count: items by size, from 0."""
    count = count.astype(np.int64).copy()
    bins = reduce_dominated(count, capacity)
    return bins + best_fit(count, capacity)


def _places(bins: Bins) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, rank after the last, items a bin, first bin, offset): where the items of a size go, by rank.

    At most about 3 runs of bins a size and 44 sizes a bin: bounded by the capacity, whatever the number of items.
    """
    out, rank, first = [], {}, 0
    for n, sizes in bins:
        offset = 0
        for s in sorted(set(sizes), reverse=True):
            m = sizes.count(s)
            at = rank.get(s, 0)
            out.append((s, at, at + n * m, m, first, offset))
            rank[s] = at + n * m
            offset += m * s
        first += n
    return out


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """Pieces of each document: doc_id, row key, piece, start, length, ids_crc32. Only the first of many may be short."""

    def cut(batches):
        enc = encoder(tokenizer)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            row, piece, start, length, crc = [], [], [], [], []
            for lo, hi in text_groups(texts, GROUP_CHARS):
                for i, ids in zip(range(lo, hi), enc.encode(texts[lo:hi])):
                    ids = memoryview(ids + END)
                    n = len(ids) // 4
                    a, k = 0, 0
                    size = (n - 1) % capacity + 1
                    while a < n:
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(size)
                        crc.append(zlib.crc32(ids[4 * a: 4 * (a + size)]))
                        a, k, size = a + size, k + 1, capacity
            at = pa.array(row, pa.int32())
            yield pa.record_batch({"doc_id": b.column(0).take(at), "f": b.column(2).take(at), "r": b.column(3).take(at), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    rows = with_row_key(docs, "doc_id", "text")
    return rows.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FILE} long, {ROW} long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id; null and empty texts are the end id alone. Longer ones are cut so that only
    the first piece may be shorter than the capacity. Sizes are counted (at most `capacity` counters), planned on the
    driver, and every piece finds its place by its rank among the pieces of its size. Repeated rows and null ids are
    documents of their own. Empty table: no rows. A very long text is cut as any
    other. Other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer, capacity), "pieces")
    count = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        count[r[0]] = r[1]
    places = spark.createDataFrame(_places(plan_bins(count, capacity)), "size long, lo long, hi long, each long, bin long, at long")
    ranked = gapless(pieces, ["length"], ["doc_id", FILE, ROW, "piece"], "__lw_rank")
    out = ranked.join(F.broadcast(places), (F.col("length") == F.col("size")) & (F.col("__lw_rank") >= F.col("lo")) & (F.col("__lw_rank") < F.col("hi")))
    k = F.col("__lw_rank") - F.col("lo")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("bin") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + k % F.col("each") * F.col("size")).cast("long").alias("offset"))
