"""Pairs of documents by the exact Jaccard similarity of their sets of word shingles: prefix filter, then all hashes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FILE, ROW, begin_task, chunks_of, materialize, release_driver, with_row_key
from .components import components

#: Shingles are ordered by how many of a tenth of the documents (of so many at least) hold them, rare ones first; any order gives the same pairs.
#: A share, not a number: else the lists of what counts as rare get longer with the table, and their pairs with its square.
SAMPLE_DOCS, SAMPLE_SHARE = 5_000, 0.1
#: At most so many common shingles (12 bytes each) are told apart by their counts.
COMMON = 1_000_000
#: Up to so many documents' keys (32 bytes each) are broadcast to find their texts; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 500_000
#: A task handles about so many prefix shingles.
TASK_TOKENS = 100_000
#: Sets are counted by so many ranges of the hash, up to 255 in each: a bound of what two sets share before they are sent.
RANGES = 256
#: So many shared shingles before its own go with each: a pair is listed where it has none of them in common, not at each that it has.
BEFORE = 4
#: Before all pairs are listed, neighbours are verified in the lists of each document's first so many shared shingles.
FIRST = 8
#: And then, in lists that leave more than LONG sets to compare with, so many of them.
LONG, PICKS = 64, 8
#: So many pairs of a task are looked at, and so many held before repeats go.
STEP_PAIRS, HELD_PAIRS = 500_000, 1_000_000
_EPS = 1e-9


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, and only ASCII white space


def hashes(words: list[bytes], shingle: int):
    """Hashes of all word shingles, repeats included, in blocks; one shingle of all words if they are fewer, no block without words."""
    if not words:
        return
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, 1 << 15):
        yield np.array([digest(b" ".join(words[i: i + shingle]), 42) for i in range(lo, min(n, lo + (1 << 15)))], np.uint64)


def hash_set(blocks) -> np.ndarray:
    """Distinct hashes in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *blocks]))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    values = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), values.view(np.int64))


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, that at least three sampled documents hold, and in how many."""
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_DOCS / max(1, docs.count())))
    picked = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")

    def work(batches):
        begin_task("simhash")
        for b in batches:
            for t in (t.as_py() for t in b.column(0)):  # one by one: little memory
                yield pa.record_batch({"h": hash_set(hashes(split(t or ""), shingle)).view(np.int64)})

    found = picked.mapInArrow(work, "h long").groupBy("h").count().where("count >= 3").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    h, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], n[order].astype(np.int32)


def prefix(own: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first hashes of a set, rare ones first: two sets as similar as `least` have one of them in common."""
    size = len(own) - math.ceil(least * len(own) - _EPS) + 1 if len(own) else 0
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], own), len(common[0]) - 1)
        own = own[np.argsort(np.where(common[0][at] == own, common[1][at], 0), kind="stable")]
    return own[:size]


def ranges(own: np.ndarray) -> bytes:
    """How many hashes lie in each range, 255 if more."""
    return np.minimum(np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8).tobytes()


def _possible(least: float):
    """Keeps the pairs (a, b, na, nb, ra, rb) whose counts by range leave the similarity possible."""

    def work(batches):
        for b in batches:
            for lo in range(0, len(b), 2000):
                c = b.slice(lo, 2000)
                x, y = (np.frombuffer(b"".join(c.column(i).to_pylist()), np.uint8).reshape(-1, RANGES) for i in (4, 5))
                open_ = (x == 255).any(1) | (y == 255).any(1)
                size = c.column(2).to_numpy().astype(float) + c.column(3).to_numpy()
                ok = open_ | (np.minimum(x, y).sum(1, dtype=np.int64) >= least / (1 + least) * size - _EPS)
                yield c.select(["a", "b"]).filter(pa.array(ok))

    return work


def _alike(table: pa.Table, least: float, which: str) -> pa.Table:
    """Pairs of sets with a token in common that size and places in the order leave possible, and of different components.

    which: "next", those next to each other among sets of like size, in another order for each token; "some", in long
    lists PICKS for each set outside the list's largest component; "all", for each of these all of the list, where a
    pair goes on from the first token that it has in common, and from others only if more than BEFORE tokens lie between.
    """
    columns = [table.column(c).to_numpy() for c in ("token", "at", "n", "sid", "comp", *(f"b{k}" for k in range(BEFORE)))]
    if which != "next":
        order = np.lexsort((columns[2], columns[0]))
    else:
        like = np.floor(np.log(columns[2]) / max(-math.log(least), 1e-6))
        order = np.lexsort(((columns[3] ^ columns[0]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), like, columns[0]))
    token, at, n, sid, comp, *before = (x[order] for x in columns)
    none = np.zeros(0, np.int64)
    a, b, held, most = [none], [none], 0, HELD_PAIRS

    def distinct():
        x, y = np.concatenate(a), np.concatenate(b)
        o = np.lexsort((y, x))
        x, y = x[o], y[o]
        new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)]
        return [x[new]], [y[new]]

    def add(i, j):
        """i, j: places in one list each."""
        nonlocal a, b, held, most
        small, large = np.minimum(n[i], n[j]).astype(float), np.maximum(n[i], n[j])
        ok = (small >= least * large - _EPS) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= least / (1 + least) * (small + large) - _EPS) & (comp[i] != comp[j])
        i, j = i[ok], j[ok]
        for x in before if which == "all" else ():
            for y in before:
                new = (x[i] != y[j]) | (x[i] == token[i])  # its own token stands for none
                i, j = i[new], j[new]
        a.append(np.minimum(sid[i], sid[j]))
        b.append(np.maximum(sid[i], sid[j]))
        held += len(i)
        if held > most:
            a, b = distinct()
            held = len(a[0])
            most = max(HELD_PAIRS, 2 * held)

    if which == "next":
        i = np.flatnonzero(token[1:] == token[:-1])
        add(i, i + 1)
    elif len(token):
        row = np.cumsum(np.append(False, token[1:] != token[:-1]))
        o = np.lexsort((comp, row))
        first = np.flatnonzero(np.append(True, (row[o][1:] != row[o][:-1]) | (comp[o][1:] != comp[o][:-1])))
        size = np.diff(np.append(first, len(o)))
        by = np.lexsort((size, row[o][first]))  # the last of each list is its largest component
        last = by[np.append(row[o][first][by][1:] != row[o][first][by][:-1], True)]
        minor = comp != comp[o][first][last][row]
        m = np.flatnonzero(minor)
        key = (row << 32) | n
        lo = np.searchsorted(key, (row[m] << 32) | np.ceil(least * n[m] - 1e-6).astype(np.int64))
        hi = np.searchsorted(key, (row[m] << 32) | np.floor(n[m] / least + 1e-6).astype(np.int64), "right")
        if which == "some":
            m, lo, size = m[long := hi - lo > LONG], lo[long], (hi - lo)[long]
            for k in range(PICKS):
                draw = ((sid[m] ^ token[m]).view(np.uint64) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
                add(m, lo + ((draw >> np.uint64(24)) % size.astype(np.uint64)).astype(np.int64))
            m, lo, hi = m[:0], lo[:0], hi[:0]
        ends = np.cumsum(hi - lo)
        at_m = 0
        while at_m < len(m):
            done = ends[at_m - 1] if at_m else 0
            to = max(at_m + 1, int(np.searchsorted(ends, done + STEP_PAIRS, "right")))
            k = (hi - lo)[at_m:to]
            i = np.repeat(m[at_m:to], k)
            j = np.arange(len(i)) + np.repeat(lo[at_m:to] - (np.cumsum(k) - k), k)
            once = ~minor[j] | (j > i)
            add(i[once], j[once])
            at_m = to
    a, b = distinct()
    return pa.table({"a": a[0], "b": b[0]})


def shingle_links(docs: DataFrame, rows: DataFrame, links: DataFrame, shingle: int, least: float) -> DataFrame:
    """links(a, b) of fingerprints, and more so that all are connected whose documents' shingle sets have Jaccard similarity >= least.

    rows: of every document of docs its row key, fp, and of its set the digest (sid), size (n), counts and prefix. First
    neighbours in the tokens' lists are verified, then a few more in long lists, then all pairs that are not yet
    connected: so a large group of near copies that are mostly linked needs few of its pairs. Documents without words link no others here.
    """
    links = materialize(links, "links")
    release_driver(docs.sparkSession)
    some = rows.where("n > 0")
    sets = materialize(some.groupBy("sid").agg(F.min(F.struct("fp", FILE, ROW, "n", "counts")).alias("s")).select("sid", F.col("s.fp").alias("set_fp"), F.col(f"s.{FILE}").alias("f"), F.col(f"s.{ROW}").alias("r"), "s.n", "s.counts"), "sets")
    equal = some.select("sid", "fp").join(sets.select("sid", "set_fp"), "sid").where("fp <> set_fp").select(F.col("fp").alias("a"), F.col("set_fp").alias("b")).distinct()
    own = some.join(sets.select("f", "r"), (F.col(FILE) == F.col("f")) & (F.col(ROW) == F.col("r")))
    tokens = own.select("sid", "n", F.posexplode("prefix").alias("at", "token"))
    parts = max(chunks_of(docs.sparkSession), math.ceil((rows.agg(F.sum(F.size("prefix"))).first()[0] or 0) / TASK_TOKENS))
    shape = "sid long, n int, at int, token long, part int"

    def repeated(table):
        token = table.column("token").to_numpy()
        order = np.argsort(token, kind="stable")
        same = token[order][1:] == token[order][:-1]
        return table.take(pa.array(order[np.append(same, False) | np.append(False, same)])) if len(same) else table.slice(0, 0)

    tokens = tokens.withColumn("part", F.pmod(F.xxhash64("token"), F.lit(parts)).cast("int"))
    shared = materialize(tokens.groupBy("part").applyInArrow(repeated, shape), "tokens")
    w = Window.partitionBy("sid").orderBy("at")
    shared = materialize(shared.select("*", *(F.coalesce(F.lag("token", k + 1).over(w), "token").alias(f"b{k}") for k in range(BEFORE)), F.row_number().over(w).alias("rank")), "tokens")
    text = with_row_key(docs, F.col("text"))

    def listed(batches):
        begin_task("simhash")
        for b in batches:
            for lo in range(0, len(b), 200):
                c = b.slice(lo, 200)
                yield pa.record_batch({"sid": c.column(0), "fp": c.column(1), "h": _lists([hash_set(hashes(split(t or ""), shingle)) for t in c.column(2).to_pylist()])})

    def verified(found: DataFrame, which: str) -> DataFrame:
        release_driver(docs.sparkSession)
        comp = sets.join(found, F.col("set_fp") == F.col("node"), "left").select(F.col("sid").alias("k"), F.coalesce("component", "set_fp").alias("comp"))
        d = (shared if which == "all" else shared.where(F.col("rank") <= FIRST)).join(comp, F.col("sid") == F.col("k")).select("part", "token", "at", "n", "sid", "comp", *(f"b{k}" for k in range(BEFORE)))
        pairs = d.groupBy("part").applyInArrow(lambda t: _alike(t, least, which), "a long, b long").distinct()
        pairs = materialize(pairs, "pairs")  # written first: no two Python operators share a stage
        x, y = (sets.select(F.col("sid").alias(s), F.col("n").alias(f"n{s}"), F.col("counts").alias(f"r{s}")) for s in "ab")
        pairs = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_possible(least), "a long, b long")
        pairs = materialize(pairs, "pairs")
        release_driver(docs.sparkSession)
        wanted = pairs.select(F.col("a").alias("w")).union(pairs.select("b")).distinct()
        wanted = materialize(sets.join(wanted, F.col("sid") == F.col("w")).select("sid", "set_fp", "f", "r"), "wanted")
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        full = text.join(wanted, (F.col(FILE) == F.col("f")) & (F.col(ROW) == F.col("r"))).select("sid", "set_fp", "text")
        full = materialize(full.mapInArrow(listed, "sid long, fp long, h array<long>"), "hashes")
        x, y = (full.select(F.col("sid").alias(s), F.col("fp").alias(f"{s}_fp"), F.col("h").alias(f"{s}_h")) for s in "ab")
        k = F.size(F.array_intersect("a_h", "b_h"))
        near = pairs.join(x, "a").join(y, "b").where(k >= least * (F.size("a_h") + F.size("b_h") - k) - _EPS)
        return materialize(near.select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")).where("a <> b"), "near")

    links = materialize(links.union(equal), "links")
    for which in ("next", "some"):
        links = links.union(verified(components(links), which))
    return links.union(verified(components(links), "all"))
