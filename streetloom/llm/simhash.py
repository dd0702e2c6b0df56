"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE, ROW, begin_task, local_components, materialize, stored, with_row_key
from .components import components
from .shingles import _lists, common_shingles, hash_set, hashes, prefix, ranges, shingle_links, split

BITS = 64
#: About so many distinct fingerprints share a variant prefix; more of them mean longer prefixes.
PER_PREFIX = 500
#: A task handles about so many variants of one prefix; a prefix with more is split by a hash of the variant.
TASK_VARIANTS = 3_000_000


def fingerprint(text: str, shingle: int = 4) -> int:
    """SimHash of the word shingles, repeats included, unsigned."""
    return _of_hashes(hashes(split(text), shingle))


def _of_hashes(blocks) -> int:
    ones, n = np.zeros(BITS, np.int64), 0
    for h in blocks:
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (signed long) and row key of every document; null text counts as empty, without words fp is 0."""

    def work(batches):
        begin_task("simhash")
        for b in batches:
            fp = np.fromiter((fingerprint(t or "", shingle) for t in b.column(1).to_pylist()), np.uint64, len(b))
            yield pa.record_batch({"doc_id": b.column(0), "f": b.column(2), "r": b.column(3), "fp": fp.view(np.int64)})

    rows = with_row_key(docs, "doc_id", "text")
    return rows.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FILE} long, {ROW} long, fp long")


def sketches(docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """fingerprints, and of each document's set of shingles the digest sid, the size n, counts by range and the prefix that `least` asks for."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle))

    def work(batches):
        begin_task("simhash")
        for b in batches:
            for lo in range(0, len(b), 200):
                c = b.slice(lo, 200)
                found = [list(hashes(split(t or ""), shingle)) for t in c.column(1).to_pylist()]
                sets = [hash_set(f) for f in found]
                fp = np.fromiter((_of_hashes(f) for f in found), np.uint64, len(c))
                sid = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(c))
                yield pa.record_batch({"doc_id": c.column(0), "f": c.column(2), "r": c.column(3), "fp": fp.view(np.int64), "sid": sid.view(np.int64),
                                       "n": np.array([len(s) for s in sets], np.int32), "counts": pa.array([ranges(s) for s in sets], pa.binary()), "prefix": _lists([prefix(s, common.value, least) for s in sets])})

    rows = with_row_key(docs, "doc_id", "text")
    return rows.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FILE} long, {ROW} long, fp long, sid long, n int, counts binary, prefix array<long>")


def _masks(bits: int, weight: int) -> np.ndarray:
    """All masks over the low `bits` with at most `weight` bits set, 0 first."""
    return np.array([sum(1 << i for i in c) for w in range(weight + 1) for c in combinations(range(bits), w)], np.uint64)


def ball_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links between the distinct fingerprints fps(fp) that connect all those within `radius` bits.

    Two fingerprints within the radius have a common variant at half the radius from each. The variants are dealt by
    their prefix of p bits: a fingerprint is sent to every prefix that its variants can have, and only there its
    variants with that prefix are made, so that few rows are shuffled. In a task equal variants meet by a sort; each
    pair that meets is verified; a spanning forest of them goes on, not all pairs.
    """
    half, spark = radius // 2, fps.sparkSession
    n = fps.count()
    p = min(24, max(4, math.ceil(math.log2(max(1, n) / PER_PREFIX)) if n > PER_PREFIX else 4))
    low_bits = BITS - p
    low_masks = [_masks(low_bits, w) for w in range(half + 1)]
    steps = F.explode(F.array(*(F.struct(F.lit(int(m)).cast("long").alias("m"), F.lit(half - int(m).bit_count()).alias("left")) for m in _masks(p, half))))
    prefix = F.shiftrightunsigned("fp", low_bits)
    slices = fps.groupBy(prefix.alias("hot")).count().select("hot", F.ceil(F.col("count") * float(len(low_masks[half])) / TASK_VARIANTS).cast("int").alias("parts")).where("parts > 1")
    sent = fps.select("fp", steps.alias("s")).select("fp", F.col("s.left").alias("left"), prefix.bitwiseXOR(F.col("s.m")).alias("key"))
    sent = sent.join(slices, F.col("key") == F.col("hot"), "left").select("fp", "left", "key", F.coalesce("parts", F.lit(1)).alias("parts"))
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keep = np.uint64((1 << low_bits) - 1)

    def meet(key, table):
        fp = table.column("fp").to_numpy().view(np.uint64)
        left = table.column("left").to_numpy()
        parts, part = np.uint64(table.column("parts")[0].as_py()), np.uint64(key[1].as_py())
        owner, variant = [], []
        for w in range(half + 1):
            own = np.flatnonzero(left == w)
            for lo in range(0, len(own), max(1, TASK_VARIANTS // 8 // len(low_masks[w]))):
                some = own[lo: lo + max(1, TASK_VARIANTS // 8 // len(low_masks[w]))]
                v = ((fp[some] & keep)[:, None] ^ low_masks[w][None, :]).ravel()
                who = np.repeat(some.astype(np.int32), len(low_masks[w]))
                if parts > 1:
                    mine = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % parts == part
                    v, who = v[mine], who[mine]
                owner.append(who)
                variant.append(v)
        owner, variant = np.concatenate(owner), np.concatenate(variant)
        order = np.argsort(variant)
        variant, owner = variant[order], owner[order]
        same = np.flatnonzero(variant[1:] == variant[:-1])
        a, b = fp[owner[same]], fp[owner[same + 1]]
        near = (np.bitwise_count(a ^ b) <= radius) & (a != b)
        node, root = local_components(a[near].view(np.int64), b[near].view(np.int64))
        far = node != root
        return pa.table({"a": root[far], "b": node[far]})

    return sent.groupBy("key", "part").applyInArrow(meet, "a long, b long")


def _joined(docs: DataFrame, shingle: int, radius: int, least: float | None = None) -> DataFrame:
    """Of every document: doc_id, row key, fp and component, the smallest doc_id in reach (null if all are null)."""
    rows = materialize(fingerprints(docs, shingle) if least is None else sketches(docs, shingle, least), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    links = ball_links(fps.select("fp"), radius)
    if least is not None:
        links = shingle_links(docs, rows, links, shingle, least)
        rows = rows.drop("sid", "n", "counts", "prefix")
    found = components(links)
    linked = fps.join(found, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("c"))
    least = linked.groupBy("c").agg(F.min("low").alias("component_id"))
    named = materialize(linked.join(least, "c").select(F.col("fp").alias("k"), "component_id"), "named")
    return rows.join(named, F.col("fp") == F.col("k")).drop("k")


def near_groups(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    Documents link if their fingerprints differ in at most `radius` (even) bits. Null text counts as empty; all texts
    without words have fingerprint 0 and link like any other. Repeated rows each have a row. Empty table: no rows.
    A very long text is read whole. Ids of any type. Other columns are ignored.
    """
    out = _joined(docs, shingle, radius)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_group(docs: DataFrame, shingle: int = 5, radius: int = 4, least: float | None = None) -> DataFrame:
    """docs, with its own columns: of each group the row with the smallest doc_id stays (null last, then the first row).

    With least, documents also link whose sets of shingles have at least that Jaccard similarity, however far their
    fingerprints are apart.
    """
    docs = stored(docs)
    rows = materialize(_joined(docs, shingle, radius, least), "grouped")
    low = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", FILE, ROW)).alias("low")
    kept = rows.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("lone")).agg(low).select(F.col(f"low.{FILE}").alias("__lw_f"), F.col(f"low.{ROW}").alias("__lw_r"))
    d = with_row_key(docs)
    return d.join(kept, (d[FILE] == kept["__lw_f"]) & (d[ROW] == kept["__lw_r"]), "left_semi").select(*(d[c] for c in docs.columns))
