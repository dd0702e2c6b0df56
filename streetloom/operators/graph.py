"""Connected pieces of an edge table."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many edges one task ends the work; more of them are reduced by star steps first. Both give the same.
LOCAL_EDGES = 200_000


def _written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.gettempdir()
    path = f"{where.rstrip('/')}/pieces-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _end(batches):
    """The edges of one task as stars around the least node of each piece, found by union and find."""
    found = [(b.column(0), b.column(1)) for b in batches if len(b)]
    if not found:
        return
    ends = pa.chunked_array([c for pair in found for c in pair]).combine_chunks()
    keys = [tuple(k.values()) if isinstance(k, dict) else k for k in ends.to_pylist()]
    place, up = {}, {}
    for i, k in enumerate(keys):
        place.setdefault(k, i)
        up.setdefault(k, k)

    def root(k):
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    at = 0
    for a, _ in found:
        for i in range(len(a)):
            x, y = root(keys[at + i]), root(keys[at + len(a) + i])
            up[max(x, y)] = min(x, y)
        at += 2 * len(a)
    far = [k for k in up if root(k) != k]
    if far:
        yield pa.record_batch({"u": ends.take(pa.array([place[root(k)] for k in far])), "v": ends.take(pa.array([place[k] for k in far]))})


def pieces(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, piece): the smallest node reachable over edges(u, v), for every end of an edge; null ends are ignored.

    Large graphs shrink by alternating star steps: every node's larger neighbours are hung on its least neighbour, then
    its smaller ones too, until nothing moves or few edges are left. Each round is written to the shared folder.
    """
    edges = edges.select("u", "v").where("u is not null and v is not null")
    ends = _written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    e, before = ends.where("u <> v"), None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] <= local_edges:
            e = e.coalesce(1).mapInArrow(_end, e.schema)
            break
        if state == before:
            break
        before = state
        seen = e.union(e.select("v", "u")).toDF("x", "y")
        least = seen.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        hung = _written(seen.join(least, "x").where("y > x and y <> m").select(F.col("m").alias("u"), F.col("y").alias("v")).distinct())
        least = hung.groupBy("v").agg(F.min("u").alias("m"))
        moved = hung.join(least, "v").where("u <> m").select("m", F.col("u").alias("v"))
        e = _written(least.select("m", "v").union(moved).distinct().toDF("u", "v"))
    stars = _written(e.select(F.col("v").alias("node"), F.col("u").alias("piece")))
    nodes = ends.select("u").union(ends.select("v")).distinct().toDF("node")
    return _written(nodes.join(stars, "node", "left").select("node", F.coalesce("piece", "node").alias("piece")))
