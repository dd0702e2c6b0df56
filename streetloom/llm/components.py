"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_components, materialize

#: Up to so many edges (16 bytes each) one task ends the work; beyond it, star steps over shuffles go on.
LOCAL_EDGES = 1_000_000


def _forest(batches):
    """The edges of one task as stars: no more edges than nodes. Reads at most LOCAL_EDGES rows at once."""
    held, size = [], 0
    def flush():
        a = np.concatenate([x[0] for x in held])
        b = np.concatenate([x[1] for x in held])
        node, root = local_components(a, b)
        far = node != root
        return pa.record_batch({"a": root[far], "b": node[far]})
    for x in batches:
        held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
        size += len(x)
        if size >= LOCAL_EDGES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) of every node of edges (a long, b long): component is the smallest node reachable.

    Nodes without an edge to another node are absent; null ends and a = b are ignored. Each round is written to
    the shared folder. Hubs meet in partial aggregates and in joins that Spark splits at run time.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    e = materialize(e, "edges")  # written first: no two Python operators share a stage
    before = None
    while True:
        n, mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n <= local_edges:
            e = e.coalesce(1).mapInArrow(_forest, "a long, b long")
            break
        if (n, mark) == before:
            break
        before = (n, mark)
        both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).union(e.select("b", "a"))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(low, "x").where("y > x and y <> m").select(F.col("m").alias("a"), F.col("y").alias("b")).distinct()
        large = materialize(large, "edges")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        hung = large.join(low, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        e = materialize(low.select(F.col("m").alias("a"), "b").union(hung).distinct(), "edges")
    stars = e.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return materialize(stars.union(e.select("a", "a").distinct()), "components")
