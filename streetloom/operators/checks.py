"""Rules that a built network keeps: ends are nodes, no loops, one piece, drawn lines unbroken. Tables: edges (u, v, custom, line_id), nodes (node_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import IntegrityError
from ..functions.features import named
from .graph import pieces


def unknown_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, edges): ends of edges that are no nodes, null ones too, with how many edges end there."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node_id"))
    return ends.join(nodes.select(F.col("node_id").alias("n")), F.col("node_id") == F.col("n"), "left_anti").groupBy("node_id").agg(F.count("*").alias("edges"))


def stranded(edges: DataFrame) -> DataFrame:
    """Custom edges of pieces without any existing street, with their piece; none if the network is one piece."""
    p = pieces(edges.select("u", "v"))
    d = edges.join(p, edges["u"] == p["node"]).drop("node")
    return d.join(d.where(~F.col("custom")).select("piece").distinct(), "piece", "left_anti").join(p.agg((F.min("piece") < F.max("piece")).alias("many")).where("many"), F.lit(True), "left_semi")


def outside_largest(edges: DataFrame) -> DataFrame:
    """(line_id, piece) of lines with edges outside the piece with most edges (the smallest piece on a tie)."""
    p = pieces(edges.select("u", "v"))
    d = edges.join(p, edges["u"] == p["node"]).select("line_id", "piece")
    best = d.groupBy("piece").agg(F.count("*").alias("n")).agg(F.min_by("piece", F.struct(-F.col("n"), "piece")).alias("best"))
    return d.join(F.broadcast(best), d["piece"] != F.col("best")).select("line_id", "piece").distinct()  # best: one row


def broken_lines(edges: DataFrame) -> tuple[int, int]:
    """How many pieces the custom edges make by themselves, and how many lines were drawn: no more pieces than lines."""
    own = edges.where("custom")
    return pieces(own.select("u", "v")).select("piece").distinct().count(), own.select("line_id").distinct().count()


def check(edges: DataFrame, nodes: DataFrame) -> None:
    """Raises IntegrityError naming what is wrong; reads counts and ten ids of each fault only."""
    faults = []
    loops = edges.where("u = v")
    for text, d, column in (("edges end at no node", unknown_ends(edges, nodes), "node_id"), ("edges end where they start", loops, "u"), ("custom edges are not connected to the network", stranded(edges), "u")):
        n = d.count()
        if n:
            told = d.select(column).distinct().orderBy(column).limit(11).agg(named(F.collect_list(column)).alias("t")).first()["t"]
            faults.append((None, f"{text} ({n}): {told}"))
    made, drawn = broken_lines(edges)
    if made > drawn:
        faults.append((None, f"{drawn} lines came out in {made} pieces"))
    if faults:
        raise IntegrityError("; ".join(m for _, m in faults), faults)
