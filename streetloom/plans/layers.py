"""Queries over custom layers: triage of lines, repeated ids, vertices by place, ranks; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import derived as src
from .network import _nearest
from .oracle import _LINES, _NEAR, _STREETS

#: West, south, east, north of the area that lines are held against.
AREA = (-150.0, -150.0, 150.0, 150.0)


def flt_01_triage(spark, sf_dir):
    """Lines inside, partly inside or outside the area, by their vertices."""
    w, s, e, n = AREA
    inside = F.col("x").between(w, e) & F.col("y").between(s, n)
    d = src.lines(spark, sf_dir).groupBy("line_id").agg(F.bool_and(inside).alias("whole"), F.bool_or(inside).alias("some"))
    return d.select("line_id", F.when(F.col("whole"), "inside").when(F.col("some"), "partly").otherwise("outside").alias("place"))


def flt_02_within_earth(spark, sf_dir):
    """Whether all of a line's coordinates, read as degrees, are numbers on the earth."""
    ok = (F.abs("x") <= 180) & (F.abs("y") <= 90)
    return src.lines(spark, sf_dir).groupBy("line_id").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("on_earth"))


def flt_04_repeated_ids(spark, sf_dir):
    """Ids of ways that more than one street carries."""
    return src.streets(spark, sf_dir).groupBy("way_id").agg(F.count("*").alias("n")).where("n > 1")


def agg_01_vertex_flags(spark, sf_dir):
    """Vertices by exact place: whether a line ends there, whether all lines there are separated."""
    d = src.lines(spark, sf_dir)
    return d.groupBy("x", "y").agg(F.bool_or(F.col("pos") != 1).alias("is_end"), F.bool_and(F.col("line_id") % 4 == 0).alias("separated"))


def agg_02_layers(spark, sf_dir):
    """The layers that meet at a place, in order."""
    layer = F.sort_array(F.collect_set(F.col("line_id") % 4))
    return src.lines(spark, sf_dir).groupBy("x", "y").agg(F.concat_ws(";", layer.cast("array<string>")).alias("layers"))


def agg_04_kept(spark, sf_dir):
    """Vertices inside the area of lines that keep two at least."""
    w, s, e, n = AREA
    kept = src.lines(spark, sf_dir).where(F.col("x").between(w, e) & F.col("y").between(s, n))
    return kept.groupBy("line_id").agg(F.count("*").alias("vertices")).where("vertices >= 2")


def agg_05_way_edges(spark, sf_dir):
    return src.streets(spark, sf_dir).groupBy("way_id").agg(F.count("*").alias("edges"))


def agg_08_box(spark, sf_dir):
    return src.lines(spark, sf_dir).agg(F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"))


def srt_02_ranked_nodes(spark, sf_dir):
    """The nodes within 40 m of a point, by distance, then id."""
    w = Window.partitionBy("point_id").orderBy("away", "node_id")
    return _nearest(spark, sf_dir).select("point_id", "node_id", F.row_number().over(w).alias("place"))


QUERIES = {f.__name__: f for f in (flt_01_triage, flt_02_within_earth, flt_04_repeated_ids, agg_01_vertex_flags, agg_02_layers, agg_04_kept, agg_05_way_edges, agg_08_box, srt_02_ranked_nodes)}

_IN = "x BETWEEN -150 AND 150 AND y BETWEEN -150 AND 150"
ORACLE_SQL: dict[str, str] = {
    "flt_01_triage": f"WITH {_LINES} SELECT line_id, CASE WHEN bool_and({_IN}) THEN 'inside' WHEN bool_or({_IN}) THEN 'partly' ELSE 'outside' END AS place FROM lines GROUP BY 1",
    "flt_02_within_earth": f"WITH {_LINES} SELECT line_id, bool_and(coalesce(abs(x) <= 180 AND abs(y) <= 90, false)) AS on_earth FROM lines GROUP BY 1",
    "flt_04_repeated_ids": f"WITH {_STREETS} SELECT way_id, count(*) AS n FROM streets GROUP BY 1 HAVING count(*) > 1",
    "agg_01_vertex_flags": f"WITH {_LINES} SELECT x, y, bool_or(pos <> 1) AS is_end, bool_and(line_id % 4 = 0) AS separated FROM lines GROUP BY 1, 2",
    "agg_02_layers": f"WITH {_LINES} SELECT x, y, string_agg(DISTINCT (line_id % 4)::VARCHAR, ';' ORDER BY (line_id % 4)::VARCHAR) AS layers FROM lines GROUP BY 1, 2",
    "agg_04_kept": f"WITH {_LINES} SELECT line_id, count(*) AS vertices FROM lines WHERE {_IN} GROUP BY 1 HAVING count(*) >= 2",
    "agg_05_way_edges": f"WITH {_STREETS} SELECT way_id, count(*) AS edges FROM streets GROUP BY 1",
    "agg_08_box": f"WITH {_LINES} SELECT min(x) AS west, min(y) AS south, max(x) AS east, max(y) AS north FROM lines",
    "srt_02_ranked_nodes": f"WITH {_NEAR} SELECT point_id, node_id, row_number() OVER (PARTITION BY point_id ORDER BY away, node_id)::INT AS place FROM near WHERE away <= 40",
}
