"""Queries over feature rules, ferries and checks of a network; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import features, geom, tags
from ..operators import checks
from ..sources import derived as src
from .network import _with_ends, jn_09_crossings
from .oracle import _LINE_PIECES, _LINES, _NODES, _STREETS, _side


def scl_01_tag_value(spark, sf_dir):
    """Attributes of every kind as tag text."""
    c = src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    text = F.get(F.array(*map(F.lit, ("", "  ", " yes ", "30 mph"))), F.col("id") % 5)
    d = c.withColumns({"text": text, "flag": F.when(F.col("id") % 3 < 2, F.col("id") % 3 == 0), "number": F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("id") / 2)})
    return d.select("id", *(features.tag_value(F.col(n), k).alias(n) for n, k in (("text", "string"), ("flag", "boolean"), ("number", "double"))))


def scl_08_oneway_text(spark, sf_dir):
    """oneway of layers with truth values, in words."""
    word = F.get(F.array(*map(F.lit, ("True", "false", "yes", "-1"))), F.col("c_custkey") % 5)
    return src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), features.oneway_text(word).alias("oneway"))


def agg_15_unknown(spark, sf_dir):
    """Unknown highway values with the first ten streets' ways that have them."""
    d = src.streets(spark, sf_dir).where(~F.col("highway").isin("motorway", "primary", "residential"))
    return d.groupBy(F.col("highway").alias("value")).agg(features.named(F.collect_set("way_id")).alias("ways"))


def flt_25_other_vehicles(spark, sf_dir):
    """Streets that buses or lorries may use where no mode may."""
    d = src.streets(spark, sf_dir)
    tag = lambda k: F.when(F.col("line") % 3 == 0, F.col("foot")) if k == "bus" else F.when(F.col("line") == 5, F.lit("busway")).otherwise(F.col("highway")) if k == "highway" else F.lit(None).cast("string")
    return d.groupBy("highway", "line").agg(F.count_if(features.open_to_other_vehicles(tag)).alias("open"), F.count("*").alias("streets"))


def qgs_02_ferry(spark, sf_dir):
    """Speeds of ferry edges: service streets sail, their way is the line, with a duration on even ways."""
    d = _with_ends(spark, sf_dir, src.streets(spark, sf_dir))
    d = d.withColumn("length", geom.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    own = {"highway": F.when(F.col("highway") != "service", F.col("highway")), "route": F.lit("ferry"), "maxspeed": F.col("maxspeed"), "duration": F.when(F.col("way_id") % 2 == 0, "01:30")}
    d = d.where("highway = 'service'").select("okey", "line", "u", "v", "way_id", F.round(features.ferry_kph(lambda k: own.get(k, F.lit(None).cast("string")), F.col("length"), "way_id"), 4).alias("kph"))
    return d


def agg_19_custom_pieces(spark, sf_dir):
    """Pieces that lines make by crossing, against the lines drawn."""
    c = jn_09_crossings(spark, sf_dir).select(F.col("line_a").alias("u"), F.col("line_b").alias("v"))
    own = src.lines(spark, sf_dir).select("line_id").distinct().select(F.col("line_id").alias("u"), F.col("line_id").alias("v"))
    e = c.union(own).select("u", "v", F.lit(True).alias("custom"), F.col("u").alias("line_id"))
    made, drawn = checks.broken_lines(e)
    return spark.createDataFrame([(made, drawn)], "pieces long, lines long")


def top_27_outside(spark, sf_dir):
    """Lines outside the piece with most crossings."""
    c = jn_09_crossings(spark, sf_dir).select(F.col("line_a").alias("u"), F.col("line_b").alias("v"))
    return checks.outside_largest(c.select("u", "v", F.col("u").alias("line_id")))


def grf_07_unknown_ends(spark, sf_dir):
    """Ends of streets that are no nodes, where the nodes with x = 300 are missing."""
    return checks.unknown_ends(src.streets(spark, sf_dir), src.nodes(spark, sf_dir).where("x <> 300"))


def win_11_along(spark, sf_dir):
    """How far along its line each vertex is."""
    w = Window.partitionBy("line_id").orderBy("pos")
    d = src.lines(spark, sf_dir).withColumns({"lx": F.lag("x").over(w), "ly": F.lag("y").over(w)})
    step = F.coalesce(geom.distance(F.col("lx"), F.col("ly"), F.col("x"), F.col("y")), F.lit(0.0))
    return d.withColumn("step", step).select("line_id", "pos", F.round(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("along"))


def jn_29_way_of_step(spark, sf_dir):
    """The first way that holds each step between two nodes, whichever way it is drawn."""
    d = src.streets(spark, sf_dir)
    return d.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min("way_id").alias("way_id"), F.countDistinct("way_id").alias("ways"))


def srt_10_preferred(spark, sf_dir):
    """Streets at a node ranked with those that have a speed first, then by order and line."""
    w = Window.partitionBy("u").orderBy(F.col("maxspeed").isNull(), "okey", "line", "way_id", "v")
    return src.streets(spark, sf_dir).select("u", "okey", "line", "way_id", F.row_number().over(w).alias("place"))


def jn_21_coordinates(spark, sf_dir):
    """Streets with the places of their ends."""
    return _with_ends(spark, sf_dir, src.streets(spark, sf_dir)).select("okey", "line", "way_id", "u", "v", "x1", "y1", "x2", "y2")


def flt_28_by_mode(spark, sf_dir):
    """The streets of the network for cycling, by kind."""
    d = src.streets(spark, sf_dir)
    return d.where(tags.allows_mode(tags.from_columns(d.columns), "bike")).groupBy("highway").agg(F.count("*").alias("streets"), F.countDistinct("way_id").alias("ways"))


QUERIES = {f.__name__: f for f in (scl_01_tag_value, scl_08_oneway_text, agg_15_unknown, flt_25_other_vehicles, qgs_02_ferry, agg_19_custom_pieces, top_27_outside, grf_07_unknown_ends, win_11_along, jn_29_way_of_step, srt_10_preferred, jn_21_coordinates, flt_28_by_mode)}

_BIKE = "(access IS NULL AND highway <> 'motorway' AND (highway <> 'footway' OR coalesce(bicycle, '') = 'designated'))"
_FERRY = "CASE WHEN maxspeed LIKE '% mph' THEN nullif(replace(maxspeed, ' mph', '')::DOUBLE, 0) * 1.609344 ELSE nullif(maxspeed::DOUBLE, 0) END"
ORACLE_SQL: dict[str, str] = {
    "scl_01_tag_value": """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 2 THEN 'yes' WHEN 3 THEN '30 mph' END AS text, CASE c_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS flag,
 CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN (c_custkey // 2)::VARCHAR ELSE (c_custkey // 2)::VARCHAR || '.5' END AS number FROM customer""",
    "scl_08_oneway_text": "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'yes' WHEN 3 THEN '-1' END AS oneway FROM customer",
    "agg_15_unknown": f"""WITH {_STREETS}, w AS (SELECT highway, way_id, row_number() OVER (PARTITION BY highway ORDER BY way_id) AS k, count(*) OVER (PARTITION BY highway) AS n FROM (SELECT DISTINCT highway, way_id FROM streets WHERE highway NOT IN ('motorway', 'primary', 'residential')))
SELECT highway AS value, string_agg(way_id::VARCHAR, ', ' ORDER BY way_id) FILTER (WHERE k <= 10) || CASE WHEN max(n) > 10 THEN ' and ' || (max(n) - 10) || ' more' ELSE '' END AS ways FROM w GROUP BY 1""",
    "flt_25_other_vehicles": f"WITH {_STREETS} SELECT highway, line, count(*) FILTER (WHERE line = 5 OR (line % 3 = 0 AND foot = 'yes')) AS open, count(*) AS streets FROM streets GROUP BY 1, 2",
    "qgs_02_ferry": f"""WITH {_NODES}, {_STREETS}, e AS (SELECT okey, line, u, v, way_id, maxspeed, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS len FROM streets JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v WHERE highway = 'service')
SELECT okey, line, u, v, way_id, round(CASE WHEN way_id % 2 = 0 THEN sum(len) OVER (PARTITION BY way_id) / 1000 / 1.5 ELSE coalesce({_FERRY}, 10.0) END, 4) AS kph FROM e""",
    "agg_19_custom_pieces": f"WITH {_LINE_PIECES} SELECT count(DISTINCT piece) AS pieces, count(*) AS lines FROM found",
    "top_27_outside": f"""WITH {_LINE_PIECES}, x AS (SELECT DISTINCT a.line_id AS u, a.pos, b.line_id AS v, b.pos AS q FROM seg a JOIN seg b ON a.line_id % 4 = b.line_id % 4 AND a.line_id < b.line_id AND (a.line_id, b.line_id) IN (SELECT (u, v) FROM c)
 AND {_side('a', 'b', 1)} * {_side('a', 'b', 2)} < 0 AND {_side('b', 'a', 1)} * {_side('b', 'a', 2)} < 0), n AS (SELECT piece, count(*) AS n FROM x JOIN found ON line_id = u GROUP BY 1) SELECT DISTINCT u AS line_id, piece FROM x JOIN found ON line_id = u WHERE piece <> (SELECT piece FROM n ORDER BY n DESC, piece LIMIT 1)""",
    "grf_07_unknown_ends": f"WITH {_NODES}, {_STREETS} SELECT n AS node_id, count(*) AS edges FROM (SELECT u AS n FROM streets UNION ALL SELECT v FROM streets) WHERE n NOT IN (SELECT node_id FROM nodes WHERE x <> 300) GROUP BY 1",
    "win_11_along": f"WITH {_LINES}, d AS (SELECT line_id, pos, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step FROM lines WINDOW w AS (PARTITION BY line_id ORDER BY pos)) SELECT line_id, pos, round(sum(step) OVER (PARTITION BY line_id ORDER BY pos), 4) AS along FROM d",
    "jn_29_way_of_step": f"WITH {_STREETS} SELECT least(u, v) AS a, greatest(u, v) AS b, min(way_id) AS way_id, count(DISTINCT way_id) AS ways FROM streets GROUP BY 1, 2",
    "srt_10_preferred": f"WITH {_STREETS} SELECT u, okey, line, way_id, row_number() OVER (PARTITION BY u ORDER BY (maxspeed IS NULL)::INT, okey, line, way_id, v)::INT AS place FROM streets",
    "jn_21_coordinates": f"WITH {_NODES}, {_STREETS} SELECT okey, line, way_id, u, v, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM streets JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v",
    "flt_28_by_mode": f"WITH {_STREETS} SELECT highway, count(*) AS streets, count(DISTINCT way_id) AS ways FROM streets WHERE {_BIKE} GROUP BY 1",
}
