"""Queries over the street network, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geom, tags
from ..operators.build import crossings
from ..operators.graph import _written, pieces
from ..sources import derived as src

#: Tags that the access rules read.
_READ = [*dict.fromkeys(["highway", "route", "motorroad", *(k for keys in tags.ACCESS.values() for k in keys), *(k for rule in tags.EXCLUDED.values() for k in rule)])]
_KEY = ("okey", "line", "u", "v", "way_id")


def _streets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tags.Get]:
    d = src.streets(spark, sf_dir)
    return d, tags.from_columns(d.columns)


def _with_ends(spark: SparkSession, sf_dir: str, d: DataFrame) -> DataFrame:
    n = src.nodes(spark, sf_dir)
    a = n.select(F.col("node_id").alias("u"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = n.select(F.col("node_id").alias("v"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return d.join(a, "u").join(b, "v")


#: Combinations of tags that are broadcast at most (under 10 MB); more of them meet the streets in a shuffle.
MOST_SENT = 50_000


def by_combination(d: DataFrame, read: list[str], **rules) -> DataFrame:
    """d with the rules' columns, each worked out once for every combination of the tags that it reads."""
    there = [c for c in read if c in d.columns]
    combos = _written(d.select(*there).distinct().select(*(F.col(c).alias(f"_{c}") for c in there), *(c.alias(n) for n, c in rules.items())))
    sent = F.broadcast(combos) if combos.count() <= MOST_SENT else combos
    return d.join(sent, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in there], "left").drop(*(f"_{c}" for c in there))


def qgs_01(spark, sf_dir):
    """Analysis edges: who may use a street, how fast, which way, how long it takes."""
    d, tag = _streets(spark, sf_dir)
    d = by_combination(d, _READ, **{n: tags.allows_mode(tag, m) for n, m in (("car", "drive"), ("bike", "bike"), ("walk", "walk"))})
    d = _with_ends(spark, sf_dir, d)
    length = geom.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    speed = tags.car_speed_kph(tag)
    return d.select(*_KEY, "car", "bike", "walk", F.round(speed, 1).alias("speed_kph"), F.round(length, 2).alias("length_m"), F.round(length / 1000 / speed * 60, 4).alias("car_minutes"),
                    F.round(length / 1000 / tags.BIKE_KPH * 60, 4).alias("bike_minutes"), F.round(length / 1000 / tags.WALK_KPH * 60, 4).alias("walk_minutes"), tags.direction(F.col("oneway")).alias("car_direction"))


def flt_12_separated(spark, sf_dir):
    d, tag = _streets(spark, sf_dir)
    return d.groupBy("highway", tags.grade_separated(tag).alias("separated"), tags.layer(tag).alias("layer")).agg(F.count("*").alias("n"))


def flt_22_effective_access(spark, sf_dir):
    d, tag = _streets(spark, sf_dir)
    a = {m: tags.effective_access(tag, m) for m in ("drive", "bike", "walk")}
    return d.select(*_KEY, *(a[m][p].alias(f"{m}_{p}") for m in a for p in ("key", "value")))


def flt_24_usable_modes(spark, sf_dir):
    d, tag = _streets(spark, sf_dir)
    return by_combination(d, _READ, modes=F.array_join(tags.usable_modes(tag), ";")).select(*_KEY, "modes")


def agg_10_mode_counts(spark, sf_dir):
    return flt_24_usable_modes(spark, sf_dir).groupBy("modes").agg(F.count("*").alias("n"))


def flt_29_resolve_tags(spark, sf_dir):
    """Blanket tags (20 mph, two-way, lit) fill the blanks of each street, or replace its own."""
    d, tag = _streets(spark, sf_dir)
    blanket = {"maxspeed": "20 mph", "oneway": "no", "foot": "yes"}
    fill, put = tags.resolve(tag, blanket), tags.resolve(tag, blanket, overwrite=True)
    return d.select(*_KEY, *(fill[k].alias(f"filled_{k}") for k in blanket), *(put[k].alias(f"replaced_{k}") for k in blanket))


def flt_30_value_problems(spark, sf_dir):
    o = src.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"(\d+)", 1).alias("maxspeed"), F.regexp_extract("url", r"/([a-z]{2})/", 1).alias("oneway"), F.regexp_extract("url", r"page=(.*)$", 1).alias("lanes"), F.lit("1.5").alias("layer"))
    return o.select("page_id", F.array_join(tags.value_problems(tags.from_columns(o.columns)), ";").alias("problems"))


def scl_03_listed_keys(spark, sf_dir):
    return src.table(spark, sf_dir, "pages").select("page_id", F.array_join(tags.listed_keys(F.translate("url", "/.?", ";, ")), "|").alias("keys"))


def scl_04_maxspeed(spark, sf_dir):
    d, tag = _streets(spark, sf_dir)
    return d.groupBy("maxspeed").agg(F.count("*").alias("n")).select("maxspeed", "n", F.round(tags.maxspeed_kph(F.concat_ws(";", "maxspeed", F.lit("30 mph"), F.lit("signals"), F.lit("0"))), 6).alias("kph"))


def scl_05_car_speed(spark, sf_dir):
    d, tag = _streets(spark, sf_dir)
    return d.groupBy("highway", "maxspeed").agg(F.count("*").alias("n")).select("highway", "maxspeed", "n", F.round(tags.car_speed_kph(tags.from_columns(["highway", "maxspeed"])), 6).alias("kph"))


def scl_06_duration(spark, sf_dir):
    e = src.table(spark, sf_dir, "events")
    return e.select("event_id", F.round(tags.duration_hours(F.date_format("ts", "HH:mm:ss")), 6).alias("hours"))


def scl_07_direction(spark, sf_dir):
    d, _ = _streets(spark, sf_dir)
    return d.groupBy("oneway", tags.direction(F.col("oneway")).alias("direction")).agg(F.count("*").alias("n"))


def _buckets(spark):
    b = src.bands(spark).withColumn("day", F.explode("days"))
    first = F.col("day") * 288 + F.col("start_min") / 5
    last = F.col("day") * 288 + F.col("end_min") / 5 + F.when(F.col("end_min") <= F.col("start_min"), 288).otherwise(0)
    return b.select("name", "roads", "factor", "speed", F.explode(F.transform(F.sequence(first.cast("int"), last.cast("int") - 1), lambda i: F.pmod(i, F.lit(2016)))).alias("bucket"))


def win_04_buckets(spark, sf_dir):
    return _buckets(spark).select("name", "bucket")


def agg_13_week_speeds(spark, sf_dir):
    """Slowest band of a road class in every bucket of the week, else the normal speed, 1 km/h at least."""
    roads = spark.createDataFrame([(r, float(tags.CLASS_KPH[r])) for r in ("primary", "residential", "service")], "road string, normal double")
    week = roads.crossJoin(spark.range(2016).select(F.col("id").cast("int").alias("bucket")))  # 3 x 2016 rows
    b = _buckets(spark).select(F.explode("roads").alias("road"), "bucket", "factor", "speed")
    return week.join(b, ["road", "bucket"], "left").groupBy("road", "bucket", "normal").agg(F.min(F.coalesce("speed", F.col("normal") * F.col("factor"))).alias("low")).select("road", "bucket", F.round(F.greatest(F.coalesce("low", "normal"), F.lit(1.0)), 6).alias("kph"))


def jn_34_override(spark, sf_dir):
    """Events by week bucket; claimed users keep their own speed, others take the slowest band of their road class."""
    e = src.table(spark, sf_dir, "events")
    bucket = ((F.dayofweek("ts") - 1) * 288 + F.floor((F.hour("ts") * 60 + F.minute("ts")) / 5)).cast("int")
    road = F.get(F.array(F.lit("primary"), F.lit("residential"), F.lit("service")), (F.col("user_id") % 3).cast("int"))
    e = e.select("event_id", bucket.alias("bucket"), road.alias("road"), F.when(F.col("user_id") % 7 == 0, 12.5).alias("own"))
    return e.join(agg_13_week_speeds(spark, sf_dir), ["road", "bucket"]).select("event_id", "road", "bucket", F.coalesce("own", "kph").alias("kph"))


def agg_07_degree(spark, sf_dir):
    d = src.streets(spark, sf_dir)
    return d.select("u", "v").union(d.select("v", "u")).groupBy(F.col("u").alias("node_id")).agg(F.countDistinct("v").alias("degree"))


def agg_09_line_length(spark, sf_dir):
    d = _with_ends(spark, sf_dir, src.streets(spark, sf_dir))
    length = geom.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return d.groupBy("way_id").agg(F.round(F.sum(length), 3).alias("length_m"), F.count("*").alias("streets"))


def agg_12_summary(spark, sf_dir):
    d, tag = _streets(spark, sf_dir)
    return d.agg(F.count("*").alias("streets"), F.countDistinct("way_id").alias("ways"), F.count_if(F.col("oneway").isNotNull()).alias("directed"), F.count_if(tags.grade_separated(tag)).alias("separated"), F.count_if(F.col("maxspeed").isNull()).alias("without_speed"))


def win_01_ends(spark, sf_dir):
    w = Window.partitionBy("line_id").orderBy("pos")
    return src.lines(spark, sf_dir).select("line_id", "pos", (F.lag("pos").over(w).isNull() | F.lead("pos").over(w).isNull()).alias("is_end"))


def win_03_segments(spark, sf_dir):
    w = Window.partitionBy("line_id").orderBy("pos")
    d = src.lines(spark, sf_dir).select("line_id", "pos", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null and not (x1 = x2 and y1 = y2)")
    return d


def win_03_lengths(spark, sf_dir):
    d = win_03_segments(spark, sf_dir)
    return d.select("line_id", "pos", F.round(geom.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), 4).alias("length_m"))


def jn_09_crossings(spark, sf_dir):
    """Crossings of lines of one layer, by the grid cells that segments pass through."""
    s = win_03_segments(spark, sf_dir).withColumns({"layer": (F.col("line_id") % 4).cast("int"), "separated": F.lit(False)})
    return crossings(s).where("line_id < other").select(F.col("line_id").alias("line_a"), F.col("pos").alias("pos_a"), F.col("other").alias("line_b"), F.col("other_pos").alias("pos_b"))



def _nearest(spark, sf_dir, reach: float = 40.0):
    p, n = src.points(spark, sf_dir), src.nodes(spark, sf_dir)
    p = p.withColumn("cx", F.explode(geom.around(F.col("x"), reach))).withColumn("cy", F.explode(geom.around(F.col("y"), reach)))
    n = n.select("node_id", F.col("x").alias("nx"), F.col("y").alias("ny"), geom.cell(F.col("x"), reach).alias("ncx"), geom.cell(F.col("y"), reach).alias("ncy"))
    away = geom.distance(p["x"], p["y"], n["nx"], n["ny"])
    return p.join(n, (p["cx"] == n["ncx"]) & (p["cy"] == n["ncy"]) & (away <= reach)).select("point_id", "node_id", "nx", "ny", away.alias("away"))


def jn_01_snap_nodes(spark, sf_dir):
    """Each point within 40 m of a node moves to the nearest one, the smallest id on a tie."""
    low = F.min(F.struct("away", "node_id", "nx", "ny")).alias("s")
    return _nearest(spark, sf_dir).groupBy("point_id").agg(low).select("point_id", "s.node_id", F.col("s.nx").alias("x"), F.col("s.ny").alias("y"))


def jn_13_new_nodes(spark, sf_dir):
    """Points that no node is within 40 m of."""
    return src.points(spark, sf_dir).join(_nearest(spark, sf_dir).select("point_id").distinct(), "point_id", "left_anti")


def jn_18_integrity(spark, sf_dir):
    """Ends of streets, both of them, that are no known nodes (ends of streets with line 7 are moved on by 5)."""
    n, move = src.nodes(spark, sf_dir), F.when(F.col("line") == 7, 5).otherwise(0)
    d = src.streets(spark, sf_dir).select(F.explode(F.array(F.col("u") + move, F.col("v") + move)).alias("end"))
    return d.join(n, d["end"] == n["node_id"], "left_anti").groupBy("end").agg(F.count("*").alias("streets"))


def grf_08_self_loops(spark, sf_dir):
    """Streets that end where they start, of all streets."""
    return src.streets(spark, sf_dir, loops=True).where("u = v").select("okey", "line", F.col("u").alias("node_id"), "way_id")


def grf_02_pieces(spark, sf_dir):
    """Connected pieces of the network of all streets."""
    return pieces(src.streets(spark, sf_dir).select("u", "v")).select(F.col("node").alias("node_id"), "piece")


def _line_pieces(spark, sf_dir):
    """(line_id, piece) of every line: lines of one layer that cross are connected, a line alone is a piece by itself."""
    c = jn_09_crossings(spark, sf_dir).select(F.col("line_a").alias("u"), F.col("line_b").alias("v"))
    alone = src.lines(spark, sf_dir).select(F.col("line_id").alias("u"), F.col("line_id").alias("v"))
    return pieces(c.union(alone)).select(F.col("node").alias("line_id"), "piece")


def agg_06_largest(spark, sf_dir):
    """Pieces of the lines with their sizes, and which one is the largest (the smallest piece on a tie)."""
    d = _line_pieces(spark, sf_dir).groupBy("piece").agg(F.count("*").alias("lines"))
    best = d.agg(F.max(F.struct("lines", (-F.col("piece")).alias("k"))).alias("m")).select((-F.col("m.k")).alias("best"))
    return d.crossJoin(F.broadcast(best)).select("piece", "lines", (F.col("piece") == F.col("best")).alias("largest"))  # best: one row


def way_03_chains(spark, sf_dir):
    """Ways as their streets in order."""
    d = src.streets(spark, sf_dir).groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("okey", "line", "u", "v"))).alias("s"))
    return d.select("way_id", F.array_join(F.transform("s", lambda x: F.concat_ws("-", x["u"].cast("string"), x["v"].cast("string"))), ";").alias("chain"))


def set_01_union(spark, sf_dir):
    d = src.streets(spark, sf_dir).select("u", "v", "highway")
    c = src.lines(spark, sf_dir).select(F.col("line_id").alias("u"), F.col("pos").cast("long").alias("v"), F.lit("yes").alias("custom"))
    return d.unionByName(c, allowMissingColumns=True).groupBy("highway", "custom").agg(F.count("*").alias("n"), F.sum("u").alias("sum_u"))


def set_06_difference(spark, sf_dir):
    """Terminals (points) that are no nodes of the network."""
    return src.points(spark, sf_dir).select(F.col("point_id").alias("node_id")).subtract(src.nodes(spark, sf_dir).select("node_id"))


def set_07_dedupe(spark, sf_dir):
    """Of streets with one order key and line the last by way and start wins."""
    d = src.streets(spark, sf_dir)
    return d.groupBy("okey", "line").agg(F.max(F.struct("way_id", "u")).alias("s")).select("okey", "line", "s.way_id", "s.u")


def cov_03_crossed(spark, sf_dir, size: float = 25.0):
    """Grid cells that lines pass through, and how many segments of them."""
    xy = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    d = win_03_segments(spark, sf_dir).select("line_id", "pos", F.explode(geom.cells_along(*xy, size, 0.0)).alias("c"))
    return d.groupBy("c.cx", "c.cy").agg(F.count("*").alias("segments"))


def scl_16_turn_direction(spark, sf_dir):
    w = Window.partitionBy("line_id").orderBy("pos")
    d = win_03_segments(spark, sf_dir).withColumn("h", F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))))
    return d.withColumn("before", F.lag("h").over(w)).where("before is not null").select("line_id", geom.turn_direction(F.col("before"), F.col("h")).alias("turn"))


QUERIES = {f.__name__: f for f in (qgs_01, flt_12_separated, flt_22_effective_access, flt_24_usable_modes, flt_29_resolve_tags, flt_30_value_problems, agg_10_mode_counts, scl_03_listed_keys, scl_04_maxspeed, scl_05_car_speed, scl_06_duration, scl_07_direction, win_04_buckets, agg_13_week_speeds, jn_34_override, agg_07_degree, agg_09_line_length, agg_12_summary, win_01_ends, win_03_lengths, jn_09_crossings, jn_01_snap_nodes, jn_13_new_nodes, jn_18_integrity, grf_08_self_loops, grf_02_pieces, agg_06_largest, way_03_chains, set_01_union, set_06_difference, set_07_dedupe, cov_03_crossed, scl_16_turn_direction)}
