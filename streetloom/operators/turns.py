"""Turn restrictions drawn as lines: the junction or via street that a line passes, where it comes from and goes to.

Tables: turns (feature, line array<struct<x,y>>, tags map), nodes (node_id, x, y), streets (u, v).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom
from .edits import _parts, kept, located, point_at
from .graph import _written

# OpenStreetMap's turn restrictions and the turn that each names.
KEYS = ("restriction", "restriction:hgv", "restriction:bus", "restriction:motorcar", "restriction:bicycle")
EXCEPT = "except"
MEANS = {
    "no_left_turn": "left", "no_right_turn": "right", "no_straight_on": "straight", "no_u_turn": "u_turn",
    "only_left_turn": "left", "only_right_turn": "right", "only_straight_on": "straight", "only_u_turn": "u_turn",
}
VEHICLES = ("psv", "bus", "bicycle", "hgv", "motorcar", "motorcycle", "moped", "emergency", "taxi")
#: So far before and after the junction a line is looked at (m), less on a short line.
LOOK = 3.0


def turn_tags(own: Column) -> Column:
    """The turn tags of a feature with a value; empty if it has no restriction."""
    kept = F.map_filter(own, lambda k, v: k.isin(*KEYS, EXCEPT) & v.isNotNull() & (F.trim(v) != ""))
    kept = F.transform_values(kept, lambda k, v: F.trim(v))
    return F.when(F.exists(F.map_keys(kept), lambda k: k != EXCEPT), kept).otherwise(F.create_map().cast("map<string,string>"))


def problems(own: Column) -> Column:
    """Keys of a feature's turn tags whose value isn't one of OpenStreetMap's."""
    t = turn_tags(own)
    wrong = [F.when(t[k].isNotNull() & ~t[k].isin(*MEANS), F.lit(k)) for k in KEYS]
    other = F.when(F.exists(F.split(t[EXCEPT], ";"), lambda v: ~F.trim(v).isin(*VEHICLES)), F.lit(EXCEPT))
    return F.array_compact(F.array(*wrong, other))


def relation_tags(turn: Column) -> Column:
    """Tags of the relation that a turn is written as."""
    return F.map_concat(F.create_map(F.lit("type"), F.lit("restriction")), turn, F.create_map(F.lit("custom"), F.lit("yes")))


def junctions(turns: DataFrame, nodes: DataFrame, ends: DataFrame, tolerance: float) -> DataFrame:
    """(feature, passed): nodes with three neighbours or more that a line passes, away from its ends, in order along it."""
    degree = ends.groupBy("node").agg(F.count("*").alias("degree")).where("degree >= 3")
    size = max(tolerance * 4, 50.0)
    seg = turns.select("feature", "parts", F.explode("parts").alias("s"))
    seg = seg.select("feature", "parts", F.explode(geom.cells_along(F.col("s.x1"), F.col("s.y1"), F.col("s.x2"), F.col("s.y2"), size, tolerance)).alias("c")).select("feature", "parts", "c.cx", "c.cy").dropDuplicates(["feature", "cx", "cy"])
    n = nodes.join(degree, F.col("node_id") == F.col("node")).select("node_id", "x", "y", geom.cell(F.col("x"), size).alias("cx"), geom.cell(F.col("y"), size).alias("cy"))
    d = seg.join(n, ["cx", "cy"]).withColumn("at", located(F.col("parts"), F.col("x"), F.col("y"))).where(F.col("at.away") <= tolerance)
    first, last = F.get("parts", F.lit(0)), F.element_at("parts", -1)
    d = d.where((geom.distance(F.col("x"), F.col("y"), first["x1"], first["y1"]) > tolerance) & (geom.distance(F.col("x"), F.col("y"), last["x2"], last["y2"]) > tolerance))
    return d.groupBy("feature").agg(F.array_sort(F.collect_set(F.struct(F.col("at.along").alias("along"), "node_id"))).alias("passed"))


def street_between(walks: DataFrame, nodes: DataFrame, ends: DataFrame, tolerance: float) -> DataFrame:
    """(feature, path) from one junction to the other along a line, through nodes of two streets only; absent if there is none.

    walks: feature, parts, goal, path (the first junction). Each round takes every walk a node on; a node's place along
    the line grows with each step, so walks end.
    """
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"))
    xy = nodes.select("node_id", "x", "y")
    done, live = None, _written(walks)
    while not live.isEmpty():
        d = live.withColumn("here", F.element_at("path", -1)).join(ends.toDF("here", "other"), "here")
        d = d.join(xy.toDF("here", "hx", "hy"), "here").join(xy.toDF("other", "ox", "oy"), "other").join(degree.toDF("other", "degree"), "other")
        at = lambda x, y: located(F.col("parts"), x, y)
        middle = at((F.col("hx") + F.col("ox")) / 2, (F.col("hy") + F.col("oy")) / 2)
        d = d.where((at(F.col("ox"), F.col("oy"))["along"] > at(F.col("hx"), F.col("hy"))["along"]) & (middle["away"] <= tolerance))
        d = d.groupBy("feature", "parts", "goal", "path").agg(F.count("*").alias("n"), F.first("other").alias("other"), F.first("degree").alias("degree"))
        d = d.where("n = 1 and (other = goal or degree < 3)").select("feature", "parts", "goal", F.concat("path", F.array("other")).alias("path"))
        d = _written(d)
        ended = d.where(F.element_at("path", -1) == F.col("goal")).select("feature", "path")
        done = ended if done is None else done.union(ended)
        live = d.where(F.element_at("path", -1) != F.col("goal"))
    return done if done is not None else walks.select("feature", "path").limit(0)


def resolve_turns(turns: DataFrame, nodes: DataFrame, streets: DataFrame, tolerance: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(turns, issues): feature, path (junction or via street), from_node, to_node, tags, drawn, means; and features that can't be placed.

    drawn is the turn that the line makes, means the one that its tag names: where they differ the line may run the
    wrong way. Features without turn tags, and lines of one point, are left out. Empty tables give no rows.
    """
    ends = _written(streets.select("u", "v").union(streets.select("v", "u")).where("u <> v").distinct().toDF("node", "other"))
    t = turns.where(F.size("line") >= 2).select("feature", turn_tags(F.col("tags")).alias("tags"), _parts(F.col("line")).alias("parts")).where(F.size("tags") > 0)
    t = _written(t)
    found = _written(t.join(junctions(t, nodes, ends, tolerance), "feature", "left").withColumn("n", F.greatest(F.size("passed"), F.lit(0))))
    node = lambda i: F.get("passed", F.lit(i))["node_id"]
    two = street_between(found.where("n = 2").select("feature", "parts", node(1).alias("goal"), F.array(node(0)).alias("path")), nodes, ends, tolerance)
    paths = _written(found.where("n = 1").select("feature", F.array(node(0)).alias("path")).union(two))
    xy = nodes.select("node_id", "x", "y")
    d = t.join(paths, "feature").withColumns({"a": F.get("path", F.lit(0)), "b": F.element_at("path", -1)}).join(xy.toDF("a", "ax", "ay"), "a").join(xy.toDF("b", "bx", "by"), "b")
    end = F.element_at("parts", -1)
    total = end["start"] + end["length"]
    d = kept(kept(d, "come", located(F.col("parts"), F.col("ax"), F.col("ay"))["along"]), "go", located(F.col("parts"), F.col("bx"), F.col("by"))["along"])
    step = F.least(F.lit(LOOK), F.col("come") / 2, (total - F.col("go")) / 2)
    d = _written(d.withColumns({"before": point_at(F.col("parts"), F.col("come") - step), "after": point_at(F.col("parts"), F.col("go") + step)}))

    def nearest(probe: str, junction: str, beside: Column, name: str) -> DataFrame:
        """The neighbour of the junction, other than the via street's, whose street is nearest to the probe."""
        j = d.withColumn("beside", beside).join(ends.toDF(junction, "other"), junction).where(~F.coalesce(F.col("other") == F.col("beside"), F.lit(False)))
        j = j.join(xy.toDF("other", "ox", "oy"), "other")
        jx, jy, px, py = F.col(f"{junction}x"), F.col(f"{junction}y"), F.col(f"{probe}.x"), F.col(f"{probe}.y")
        s = geom.place_on(px, py, jx, jy, F.col("ox"), F.col("oy"))
        away = geom.distance(px, py, jx + s * (F.col("ox") - jx), jy + s * (F.col("oy") - jy))
        w = Window.partitionBy("feature").orderBy("away", "other")
        return j.select("feature", "other", away.alias("away")).withColumn("k", F.row_number().over(w)).where((F.col("k") == 1) & (F.col("away") <= tolerance)).select("feature", F.col("other").alias(name))

    via = F.size("path") > 1
    d2 = d.join(nearest("before", "a", F.when(via, F.get("path", F.lit(1))), "from_node"), "feature", "left").join(nearest("after", "b", F.when(via, F.element_at("path", -2)), "to_node"), "feature", "left")
    heading = lambda x1, y1, x2, y2: F.degrees(F.atan2(y2 - y1, x2 - x1))
    turn = geom.turn_direction(heading(F.col("before.x"), F.col("before.y"), F.col("ax"), F.col("ay")), heading(F.col("bx"), F.col("by"), F.col("after.x"), F.col("after.y")))
    value = F.coalesce(*(F.col("tags")[k] for k in KEYS))
    means = F.create_map(*(F.lit(v) for pair in MEANS.items() for v in pair))[value]
    d2 = _written(d2.select("feature", "path", "from_node", "to_node", "tags", F.when(~via & (F.col("from_node") == F.col("to_node")), "u_turn").otherwise(turn).alias("drawn"), means.alias("means")))
    say = lambda x, m: x.select("feature", m.alias("message"))
    issues = (say(found.where("n = 0"), F.lit("doesn't pass through a junction")).union(say(found.where("n > 2"), F.concat(F.lit("passes through "), F.col("n").cast("string"), F.lit(" junctions"))))
              .union(say(found.where("n = 2").join(two, "feature", "left_anti"), F.lit("passes through 2 junctions that no street along it joins")))
              .union(say(d2.where("from_node is null or to_node is null"), F.lit("doesn't follow a street on both sides of the junction"))))
    return d2.where("from_node is not null and to_node is not null"), issues
