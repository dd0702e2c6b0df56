"""Points (barriers, signals, crossings) put on nodes, or on new nodes that cut a street.

Tables: points (point_id, x, y, tags map, remove array<string>, layer), nodes (node_id, x, y), streets (street_id, u, v, tags map, length).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom
from .build import _near, numbered
from .graph import _written, pieces

#: Streets whose distances from a point differ by at most this (m) lie at the same place.
SAME_PLACE = 0.01
_EMPTY = "map<string,string>"


def nearest_node(points: DataFrame, nodes: DataFrame, tolerance: float) -> DataFrame:
    """(point_id, node_id): the nearest node within tolerance, the smallest id on a tie."""
    d = _near(points.select("point_id", "x", "y"), nodes.select("node_id", "x", "y"), tolerance)
    return d.groupBy("point_id").agg(F.min(F.struct("away", "b_node_id")).alias("m")).select("point_id", F.col("m.b_node_id").alias("node_id"))


def street_under(points: DataFrame, nodes: DataFrame, streets: DataFrame, tolerance: float) -> DataFrame:
    """(point_id, a, b, t, x, y, many, wrong_layer): the street under a point by its nodes a < b, and the point's place on it.

    many: how many streets lie there (of the point's layer, if it has one); wrong_layer: none has that layer.
    """
    n = nodes.select("node_id", "x", "y")
    d = streets.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.coalesce(F.trim(F.col("tags")["layer"]), F.lit("0")).alias("street_layer")).where("a <> b").distinct()
    d = d.join(n.toDF("a", "x1", "y1"), "a").join(n.toDF("b", "x2", "y2"), "b")
    size = max(tolerance * 4, 50.0)
    xy = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    d = d.withColumn("c", F.explode(geom.cells_along(*xy, size, tolerance))).select("*", "c.cx", "c.cy").drop("c")
    p = points.select("point_id", "layer", F.col("x").alias("px"), F.col("y").alias("py"), geom.cell(F.col("x"), size).alias("cx"), geom.cell(F.col("y"), size).alias("cy"))
    j = p.join(d, ["cx", "cy"]).withColumn("t", geom.place_on(F.col("px"), F.col("py"), *xy))
    j = j.withColumns({"x": F.col("x1") + F.col("t") * (F.col("x2") - F.col("x1")), "y": F.col("y1") + F.col("t") * (F.col("y2") - F.col("y1"))})
    j = j.withColumn("away", geom.distance(F.col("px"), F.col("py"), F.col("x"), F.col("y"))).where(F.col("away") <= tolerance)
    w = Window.partitionBy("point_id")
    j = j.withColumn("least", F.min("away").over(w)).where(F.col("away") <= F.col("least") + SAME_PLACE)
    j = j.withColumn("fits", F.col("layer").isNull() | (F.trim("layer") == F.col("street_layer")))
    best = F.min(F.when(F.col("fits"), F.struct("away", "a", "b", "t", "x", "y"))).alias("s")
    out = j.groupBy("point_id").agg(best, F.countDistinct(F.when(F.col("fits"), F.struct("a", "b"))).alias("many"))
    return out.select("point_id", "s.a", "s.b", "s.t", "s.x", "s.y", "many", (F.col("many") == 0).alias("wrong_layer"))


def _new_nodes(places: DataFrame, tolerance: float) -> DataFrame:
    """(point_id, owner): each place keeps its own node (owner is itself) or takes the nearest node that an earlier point made in reach.

    places: point_id, px, py (the point), x, y (where its node would go). Points that are in reach of one another's
    places are decided together, in order of their ids; others apart.
    """
    own = places.select("point_id", F.col("px").alias("x"), F.col("py").alias("y"))
    made = places.select(F.col("point_id").alias("other"), "x", "y")
    near = _written(_near(own, made, tolerance).select("point_id", F.col("b_other").alias("other"), "away").where("other < point_id"))
    group = pieces(near.select(F.col("point_id").alias("u"), F.col("other").alias("v")))
    near = near.join(group, near["point_id"] == group["node"]).select("piece", "point_id", "other", "away")

    def decide(table):
        owner = {}
        for p, t in table.sort_values("point_id").groupby("point_id"):
            free = t[[owner.get(o, o) == o for o in t.other]].sort_values(["away", "other"])
            owner[p] = int(free.other.iloc[0]) if len(free) else p
        return type(table)({"point_id": list(owner), "owner": list(owner.values())})

    decided = near.groupBy("piece").applyInPandas(decide, "point_id long, owner long")
    return places.select("point_id").join(decided, "point_id", "left").select("point_id", F.coalesce("owner", "point_id").alias("owner"))


def place_points(points: DataFrame, nodes: DataFrame, streets: DataFrame, first_new_id: int, existing: DataFrame, tolerance: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, streets, changes, issues) after the points, taken in order of point_id (a whole number).

    A point's tags go to the nearest node in reach; else the street under it is cut at a new node (ids from first_new_id
    in order), which later points in reach share. Streets between the same nodes are cut alike, their length shared out.
    existing: (node_id, tags) of known nodes. changes: (node_id, tags): values set, null for deleted ones. Nodes with
    changes have modified = yes if existing holds them, else custom = yes. Points whose tags clash still count, as issues.
    """
    points, streets = _written(points), _written(streets)
    on = _written(nearest_node(points, nodes, tolerance))
    rest = points.join(on, "point_id", "left_anti")
    lost = rest.where(F.size(F.coalesce("remove", F.array().cast("array<string>"))) > 0)
    under = _written(rest.join(lost.select("point_id"), "point_id", "left_anti").select("point_id", F.col("x").alias("px"), F.col("y").alias("py")).join(street_under(points, nodes, streets, tolerance), "point_id", "left"))
    cuts = under.where("many = 1")
    owner = _written(_new_nodes(cuts, tolerance))
    made = _written(numbered(cuts.join(owner.where("owner = point_id"), "point_id", "left_semi"), "point_id", first_new_id, "node_id"))
    at = on.union(owner.join(made.select(F.col("point_id").alias("owner"), "node_id"), "owner").select("point_id", "node_id"))

    # streets of a cut pair of nodes, in both directions, in pieces by the order of the cuts
    order = made.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("t", "node_id"))).alias("cut"))
    s = streets.withColumns({"lo": F.least("u", "v"), "hi": F.greatest("u", "v")}).join(order, (F.col("lo") == order["a"]) & (F.col("hi") == order["b"]), "left").drop("a", "b", "lo", "hi")
    inner = F.when(F.col("u") < F.col("v"), F.col("cut")).otherwise(F.reverse(F.transform("cut", lambda c: F.struct((1 - c["t"]).alias("t"), c["node_id"].alias("node_id")))))
    stops = F.concat(F.array(F.struct(F.lit(0.0).alias("t"), F.col("u").alias("node_id"))), F.coalesce(inner, F.array().cast("array<struct<t:double,node_id:bigint>>")), F.array(F.struct(F.lit(1.0).alias("t"), F.col("v").alias("node_id"))))
    s = s.withColumn("stops", stops).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("stops") - 1)))
    a, b = F.get("stops", F.col("k") - 1), F.get("stops", F.col("k"))
    cut = F.size("stops") > 2
    s = s.withColumns({"split": F.when(cut, "yes"), "length": F.when(cut, F.col("length") * (b["t"] - a["t"])).otherwise(F.col("length")), "u": a["node_id"], "v": b["node_id"]}).drop("stops", "cut", "k")

    # tags by node and key: the last point holds
    p = points.join(at, "point_id")
    before = existing.select(F.col("node_id").alias("n"), "tags").withColumnRenamed("tags", "was")
    sets = p.select("node_id", "point_id", F.explode("tags").alias("key", "value"), F.lit(0).alias("kind"))
    gone = p.join(before, F.col("node_id") == F.col("n"), "left").select("node_id", "point_id", F.explode("remove").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(1).alias("kind"), "was")
    first_set = sets.groupBy(F.col("node_id").alias("n2"), F.col("key").alias("k2")).agg(F.min("point_id").alias("since"))
    gone = gone.join(first_set, (F.col("node_id") == F.col("n2")) & (F.col("key") == F.col("k2")), "left")
    gone = gone.where(F.coalesce(F.map_contains_key("was", F.col("key")), F.lit(False)) | (F.col("since") < F.col("point_id"))).select("node_id", "point_id", "key", "value", "kind")
    each = _written(sets.union(gone))
    w = Window.partitionBy("node_id", "key").orderBy("point_id", "kind")
    clash = each.withColumns({"last": F.lag("value").over(w), "nth": F.row_number().over(w)}).where("kind = 0 and nth > 1 and not (last <=> value)")
    final = each.groupBy("node_id", "key").agg(F.max_by("value", F.struct("point_id", "kind")).alias("value"))
    changes = _written(final.groupBy("node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("tags")))

    known = existing.select(F.col("node_id").alias("n"), F.lit(True).alias("known")).distinct()
    out = nodes.select("node_id", "x", "y").unionByName(made.select("node_id", "x", "y"))
    out = out.join(changes.select(F.col("node_id").alias("c"), F.lit(True).alias("changed")), F.col("node_id") == F.col("c"), "left").join(known, F.col("node_id") == F.col("n"), "left")
    out = out.select("node_id", "x", "y", F.when(F.col("changed") & F.col("known"), "yes").alias("modified"), F.when(F.col("changed") & F.col("known").isNull(), "yes").alias("custom"))
    say = lambda t, m: t.select("point_id", m.alias("message"))
    text = F.col("many").cast("string")
    issues = (say(lost, F.lit("no node in reach to delete tags from")).union(say(under.where("many is null"), F.lit("not in reach of a street"))).union(say(under.where("wrong_layer"), F.lit("no street in reach has its layer")))
              .union(say(under.where("many > 1"), F.concat(F.lit("lies on "), text, F.lit(" streets: give it the street's layer"))))
              .union(say(clash, F.concat(F.lit("another point sets "), F.col("key"), F.lit(" otherwise on the same node"))))
              .union(say(at.join(each.select("point_id").distinct(), "point_id", "left_anti").join(changes, "node_id", "left_anti"), F.lit("changes nothing"))))
    return out, s, changes, issues
