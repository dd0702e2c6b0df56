"""Edits of existing ways: which streets a drawn feature covers, what it changes, which feature a street goes to, the result.

Tables: streets (street_id, way_id, u, v, reversed, tags map), nodes (node_id, x, y), ways (way_id, refs array, tags map),
edits (number, feature, way_id, line array<struct<x,y>>, tags map, remove, remove_tags), one row a drawn part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom, tags
from .graph import _written, pieces

#: Two features are on the same stretch if their distances from it differ by at most this (m).
ON_FEATURE = 0.01
#: A feature runs along a stretch if their directions differ by at most this.
MAX_ANGLE = 45.0
REMOVED = "remove"
#: Attributes that may hold the id of the way that a feature edits.
ID_COLUMNS = ("osm_id", "osmid")


def way_id(value: Column) -> Column:
    """Struct of the id in 123 or w123 and whether the value is wrong; blank: neither."""
    text = F.trim(value.cast("string"))
    number = F.regexp_extract(text, r"^[wW]?0*([1-9]\d{0,17})$", 1)
    blank = text.isNull() | (text == "")
    return F.struct(F.when(number != "", F.nullif(number, F.lit("")).cast("long")).alias("id"), (~blank & (number == "")).alias("wrong"))


def take_way_ids(features: DataFrame, columns: tuple[str, ...] = ID_COLUMNS) -> DataFrame:
    """features with way_id in place of the id columns (the later one wins) and wrong_id: a value that is no way id."""
    there = [c for c in columns if c in features.columns]
    found = [way_id(F.col(f"`{c}`")) for c in there]
    ids = F.coalesce(*(f["id"] for f in reversed(found))) if there else F.lit(None).cast("long")
    wrong = F.coalesce(*(F.when(f["wrong"], F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("string"))) for c, f in zip(there, found))) if there else F.lit(None).cast("string")
    return features.withColumns({"way_id": ids, "wrong_id": wrong}).drop(*there)


def wants_removal(value: Column) -> Column:
    """True, false, or null for what is neither a yes nor a no."""
    text = F.coalesce(F.lower(F.trim(value)), F.lit(""))
    return F.when(text.isin("yes", "true", "1"), True).when(text.isin("no", "false", "0", ""), False)


def oneway_state(value: Column, junction: Column | None = None) -> Column:
    """forward, backward or both; a roundabout without a value is one-way by itself."""
    state = tags.direction(F.coalesce(value, F.lit("")))
    if junction is None:
        return state
    return F.when(value.isNull() & F.coalesce(junction.isin("roundabout", "circular"), F.lit(False)), "forward").otherwise(state)


def kept(d: DataFrame, name: str, value: Column) -> DataFrame:
    """d with a column whose expression is worked out once a row, not again wherever it is named later."""
    return d.select("*", F.explode(F.array(value)).alias(name))


def _parts(line: Column) -> Column:
    """Segments of a line: x1, y1, x2, y2, length, and how far along the line each starts."""
    def add(acc: Column, i: Column) -> Column:
        a, b = F.get(line, i), F.get(line, i + 1)
        length = geom.distance(a["x"], a["y"], b["x"], b["y"])
        one = F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"), length.alias("length"), acc["total"].alias("start"))
        return F.struct((acc["total"] + length).alias("total"), F.concat(acc["out"], F.array(one)).alias("out"))

    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double,length:double,start:double>>")
    return F.aggregate(F.sequence(F.lit(0), F.size(line) - 2), F.struct(F.lit(0.0).alias("total"), none.alias("out")), add, lambda acc: acc["out"])


def located(parts: Column, x: Column, y: Column) -> Column:
    """Struct of the distance of a place from a line and how far along the line the nearest point is (the first one on a tie)."""
    def one(s: Column) -> Column:
        t = geom.place_on(x, y, s["x1"], s["y1"], s["x2"], s["y2"])
        return F.struct(geom.distance(x, y, s["x1"] + t * (s["x2"] - s["x1"]), s["y1"] + t * (s["y2"] - s["y1"])).alias("away"), (s["start"] + t * s["length"]).alias("along"))
    return F.array_min(F.transform(parts, one))


def point_at(parts: Column, along: Column) -> Column:
    """The point so far along a line, as a struct x, y; past an end that end."""
    ahead = F.filter(parts, lambda s: s["start"] + s["length"] >= along)
    s = F.coalesce(F.get(ahead, F.lit(0)), F.element_at(parts, -1))
    t = F.when(s["length"] == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (along - s["start"]) / s["length"])))
    return F.struct((s["x1"] + t * (s["x2"] - s["x1"])).alias("x"), (s["y1"] + t * (s["y2"] - s["y1"])).alias("y"))


def heading(parts: Column, along: Column) -> Column:
    """Struct dx, dy from the point 1 m before to the point 1 m after a place along a line."""
    a, b = point_at(parts, F.greatest(along - 1, F.lit(0.0))), point_at(parts, along + 1)
    return F.struct((b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"))


def covered(streets: DataFrame, nodes: DataFrame, edits: DataFrame, tolerance: float) -> DataFrame:
    """(number, street_id, away): streets of an edit's way whose middle is in reach of its line and that run along it there."""
    n = nodes.select("node_id", "x", "y")
    edge = lambda pick, c: pick(F.transform("line", lambda p: p[c]))
    box = [edge(f, c).alias(f"{n}_{c}") for n, f in (("low", F.array_min), ("high", F.array_max)) for c in ("x", "y")]
    middle = [((F.col(f"{c}1") + F.col(f"{c}2")) / 2).alias(f"m{c}") for c in ("x", "y")]
    s = streets.select("street_id", "way_id", "u", "v").join(n.toDF("u", "x1", "y1"), "u").join(n.toDF("v", "x2", "y2"), "v").select("street_id", "way_id", "x1", "y1", "x2", "y2", *middle)
    # only streets whose middle is in the edit's box are measured
    inside = [F.col(f"m{c}").between(F.col(f"low_{c}") - tolerance, F.col(f"high_{c}") + tolerance) for c in ("x", "y")]
    d = edits.select("number", "way_id", "line", *box).join(s, "way_id").where(inside[0] & inside[1])
    d = kept(kept(d, "parts", _parts(F.col("line"))), "at", located(F.col("parts"), F.col("mx"), F.col("my"))).where(F.col("at.away") <= tolerance)
    d = kept(d, "h", heading(F.col("parts"), F.col("at.along"))).withColumns({"dx": F.col("x2") - F.col("x1"), "dy": F.col("y2") - F.col("y1")})
    dot = F.abs(F.col("h.dx") * F.col("dx") + F.col("h.dy") * F.col("dy"))
    size = F.sqrt((F.col("h.dx") ** 2 + F.col("h.dy") ** 2) * (F.col("dx") ** 2 + F.col("dy") ** 2))
    return d.where((size > 0) & (dot >= size * (math.cos(math.radians(MAX_ANGLE)) - 1e-9))).select("number", "street_id", F.col("at.away").alias("away"))


def way_steps(ways: DataFrame) -> DataFrame:
    """(way_id, u, v): each step of a way from node to node, once."""
    step = F.explode(F.transform(F.sequence(F.lit(0), F.size("refs") - 2), lambda i: F.struct(F.get("refs", i).alias("u"), F.get("refs", i + 1).alias("v"))))
    return ways.where(F.size("refs") >= 2).select("way_id", step.alias("s")).select("way_id", "s.u", "s.v").distinct()


def _along_way(streets: DataFrame, steps: DataFrame) -> DataFrame:
    """streets with along: whether u to v is a step of the way, else v to u; null if neither."""
    there = steps.select(F.col("way_id").alias("w1"), F.col("u").alias("a1"), F.col("v").alias("b1"), F.lit(True).alias("with"))
    back = steps.select(F.col("way_id").alias("w2"), F.col("u").alias("a2"), F.col("v").alias("b2"), F.lit(True).alias("against"))
    d = streets.join(there, (F.col("way_id") == F.col("w1")) & (F.col("u") == F.col("a1")) & (F.col("v") == F.col("b1")), "left")
    d = d.join(back, (F.col("way_id") == F.col("w2")) & (F.col("v") == F.col("a2")) & (F.col("u") == F.col("b2")), "left")
    return d.withColumn("along", F.when(F.col("with"), True).when(F.col("against"), False)).drop("w1", "a1", "b1", "with", "w2", "a2", "b2", "against")


def votes(streets: DataFrame, nodes: DataFrame, edits: DataFrame, steps: DataFrame, cover: DataFrame) -> DataFrame:
    """(number, along): whether each edit is drawn the way's own way. Every covered step votes: is its first quarter before its last."""
    n = nodes.select("node_id", "x", "y")
    d = cover.join(_along_way(streets, steps).where("along is not null").select("street_id", F.when(F.col("along"), F.col("u")).otherwise(F.col("v")).alias("a"), F.when(F.col("along"), F.col("v")).otherwise(F.col("u")).alias("b")), "street_id")
    d = d.select("number", "a", "b").distinct().join(kept(edits.select("number", "line"), "parts", _parts(F.col("line"))), "number")
    d = d.join(n.toDF("a", "x1", "y1"), "a").join(n.toDF("b", "x2", "y2"), "b")
    at = lambda t: located(F.col("parts"), F.col("x1") + t * (F.col("x2") - F.col("x1")), F.col("y1") + t * (F.col("y2") - F.col("y1")))["along"]
    return d.groupBy("number").agg((F.sum(F.signum(at(0.75) - at(0.25))) >= 0).alias("along"))


def changes(edits: DataFrame, ways: DataFrame, along: DataFrame) -> DataFrame:
    """(number, feature, way_id, change): tags that an edit sets (value) or deletes (null) on its way; remove: yes takes it out."""
    d = edits.join(ways.select("way_id", F.col("tags").alias("current")), "way_id").join(along, "number")
    now, own = F.col("current"), F.map_filter("tags", lambda k, v: v.isNotNull())
    state = oneway_state(own["oneway"])
    turned = F.when(F.col("along"), state).when(state == "forward", "backward").when(state == "backward", "forward").otherwise(state)
    moved = own["oneway"].isNotNull() & (turned != oneway_state(now["oneway"], now["junction"]))
    text = F.when(turned == "forward", "yes").when(turned == "backward", "-1").otherwise("no")
    sets = F.map_filter(own, lambda k, v: (k != "oneway") & ~v.eqNullSafe(now[k]))
    sets = F.when(moved, F.map_concat(sets, F.create_map(F.lit("oneway"), text))).otherwise(sets)
    gone = F.filter(F.coalesce(tags.listed_keys(F.col("remove_tags")), F.array().cast("array<string>")), lambda k: F.map_contains_key(now, k) & ~F.array_contains(F.map_keys(sets), k))
    gone = F.map_from_arrays(gone, F.transform(gone, lambda k: F.lit(None).cast("string")))
    out = F.when(F.coalesce(wants_removal(F.col("remove")), F.lit(False)), F.create_map(F.lit(REMOVED), F.lit("yes"))).otherwise(F.map_concat(sets, gone))
    return d.select("number", "feature", "way_id", out.alias("change"))


def _entries(change: Column) -> Column:
    """A map as a text that is equal where the maps are."""
    return F.to_json(F.array_sort(F.map_entries(change)), {"ignoreNullFields": "false"})


def claims(cover: DataFrame, change: DataFrame) -> DataFrame:
    """Every claim on a street by an edit that changes something: street_id, number, away, place among its claims, the first one's number,
    and clash: on the same stretch as the first one with another change."""
    d = cover.join(change.where(F.size("change") > 0).select("number", _entries(F.col("change")).alias("text")), "number")
    w = Window.partitionBy("street_id").orderBy("away", "number")
    d = d.withColumns({"place": F.row_number().over(w), "first": F.first("number").over(w), "near": F.first("away").over(w), "asked": F.first("text").over(w)})
    return d.select("street_id", "number", "away", "place", "first", ((F.col("away") - F.col("near") <= ON_FEATURE) & (F.col("text") != F.col("asked"))).alias("clash"))


def withdrawn(claimed: DataFrame) -> DataFrame:
    """(number, first): edits that go since an edit that stands claimed a street before them with another change.

    Clashes are taken nearest first, then by number; an edit that has gone clashes no more. Edits linked by clashes are
    decided together, others apart.
    """
    c = claimed.where("clash").select("number", "first", "away", "street_id")
    group = pieces(c.select(F.col("number").alias("u"), F.col("first").alias("v")))

    def decide(table):
        out = {}
        for t in table.sort_values(["away", "number", "street_id"]).itertuples():
            if t.number not in out and t.first not in out:
                out[t.number] = t.first
        return type(table)({"number": list(out), "first": list(out.values())})

    return c.join(group, c["number"] == group["node"]).groupBy("piece").applyInPandas(decide, "number long, first long")


def in_direction(stretch: DataFrame, steps: DataFrame) -> DataFrame:
    """Streets (with a column state) rebuilt along their way: forward or backward one row, both two, the second reversed."""
    kept = _along_way(stretch.where(~F.coalesce("reversed", F.lit(False))), steps)
    turn = F.col("along").eqNullSafe(False)
    d = kept.withColumns({"a": F.when(turn, F.col("v")).otherwise(F.col("u")), "b": F.when(turn, F.col("u")).otherwise(F.col("v"))})
    way = F.explode(F.when(F.col("state") == "both", F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.col("state") == "backward"))).alias("back")
    d = d.select("*", way)
    out = {"u": F.when(F.col("back"), F.col("b")).otherwise(F.col("a")), "v": F.when(F.col("back"), F.col("a")).otherwise(F.col("b")), "reversed": F.col("back") & (F.col("state") == "both")}
    return d.withColumns(out).select(*stretch.columns)


def apply_edits(streets: DataFrame, nodes: DataFrame, ways: DataFrame, edits: DataFrame, tolerance: float = 1.0, bidirectional: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(streets, changes, issues) after the edits.

    Changed streets have modified = yes and edit = the number of the edit that they went to; removed ones are gone. A
    changed oneway rebuilds a stretch, unless the network holds both directions anyway. issues: feature, message of
    edits whose way isn't there, that lie along none of it, that change nothing or contradict another. Streets without
    an edit stay as they are; null ways and empty tables give no changes.
    """
    streets, edits = _written(streets), _written(edits)
    steps = _written(way_steps(ways))
    known = edits.join(streets.select("way_id").distinct(), "way_id", "left_semi").join(ways.select("way_id"), "way_id", "left_semi")
    lost = edits.join(known.select("number"), "number", "left_anti")
    cover = _written(covered(streets, nodes, known, tolerance))
    beside = known.join(cover.select("number").distinct(), "number", "left_anti")
    change = _written(changes(known, ways, votes(streets, nodes, known, steps, cover)))
    claimed = _written(claims(cover, change))
    out = _written(withdrawn(claimed))
    stands = change.where(F.size("change") > 0).join(out, "number", "left_anti")
    owner = claimed.where("place = 1").select("street_id", "number").join(stands.select("number", "change"), "number")
    d = streets.join(owner, "street_id", "left").where(~F.coalesce(F.map_contains_key("change", F.lit(REMOVED)), F.lit(False)))
    text = F.coalesce("change", F.create_map().cast("map<string,string>"))
    was = F.map_filter("tags", lambda k, v: ~F.map_contains_key(text, k))
    put = F.map_concat(was, F.map_filter(text, lambda k, v: v.isNotNull()))
    d = _written(d.withColumns({"tags": put, "modified": F.when(F.col("number").isNotNull(), "yes"), "edit": F.col("number"),
                                "state": F.when(F.map_contains_key(text, F.lit("oneway")), oneway_state(put["oneway"], put["junction"]))}).drop("number", "change"))
    if not bidirectional:
        d = d.where("state is null").unionByName(in_direction(d.where("state is not null"), steps))
    say = lambda t, m: t.select("feature", m.alias("message"))
    other = edits.select(F.col("number").alias("first"), F.col("feature").alias("other"))
    issues = (say(lost, F.concat(F.lit("OSM way "), F.col("way_id").cast("string"), F.lit(" is not in this network")))
              .union(say(beside, F.concat(F.lit("doesn't lie along OSM way "), F.col("way_id").cast("string"))))
              .union(say(change.where(F.size("change") == 0), F.lit("changes nothing")))
              .union(say(out.join(edits.select("number", "feature"), "number").join(other, "first"), F.concat(F.lit("overlaps feature "), F.col("other").cast("string"), F.lit(" with a different change")))).distinct())
    return d.drop("state"), stands.select("number", "feature", "way_id", "change"), issues
