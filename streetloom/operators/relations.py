"""Ways cut at junctions, relations rewritten onto the pieces, turn restrictions as paths and lines.

Tables: ways (way_id, refs array<long>, tags map), relations (rel_id, tags map, members array<struct<type, ref, role>>),
pieces (way_id, part, piece_id, refs): what each way was written as, in its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .edits import _parts, kept, point_at

#: So much of the streets before and after a restriction's junction is drawn (m).
REACH = 20.0
MEMBERS = "array<struct<type:string,ref:bigint,role:string>>"


def cut_at(ways: DataFrame, cuts: DataFrame) -> DataFrame:
    """Pieces of ways: (way_id, part, refs, tags). cuts: (a, b, node): ways that hold the step a-b or b-a are cut at node, wherever they pass it."""
    step = F.explode(F.transform(F.sequence(F.lit(0), F.size("refs") - 2), lambda i: F.struct(F.least(F.get("refs", i), F.get("refs", i + 1)).alias("a"), F.greatest(F.get("refs", i), F.get("refs", i + 1)).alias("b"))))
    steps = ways.where(F.size("refs") >= 2).select("way_id", step.alias("s")).distinct()
    c = cuts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "node")
    at = steps.join(c, (F.col("s.a") == c["a"]) & (F.col("s.b") == c["b"])).groupBy("way_id").agg(F.collect_set("node").alias("nodes"))
    d = ways.join(at, "way_id", "left")
    return d.select("way_id", F.posexplode(split_at("refs", F.coalesce("nodes", F.array().cast("array<bigint>")))).alias("part", "refs"), "tags")


def split_at(refs: str, nodes: Column) -> Column:
    """A list of refs cut at its inner places that hold one of nodes; a cut node ends one part and starts the next."""
    inner = F.filter(F.sequence(F.lit(1), F.greatest(F.size(refs), F.lit(2)) - 1), lambda i: (i < F.size(refs) - 1) & F.array_contains(nodes, F.get(refs, i)))
    starts, stops = F.concat(F.array(F.lit(0)), inner), F.concat(inner, F.array(F.size(refs) - 1))
    return F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda z: F.slice(refs, z["a"] + 1, z["b"] - z["a"] + 1))


def _with_parts(relations: DataFrame, ways: DataFrame, pieces: DataFrame, nodes: DataFrame) -> DataFrame:
    """relations with m: members in order, each way with its refs and parts, each node with whether it is written."""
    parts = pieces.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("part", F.col("piece_id").alias("id"), "refs"))).alias("parts"))
    held = ways.select(F.col("way_id").alias("w"), F.col("refs").alias("orig")).join(parts, F.col("w") == F.col("way_id"), "left")
    m = relations.select("rel_id", F.posexplode("members").alias("pos", "x")).select("rel_id", "pos", "x.*")
    m = m.join(held, (F.col("type") == "way") & (F.col("ref") == F.col("w")), "left")
    m = m.join(nodes.select(F.col("node_id").alias("n"), F.lit(True).alias("known")).distinct(), (F.col("type") == "node") & (F.col("ref") == F.col("n")), "left")
    one = F.struct("pos", "type", "ref", "role", F.coalesce("orig", F.array().cast("array<bigint>")).alias("orig"), F.coalesce("parts", F.array().cast("array<struct<part:int,id:bigint,refs:array<bigint>>>")).alias("parts"), F.coalesce("known", F.lit(False)).alias("known"))
    m = m.select("rel_id", one.alias("x")).groupBy("rel_id").agg(F.array_sort(F.collect_list("x")).alias("m"))
    return relations.join(m, "rel_id")


def _member(kind: str, ref: Column, role: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), ref.alias("ref"), role.alias("role"))


def _route(m: Column) -> Column:
    """Members of a route that are left, ways in all their pieces; null without any way."""
    put = F.flatten(F.transform(m, lambda x: F.when(x["type"] == "way", F.transform(x["parts"], lambda p: _member("way", p["id"], x["role"])))
                                .when((x["type"] == "node") & x["known"], F.array(_member("node", x["ref"], x["role"]))).otherwise(F.array().cast(MEMBERS))))
    return F.when(F.exists(put, lambda x: x["type"] == "way"), put)


def _restriction(m: Column) -> Column:
    """Members of a restriction on the pieces; null if one is gone or the via is broken.

    A from or to way means its piece at the junction, its own id first; a via way all its pieces in the order of travel.
    """
    via_nodes = F.transform(F.filter(m, lambda x: (x["type"] == "node") & (x["role"] == "via")), lambda x: x["ref"])
    via_ways = F.filter(m, lambda x: (x["type"] == "way") & (x["role"] == "via"))
    arrives = F.coalesce(F.get(F.filter(m, lambda x: (x["type"] == "way") & (x["role"] == "from")), F.lit(0))["orig"], F.array().cast("array<bigint>"))

    def via(x: Column) -> Column:
        p, last = x["parts"], F.size(x["parts"]) - 1
        joined = F.forall(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: (i > last) | (F.element_at(F.get(p, i - 1)["refs"], -1) == F.get(F.get(p, i)["refs"], F.lit(0))))
        head, tail = F.get(F.get(p, F.lit(0))["refs"], F.lit(0)), F.element_at(F.get(p, last)["refs"], -1)
        whole = (last >= 0) & joined & (head == F.get(x["orig"], F.lit(0))) & (tail == F.element_at(x["orig"], -1))
        turned = F.array_contains(arrives, tail) & ~F.array_contains(arrives, head)
        ids = F.transform(F.when(turned, F.reverse(p)).otherwise(p), lambda q: _member("way", q["id"], x["role"]))
        return F.when(F.coalesce(whole, F.lit(False)), ids)

    def end(x: Column) -> Column:
        beside = F.get(via_ways, F.when(x["role"] == "to", F.size(via_ways) - 1).otherwise(0))["orig"]
        at = F.when((F.size(via_nodes) > 0) | (F.size(via_ways) == 0), via_nodes).otherwise(F.array_intersect(x["orig"], beside))
        there = F.filter(x["parts"], lambda p: (F.size(F.array_except(at, p["refs"])) == 0) | ((F.size(via_nodes) == 0) & F.arrays_overlap(at, p["refs"])))
        some = F.when(F.size(at) > 0, there).when(F.size(x["parts"]) == 1, x["parts"]).otherwise(F.slice(x["parts"], 1, 0))
        own = F.when(F.exists(some, lambda p: p["id"] == x["ref"]), x["ref"]).otherwise(F.get(some, F.lit(0))["id"])
        return F.when(F.size(some) > 0, F.array(_member("way", own, x["role"])))

    put = F.transform(m, lambda x: F.when((x["type"] == "node") & x["known"], F.array(_member("node", x["ref"], x["role"]))).when((x["type"] == "way") & (x["role"] == "via"), via(x)).when(x["type"] == "way", end(x)))
    return F.when(F.forall(put, lambda x: x.isNotNull()), F.flatten(put))


def rewrite(relations: DataFrame, ways: DataFrame, pieces: DataFrame, nodes: DataFrame) -> DataFrame:
    """relations that still make sense on the pieces, with their members there. Routes keep what is left of them."""
    d = _with_parts(relations, ways, pieces, nodes)
    put = F.when(F.coalesce(F.col("tags")["type"] == "route", F.lit(False)), _route(F.col("m"))).otherwise(_restriction(F.col("m")))
    return d.withColumn("members", put).where("members is not null").drop("m")


def _side(refs: Column, junction: Column, arriving: bool) -> Column:
    """The longer stretch of a way from the junction, toward it if arriving; null under two nodes."""
    i = F.array_position(refs, junction).cast("int")
    before, after = F.slice(refs, 1, i), F.slice(refs, F.greatest(i, F.lit(1)), F.size(refs) - i + 1)
    long = F.size(before) >= F.size(after)
    out = F.when(long, before if arriving else F.reverse(before)).otherwise(F.reverse(after) if arriving else after)
    return F.when((i > 0) & (F.size(out) >= 2), out)


def restriction_paths(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """(rel_id, tags, from_way, via_node, via_ways, to_way, arrive, via, leave) of restrictions whose members meet; node ids in order of travel."""
    none = F.array().cast("array<bigint>")
    r = relations.where(F.col("tags")["type"] == "restriction")
    d = _with_parts(r, ways, ways.select("way_id", F.lit(0).alias("part"), F.col("way_id").alias("piece_id"), "refs").limit(0), ways.select(F.lit(None).cast("bigint").alias("node_id")).limit(0))
    pick = lambda kind, role: F.filter("m", lambda x: (x["type"] == kind) & (x["role"] == role))
    d = d.withColumns({"f": F.get(pick("way", "from"), F.lit(0)), "t": F.get(pick("way", "to"), F.lit(0)), "via_node": F.get(pick("node", "via"), F.lit(0))["ref"], "vias": pick("way", "via")})
    d = d.where((F.size("f.orig") > 0) & (F.size("t.orig") > 0) & F.forall("vias", lambda x: F.size(x["orig"]) > 0))
    first = F.get("vias", F.lit(0))["orig"]
    start = F.array_min(F.array_intersect(F.array(F.get(first, F.lit(0)), F.element_at(first, -1)), F.col("f.orig")))

    def onward(path: Column, x: Column) -> Column:
        refs, at = x["orig"], F.element_at(path, -1)
        return F.when(F.get(refs, F.lit(0)) == at, F.concat(path, F.slice(refs, 2, F.size(refs)))).when(F.element_at(refs, -1) == at, F.concat(path, F.slice(F.reverse(refs), 2, F.size(refs))))

    along = F.when((F.size("vias") > 0) & start.isNotNull(), F.aggregate("vias", F.array(start), onward))
    d = d.withColumn("via", F.when(F.col("via_node").isNotNull(), F.array("via_node")).otherwise(along)).where("via is not null")
    d = d.withColumns({"arrive": _side(F.col("f.orig"), F.get("via", F.lit(0)), True), "leave": _side(F.col("t.orig"), F.element_at("via", -1), False)})
    ids = F.when(F.col("via_node").isNull() | (F.size("vias") > 0), F.transform("vias", lambda x: x["ref"])).otherwise(none)
    return d.where("arrive is not null and leave is not null").select("rel_id", "tags", F.col("f.ref").alias("from_way"), "via_node", ids.alias("via_ways"), F.col("t.ref").alias("to_way"), "arrive", "via", "leave")


def restriction_lines(relations: DataFrame, ways: DataFrame, nodes: DataFrame, reach: float = REACH) -> DataFrame:
    """restriction_paths with line: the last `reach` metres before the junction, the via, the first metres after it, as points x, y."""
    paths = restriction_paths(relations, ways)
    xy = nodes.select(F.col("node_id").alias("n"), "x", "y")
    spots = paths.select("rel_id", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).alias("ids")) for k in ("arrive", "via", "leave")))).alias("p"))
    spots = spots.select("rel_id", "p.k", F.posexplode("p.ids").alias("pos", "id")).join(xy, F.col("id") == F.col("n"))
    drawn = spots.groupBy("rel_id").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.struct("pos", "x", "y")))), lambda s: F.struct(s["x"], s["y"])).alias(f"{k}_xy") for k in ("arrive", "via", "leave")))
    d = paths.join(drawn, "rel_id").where(" and ".join(f"size({k}_xy) = size({k})" for k in ("arrive", "via", "leave")))
    d = kept(kept(d, "a", _parts(F.col("arrive_xy"))), "l", _parts(F.col("leave_xy")))
    total = lambda p: F.element_at(p, -1)["start"] + F.element_at(p, -1)["length"]
    begin, stop = F.greatest(total(F.col("a")) - reach, F.lit(0.0)), F.least(total(F.col("l")), F.lit(float(reach)))
    end_of = lambda s: F.struct(s["x2"].alias("x"), s["y2"].alias("y"))
    head = F.concat(F.array(point_at(F.col("a"), begin)), F.transform(F.filter("a", lambda s: s["start"] + s["length"] > begin), end_of))
    tail = F.concat(F.transform(F.filter("l", lambda s: s["start"] + s["length"] < stop), end_of), F.array(point_at(F.col("l"), stop)))
    return d.withColumn("line", F.concat(head, F.slice("via_xy", 2, F.greatest(F.size("via_xy") - 1, F.lit(0))), tail)).drop("a", "l", "arrive_xy", "via_xy", "leave_xy")
