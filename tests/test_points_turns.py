"""Points and drawn turns on a grid of 100 m with a street node half way."""

import pytest
from pyspark.sql import functions as F

from streetloom.operators import points, turns

XY = {1 + r * 3 + c: (100.0 * c, 100.0 * r) for r in range(3) for c in range(3)} | {20: (150.0, 100.0), 30: (50.0, -50.0), 31: (50.0, 150.0)}
PAIRS = [(1, 2), (2, 3), (4, 5), (5, 20), (20, 6), (7, 8), (8, 9), (1, 4), (4, 7), (2, 5), (5, 8), (3, 6), (6, 9)]


@pytest.fixture(scope="module")
def net(spark):
    nodes = spark.createDataFrame([(i, x, y) for i, (x, y) in XY.items()], "node_id long, x double, y double")
    rows = [(k, a, b, {"highway": "residential"}, 100.0) for k, (a, b) in enumerate(PAIRS)] + [(100 + k, b, a, {"highway": "residential"}, 100.0) for k, (a, b) in enumerate(PAIRS)]
    rows.append((500, 30, 31, {"highway": "primary", "layer": "1"}, 200.0))
    return nodes, spark.createDataFrame(rows, "street_id long, u long, v long, tags map<string,string>, length double")


def placed(spark, net, rows):
    p = spark.createDataFrame([(i, float(x), float(y), t, r, lay) for i, (x, y, t, r, lay) in enumerate(rows)], "point_id long, x double, y double, tags map<string,string>, remove array<string>, layer string")
    known = spark.createDataFrame([(i, {"barrier": "bollard"} if i == 3 else {}) for i in range(1, 10)], "node_id long, tags map<string,string>")
    n, s, c, issues = points.place_points(p, *net, 1000, known)
    return {r.node_id: r for r in n.collect()}, s.collect(), {r.node_id: r.tags for r in c.collect()}, sorted((r.point_id, r.message) for r in issues.collect())


def test_points_on_nodes_and_streets(spark, net):
    n, s, c, issues = placed(spark, net, [(0.4, 0.4, {"barrier": "gate"}, None, None), (130, 0.5, {"highway": "crossing"}, None, None), (130.6, 0, {"crossing": "marked"}, None, None), (170, 0, {"barrier": "gate"}, None, None),
                                          (200, 0, {}, ["barrier", "name"], None), (20, 50, {"barrier": "gate"}, None, None), (60, 0, {}, ["barrier"], None)])
    assert c == {1: {"barrier": "gate"}, 1000: {"highway": "crossing", "crossing": "marked"}, 1001: {"barrier": "gate"}, 3: {"barrier": None}}
    assert (n[1000].x, n[1000].y, n[1000].custom, n[1000].modified) == (130, 0, "yes", None) and n[1].modified == "yes" and n[2].modified is None
    cut = sorted((r.u, r.v, round(r.length, 6)) for r in s if r.split)
    assert cut == sorted([(2, 1000, 30), (1000, 1001, 40), (1001, 3, 30), (3, 1001, 30), (1001, 1000, 40), (1000, 2, 30)])
    assert len(s) == 27 - 2 + 6
    assert issues == [(5, "not in reach of a street"), (6, "no node in reach to delete tags from")]


def test_layers_clashes_and_nothing(spark, net):
    n, s, c, issues = placed(spark, net, [(50, 0, {"barrier": "gate"}, None, None), (50, 100, {"barrier": "gate"}, None, "1"), (50, 100, {"barrier": "lift_gate"}, None, "1"), (100, 100, {}, ["name"], None), (50, 0, {"barrier": "x"}, None, "7")])
    assert c == {1000: {"barrier": "lift_gate"}} and (n[1000].x, n[1000].y) == (50, 100)
    assert sorted((r.u, r.v) for r in s if r.split) == [(30, 1000), (1000, 31)]
    assert issues == [(0, "lies on 2 streets: give it the street's layer"), (2, "another point sets barrier otherwise on the same node"), (3, "changes nothing"), (4, "no street in reach has its layer")]
    n, s, c, issues = placed(spark, net, [(50, 0, {"barrier": "gate"}, None, "0")])
    assert c == {1000: {"barrier": "gate"}} and len(s) == 27 + 2 and not issues


def resolved(spark, net, lines):
    t = spark.createDataFrame([(f"t{i}", [{"x": float(x), "y": float(y)} for x, y in line], tags) for i, (line, tags) in enumerate(lines)], "feature string, line array<struct<x:double,y:double>>, tags map<string,string>")
    d, issues = turns.resolve_turns(t, net[0], net[1].where("u <> 30").select("u", "v"))
    return {r.feature: r for r in d.collect()}, dict((r.feature, r.message) for r in issues.collect())


def test_turns(spark, net):
    left, no = {"restriction": "no_left_turn"}, {"restriction:hgv": "no_right_turn", "except": " bus", "name": "x"}
    d, issues = resolved(spark, net, [
        ([(100, 60), (100, 100), (60, 100)], left), ([(100, 60), (100, 100), (60, 100)], no), ([(60, 100), (100, 100), (200, 100), (200, 140)], left), ([(10, 50), (40, 50)], left),
        ([(-50, 0), (250, 0)], left), ([(100, 60), (100, 100), (120, 120)], left), ([(100, 60), (100, 100), (100, 60)], {"restriction": "no_u_turn"}), ([(0, 0), (1, 1)], {"name": "x"}), ([(100, -50), (100, 250)], left)])
    assert (d["t0"].path, d["t0"].from_node, d["t0"].to_node, d["t0"].drawn, d["t0"].means) == ([5], 2, 4, "left", "left")
    assert d["t1"].tags == {"restriction:hgv": "no_right_turn", "except": "bus"} and (d["t1"].drawn, d["t1"].means) == ("left", "right")
    assert (d["t2"].path, d["t2"].from_node, d["t2"].to_node) == ([5, 20, 6], 4, 9)
    assert d["t6"].drawn == "u_turn" and d["t6"].from_node == d["t6"].to_node == 2
    assert (d["t4"].path, d["t4"].from_node, d["t4"].to_node, d["t4"].drawn, d["t4"].means) == ([2], 1, 3, "straight", "left")
    assert set(d) == {"t0", "t1", "t2", "t4", "t6"}
    assert issues == {"t3": "doesn't pass through a junction", "t5": "doesn't follow a street on both sides of the junction", "t8": "passes through 3 junctions"}


def test_turn_tags(spark):
    rows = [({"restriction": "no_left_turn", "except": "bus; hgv"}, []), ({"restriction": "no_turn"}, ["restriction"]), ({"restriction:bus": "only_u_turn", "except": "cat;bus"}, ["except"]), ({"except": "cat"}, []), ({}, [])]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t map<string,string>")
    assert [r.p for r in d.orderBy("i").select(turns.problems(F.col("t")).alias("p")).collect()] == [w for _, w in rows]
    assert d.orderBy("i").select(turns.relation_tags(turns.turn_tags(F.col("t")))).first()[0] == {"type": "restriction", "restriction": "no_left_turn", "except": "bus; hgv", "custom": "yes"}
