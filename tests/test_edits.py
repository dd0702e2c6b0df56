"""Edits of existing ways on a small grid: tags, directions by drawing, removal, claims, problems."""

import pytest
from pyspark.sql import functions as F

from streetloom.operators import edits

XY = {1: (0, 0), 2: (100, 0), 3: (200, 0), 4: (300, 0), 5: (100, 100), 601: (150, 60), 602: (60, 60)}
WAYS = [(7, [1, 2, 3, 4], {"highway": "residential", "maxspeed": "30 mph"}), (8, [2, 5], {"highway": "primary", "oneway": "yes"}), (820, [2, 601, 602, 2], {"highway": "service"}), (9, [4, 5], {"highway": "tertiary", "junction": "roundabout"})]


@pytest.fixture(scope="module")
def net(spark):
    nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in XY.items()], "node_id long, x double, y double")
    ways = spark.createDataFrame(WAYS, "way_id long, refs array<long>, tags map<string,string>")
    rows = []
    for w, refs, t in WAYS:
        for a, b in zip(refs, refs[1:]):
            rows.append((len(rows), w, a, b, False, t))
            if t.get("oneway") != "yes" and "junction" not in t:
                rows.append((len(rows), w, b, a, True, t))
    return spark.createDataFrame(rows, "street_id long, way_id long, u long, v long, reversed boolean, tags map<string,string>"), nodes, ways


def run(spark, net, drawn, **kw):
    rows = [(n, f"f{n}", w, [{"x": float(x), "y": float(y)} for x, y in line], t, t.pop("remove", None), t.pop("remove_tags", None)) for n, (w, line, t) in enumerate(drawn)]
    e = spark.createDataFrame(rows, "number long, feature string, way_id long, line array<struct<x:double,y:double>>, tags map<string,string>, remove string, remove_tags string")
    d, change, issues = edits.apply_edits(*net, e, **kw)
    return {(r.way_id, r.u, r.v): r for r in d.collect()}, {r.number: r.change for r in change.collect()}, {(r.feature, r.message) for r in issues.collect()}


def test_tags_change_on_the_covered_stretch_only(spark, net):
    d, change, issues = run(spark, net, [(7, [(0, 0.5), (200, 0.5)], {"maxspeed": "20 mph", "highway": "residential", "remove_tags": "oneway, name"})])
    assert change == {0: {"maxspeed": "20 mph"}} and not issues
    assert {k for k, r in d.items() if r.modified} == {(7, 1, 2), (7, 2, 1), (7, 2, 3), (7, 3, 2)}
    assert d[7, 1, 2].tags == {"highway": "residential", "maxspeed": "20 mph"} and d[7, 3, 4].tags["maxspeed"] == "30 mph" and d[7, 1, 2].edit == 0


def test_deleted_tags_and_removal(spark, net):
    d, change, _ = run(spark, net, [(7, [(0, 0), (100, 0)], {"remove_tags": "maxspeed"}), (8, [(100, 0), (100, 100)], {"remove": "Yes", "maxspeed": "5"})])
    assert change == {0: {"maxspeed": None}, 1: {"remove": "yes"}}
    assert d[7, 1, 2].tags == {"highway": "residential"} and (8, 2, 5) not in d and (7, 2, 3) in d


@pytest.mark.parametrize("against", [False, True])
def test_oneway_follows_the_drawing(spark, net, against):
    line = [(100, 0), (150, 60), (60, 60), (100, 0)]
    d, change, _ = run(spark, net, [(820, line[::-1] if against else line, {"oneway": "yes"})])
    assert change == {0: {"oneway": "-1" if against else "yes"}}
    loop = [(2, 601), (601, 602), (602, 2)]
    assert {k[1:] for k in d if k[0] == 820} == {(b, a) if against else (a, b) for a, b in loop}
    assert not any(r.reversed for k, r in d.items() if k[0] == 820)


def test_oneway_to_both_and_bidirectional(spark, net):
    d, change, _ = run(spark, net, [(8, [(100, 100), (100, 0)], {"oneway": "no"}), (9, [(300, 0), (100, 100)], {"oneway": "yes", "name": "x"})])
    assert change == {0: {"oneway": "no"}, 1: {"name": "x"}}  # a roundabout is one-way already
    assert not d[8, 2, 5].reversed and d[8, 5, 2].reversed and d[8, 5, 2].tags["oneway"] == "no"
    d, _, _ = run(spark, net, [(7, [(0, 0), (100, 0)], {"oneway": "yes"})], bidirectional=True)
    assert (7, 2, 1) in d and d[7, 2, 1].tags["oneway"] == "yes"


def test_claims_and_problems(spark, net):
    d, change, issues = run(spark, net, [
        (7, [(0, 0), (100, 0)], {"maxspeed": "10"}), (7, [(0, 0), (200, 0)], {"maxspeed": "20"}), (7, [(0, 0.9), (300, 0.9)], {"maxspeed": "30"}),
        (99, [(0, 0), (1, 0)], {"maxspeed": "1"}), (8, [(0, 0), (100, 0)], {"maxspeed": "1"}), (8, [(100, 0), (100, 100)], {"oneway": "true"})])
    assert set(change) == {0, 2}
    assert d[7, 1, 2].tags["maxspeed"] == "10" and d[7, 3, 4].tags["maxspeed"] == "30"
    assert d[7, 2, 3].tags["maxspeed"] == "30 mph"  # it went to the edit that was withdrawn
    assert issues == {("f1", "overlaps feature f0 with a different change"), ("f3", "OSM way 99 is not in this network"), ("f4", "doesn't lie along OSM way 8"), ("f5", "changes nothing")}


def test_ids_and_words(spark):
    d = spark.createDataFrame([("1", "12", None), ("2", "w13", ""), ("3", None, None), ("4", "n5", "7"), ("5", "8", "W9"), ("6", "0", None)], "k string, osm_id string, osmid string")
    got = {r.k: (r.way_id, r.wrong_id) for r in edits.take_way_ids(d).collect()}
    assert got == {"1": (12, None), "2": (13, None), "3": (None, None), "4": (7, "osm_id=n5"), "5": (9, None), "6": (None, "osm_id=0")}
    d = spark.createDataFrame([("Yes",), (" 1",), ("no",), (None,), ("maybe",)], "v string")
    assert [r[0] for r in d.select(edits.wants_removal(F.col("v"))).collect()] == [True, True, False, False, None]
