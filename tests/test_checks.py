"""Feature rules, error classes and the checks of a built network."""

import pytest
from pyspark.sql import functions as F

from streetloom.errors import DownloadError, InputError, IntegrityError, InvalidTagsError, StreetloomError
from streetloom.functions import features
from streetloom.operators import checks


def test_errors_and_exit_codes():
    e = InvalidTagsError([(float("nan"), "a"), ("f1", "b"), (None, "c")])
    assert isinstance(e, InputError) and isinstance(e, ValueError) and e.exit_code == 3
    assert e.issues == [{"feature": None, "message": "a"}, {"feature": "f1", "message": "b"}, {"feature": None, "message": "c"}]
    assert str(e) == "3 tag problem(s): feature None: a; feature f1: b; c"
    assert (StreetloomError("x").exit_code, DownloadError("x").exit_code, IntegrityError("x").exit_code) == (1, 4, 5)


def test_suggestions():
    known = ["highway", "maxspeed", "maxspeed:hgv", "oneway", "surface"]
    assert [features.suggest(w, known) for w in ("highway", "maxsp", "higway", "onewya", "zzz", "max")] == [None, "maxspeed", "highway", None, None, None]
    assert features.suggest("onewya", known, cutoff=0.7) == "oneway"


def test_edit_and_point_problems(spark):
    rows = [({"maxspeed": "20"}, "yes", ["name"]), ({"maxspeed": "20"}, "maybe", ["maxspeed", "highway"]), ({}, None, []), ({"highway": "residential", "barrier": "gate"}, "no", ["barrier"]), ({"highway": "stop"}, "", [])]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t map<string,string>, remove string, listed array<string>").orderBy("i")
    assert [r[0] for r in d.select(features.edit_problems(F.col("t"), F.col("remove"), F.col("listed"))).collect()] == [
        [], ["remove must be yes or no", "highway can't be deleted", "maxspeed is set and deleted"], [], ["barrier is set and deleted"], []]
    assert [r[0] for r in d.select(features.point_problems(F.col("t"), F.col("listed"))).collect()] == [
        [], ["maxspeed is set and deleted"], ["needs node tags"], ["highway is no value for a point", "barrier is set and deleted"], []]


def test_many_ids_are_named_in_short(spark):
    d = spark.createDataFrame([(list(range(12, 0, -1)),), ([3, 1],), ([],)], "ids array<long>")
    assert [r[0] for r in d.select(features.named(F.col("ids"))).collect()] == ["1, 2, 3, 4, 5, 6, 7, 8, 9, 10 and 2 more", "1, 3", ""]


def network(spark, extra=()):
    rows = [(1, 2, False, None), (2, 3, False, None), (3, 4, True, 1), (4, 5, True, 1), *extra]
    return spark.createDataFrame(rows, "u long, v long, custom boolean, line_id long"), spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 7)], "node_id long")


def test_a_sound_network_passes(spark):
    edges, nodes = network(spark)
    checks.check(edges, nodes)
    assert checks.broken_lines(edges) == (1, 1) and checks.outside_largest(edges).count() == 0
    checks.check(edges.limit(0), nodes.limit(0))


def test_faults_are_named(spark):
    edges, nodes = network(spark, [(6, 7, True, 2), (2, 2, False, None), (5, 99, True, 1)])
    with pytest.raises(IntegrityError) as e:
        checks.check(edges, nodes)
    assert [i["message"] for i in e.value.issues] == ["edges end at no node (1): 99", "edges end where they start (1): 2", "custom edges are not connected to the network (1): 6"]
    assert [(r.line_id, r.piece) for r in checks.outside_largest(edges).collect()] == [(2, 6)]
    assert checks.stranded(edges).collect()[0].u == 6
    alone = edges.where("custom")
    assert checks.broken_lines(alone) == (2, 2)
    broken, _ = network(spark, [(6, 7, True, 1)])
    assert checks.broken_lines(broken) == (2, 1)
