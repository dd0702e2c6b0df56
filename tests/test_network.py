"""The street-network queries against their SQL, and tag rules against truth tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from streetloom.catalogue import ORACLE_SQL, QUERIES
from streetloom.functions import geom, tags

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE_SQL)))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.sql(ORACLE_SQL[name]).df()[list(got.columns)]
    rows = lambda d: sorted(map(str, d.itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


CASES = [
    ({"highway": "residential"}, "drive;drive_service;walk;bike"),
    ({"highway": "motorway"}, "drive;drive_service"),
    ({"highway": "footway"}, "walk"),
    ({"highway": "footway", "bicycle": "designated"}, "walk;bike"),
    ({"highway": "cycleway"}, "bike"),
    ({"highway": "cycleway", "foot": "yes"}, "walk;bike"),
    ({"highway": "residential", "access": "no", "bicycle": "yes"}, "bike"),
    ({"highway": "residential", "motor_vehicle": "no"}, "walk;bike"),
    ({"highway": "pedestrian"}, "walk"),
    ({"highway": "pedestrian", "bicycle": "yes"}, "walk;bike"),
    ({"highway": "busway"}, ""),
    ({"highway": "primary", "motorroad": "yes"}, "drive;drive_service"),
    ({"route": "ferry"}, "drive;drive_service;walk;bike"),
    ({"route": "ferry", "motor_vehicle": "no"}, "walk;bike"),
    ({}, ""),
]


def test_usable_modes(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t map<string,string>")
    got = {r[0]: r[1] for r in d.select("i", F.array_join(tags.usable_modes(tags.from_map(F.col("t"))), ";")).collect()}
    assert got == {i: m for i, (_, m) in enumerate(CASES)}


def test_speeds_and_lists(spark):
    d = spark.createDataFrame([("50",), ("30 mph",), ("20 knots",), ("50;30 mph",), ("signals",), ("0",), (None,)], "v string")
    got = [r[0] for r in d.select(tags.maxspeed_kph(F.col("v"))).collect()]
    assert [round(x, 3) if x else x for x in got] == [50, 48.28, 37.04, 49.14, None, None, None]
    one = spark.range(1)
    assert one.select(tags.listed_keys(F.lit(" a; b,a ,;c"))).first()[0] == ["a", "b", "c"]
    assert [one.select(tags.duration_hours(F.lit(v))).first()[0] for v in ("01:30", "00:00:36", "x")] == [1.5, 0.01, None]
    turns = [one.select(geom.turn_direction(F.lit(a), F.lit(b))).first()[0] for a, b in ((0.0, 10.0), (0.0, 90.0), (0.0, -90.0), (10.0, -175.0))]
    assert turns == ["straight", "left", "right", "u_turn"]


def test_pieces_of_all_streets(spark):
    from streetloom.sources import derived

    root = {}

    def top(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    streets = derived.streets(spark, SF).select("okey", "u", "v").collect()
    for s in streets:
        a, b = sorted((top(s.u), top(s.v)))
        root[b] = a
    got = {r.node_id: r.piece for r in QUERIES["grf_02_pieces"](spark, SF).collect()}
    assert got == {n: top(n) for n in root}
