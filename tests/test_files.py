"""Traffic rules, projection, and files read and written."""

import json
import math

import pytest
from pyspark.sql import functions as F

from streetloom.functions import projection, traffic
from streetloom.sinks.files import line_ways, write_osm_xml
from streetloom.sources import files


def test_days_times_rates(spark):
    rows = [("Mo-Fr", [1, 2, 3, 4, 5]), ("sa, SU", [0, 6]), ("Fr-Mo", [0, 1, 5, 6]), ("Mo-Su", list(range(7))), ("Su-Su", [0]), ("Mo-", None), ("Xx", None), ("", None), (None, None)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t, _ in rows], "t string").select(traffic.days(F.col("t"))).collect()]
    assert got == [d for _, d in rows]
    rows = [("07:00-09:30", (420, 570)), (" 22:00 - 06:00 ", (1320, 360)), ("00:00-24:00", (0, 0)), ("12:00-24:00", (720, 1440)), ("7:00-7:00", None), ("07:01-08:00", None), ("25:00-26:00", None), ("07:00", None), (None, None)]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame([(t,) for t, _ in rows], "t string").select(traffic.time_range(F.col("t"))).collect()]
    assert got == [d for _, d in rows]
    rows = [("0,6", None, (0.6, None)), (None, "25", (None, 25.0)), ("0.6", "25", None), (None, "", None), ("3", None, None), (None, "201", None), ("x", None, None)]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame([r[:2] for r in rows], "f string, s string").select(traffic.rate(F.col("f"), F.col("s"))).collect()]
    assert got == [r[2] for r in rows]
    rows = [(["Primary_link", "primary"], ["primary"]), (["all", "x"], ["all"]), (["x"], None), ([], None)]
    got = [r[0] for r in spark.createDataFrame([r[:1] for r in rows], "r array<string>").select(traffic.roads(F.col("r"))).collect()]
    assert got == [r[1] for r in rows]


def test_week_of_a_band(spark):
    d = spark.range(1).select(traffic.buckets(F.array(*map(F.lit, range(1, 6))), F.lit(420), F.lit(570)).alias("a"), traffic.buckets(F.array(F.lit(6)), F.lit(1320), F.lit(120)).alias("b"), traffic.buckets(F.array(F.lit(0)), F.lit(0), F.lit(0)).alias("c")).first()
    assert len(d.a) == 150 and 384 in d.a and sorted(d.b) == list(range(24)) + list(range(1992, 2016)) and d.c == list(range(288))


def test_projection(spark):
    places = [(0.0, 3.0), (45.0, 3.0), (51.5, 4.2), (-33.9, 5.9), (78.0, 0.1)]
    d = spark.createDataFrame(places, "lat double, lon double")
    x, y = projection.to_utm(F.col("lon"), F.col("lat"), 31)
    rows = d.select("lat", "lon", x.alias("x"), y.alias("y")).select("*", *(c.alias(n) for c, n in zip(projection.to_degrees(F.col("x"), F.col("y"), 31), ("lon2", "lat2")))).collect()
    assert rows[0].x == pytest.approx(500000) and rows[0].y == pytest.approx(0, abs=1e-6)
    assert rows[1].y == pytest.approx(4982950.400, abs=0.01)
    assert all(math.isclose(r.lat, r.lat2, abs_tol=1e-9) and math.isclose(r.lon, r.lon2, abs_tol=1e-9) for r in rows)
    assert [projection.zone(v) for v in (-180, -0.1, 0, 180)] == [1, 30, 31, 60]


def test_osm_xml_round_trip(spark, tmp_path):
    odd = 'a<b>&"c"\n\td\x01é'
    nodes = spark.createDataFrame([(2, 3.5, 50.25, {}), (1, 3.0, 50.0, {"barrier": "bollard", "name": odd}), (3, 4.0, 51.0, None)], "node_id long, lon double, lat double, tags map<string,string>")
    ways = spark.createDataFrame([(7, [1, 2, 9, 3, 2], {"highway": "residential"}), (8, [2, 3], {"highway": "footway"}), (9, [1, 3], {"waterway": "river"})], "way_id long, refs array<long>, tags map<string,string>")
    rels = spark.createDataFrame([(5, {"type": "restriction", "restriction": "no_left_turn"}, [("way", 7, "from"), ("node", 2, "via"), ("way", 8, "to")])], "rel_id long, tags map<string,string>, members array<struct<type:string,ref:long,role:string>>")
    for name in ("net.osm", "net"):
        path = str(tmp_path / name)
        write_osm_xml(nodes, ways, path, rels)
        back = files.read_osm_xml(spark, path)
        got = {r.node_id: (r.lon, r.lat, r.tags) for r in back.nodes.collect()}
        assert got == {1: (3.0, 50.0, {"barrier": "bollard", "name": odd.replace("\x01", "")}), 2: (3.5, 50.25, {}), 3: (4.0, 51.0, {})}
        assert {r.way_id: (r.refs, r.tags) for r in back.ways.collect()} == {r.way_id: (r.refs, r.tags) for r in ways.collect()}
        assert [tuple(m) for m in back.relations.first().members] == [("way", 7, "from"), ("node", 2, "via"), ("way", 8, "to")]
    text = (tmp_path / "net.osm").read_text()
    assert text.index('<bounds minlat="50.0000000"') < text.index('node id="1"') < text.index('node id="2"') < text.index('way id="7"') < text.index("<relation")
    assert sorted((r.way_id, r.pos, r.u, r.v) for r in files.steps(back).collect()) == [(7, 0, 1, 2), (7, 3, 3, 2), (8, 0, 2, 3)]
    assert sorted((r.way_id, r.pos) for r in files.steps(back, "drive").collect()) == [(7, 0), (7, 3)]
    assert sorted((r.way_id, r.run, r.refs) for r in files.known_runs(back).collect()) == [(7, 0, [1, 2]), (7, 1, [3, 2]), (8, 0, [2, 3]), (9, 0, [1, 3])]
    kept = back.relations.select(files.keeps_relation(lambda k: F.col("tags")[k], F.map_keys("tags"))).first()[0]
    assert kept is True


def test_geojson_and_settings(spark, tmp_path):
    layer = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": 4, "geometry": {"type": "LineString", "coordinates": [[0, 1], [2.5, 3]]}, "properties": {"highway": "path", "lanes": 2, "note": None}},
        {"type": "Feature", "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}, "properties": {"fid": "b"}},
        {"type": "Feature", "id": "p", "geometry": {"type": "Point", "coordinates": [9, 8]}, "properties": {}}, {"type": "Feature", "id": "n", "geometry": None, "properties": None}]}
    (tmp_path / "a.geojson").write_text(json.dumps(layer))
    got = [(r.feature_id, r.part, r.coords, r.attrs) for r in files.read_geojson(spark, str(tmp_path / "a.geojson")).collect()]
    assert got == [("4", 0, [[0.0, 1.0], [2.5, 3.0]], {"highway": "path", "lanes": "2"}), ("b", 0, [[0.0, 0.0], [1.0, 1.0]], {"fid": "b"}), ("b", 1, [[2.0, 2.0], [3.0, 3.0]], {"fid": "b"}), ("p", 0, [[9.0, 8.0]], {}), ("n", None, None, {})]
    (tmp_path / "b.toml").write_text('[[band]]\nname = "peak"\ndays = "Mo-Fr"\ntime = "07:00-09:30"\nroads = ["primary"]\nfactor = 0.6\n[[band]]\ntime = "22:00-06:00"\nroads = "all"\nspeed_kph = 25\n')
    got = [tuple(r) for r in files.read_bands(spark, str(tmp_path / "b.toml")).collect()]
    assert got == [("peak", [1, 2, 3, 4, 5], 420, 570, ["primary"], 0.6, None), ("Band 2", list(range(7)), 1320, 360, ["all"], None, 25.0)]
    (tmp_path / "c.json").write_text(json.dumps({"band": [{"time": "7", "roads": ["x"], "factor": 9, "when": 1}]}))
    with pytest.raises(files.InputError, match="time, roads, rate.*unknown setting when"):
        files.read_bands(spark, str(tmp_path / "c.json"))
    (tmp_path / "t.csv").write_text("osm_id,days,time,speed_kph,factor,direction\n7,,07:00-08:00,30,,\nx,Zz,07:00,30,0.5,up\n")
    good, bad = files.read_speed_table(spark, str(tmp_path / "t.csv")).collect()
    assert (good.way_id, good.days, good.start, good.speed, good.direction, good.problems) == (7, list(range(7)), 420, 30.0, "both", [])
    assert bad.problems == ["days", "time", "rate", "direction", "osm_id"]
    assert files.read_extent("-4,50,-3,51") == (-4, 50, -3, 51)
    for wrong in ("1,2,3", "3,0,1,1", "a,b,c,d"):
        with pytest.raises(files.InputError):
            files.read_extent(wrong)


def test_line_ways(spark):
    edges = spark.createDataFrame([(1, 0, 5, 6), (1, 1, 6, 7), (1, 3, 9, 8), (2, 0, 1, 2)], "line_id long, part int, u long, v long")
    tags = spark.createDataFrame([(1, {"highway": "path"}), (2, {"highway": "road"})], "line_id long, tags map<string,string>")
    assert [(r.way_id, r.refs, r.tags["highway"]) for r in line_ways(edges, tags).orderBy("way_id").collect()] == [(1, [5, 6, 7], "path"), (2, [9, 8], "path"), (3, [1, 2], "road")]
