"""From a GeoJSON layer and OSM XML to OSM XML, through the command line."""

import json

import pytest

from streetloom.__main__ import main
from streetloom.api import PRESETS
from streetloom.sinks.files import write_osm_xml
from streetloom.sources.files import read_osm_xml

D = 0.001  # about 111 m north, 70 m east


def layer(path, rows):
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "id": str(i), "geometry": g and {"type": g[0], "coordinates": g[1]}, "properties": p} for i, (g, p) in enumerate(rows)]}))
    return str(path)


def test_build_alone(spark, tmp_path, capsys):
    custom = layer(tmp_path / "a.geojson", [(("LineString", [[-3.0, 51.0], [-3.0, 51 + 2 * D]]), {"maxspeed": "20 mph"}), (("LineString", [[-3 - D, 51 + D], [-3 + D, 51 + D]]), {"highway": "cycleway"})])
    out = str(tmp_path / "out.osm")
    assert main(["build", "--custom", custom, "--out", out, "--preset", "residential_street"]) == 0
    done = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (done["nodes"], done["edges"]) == (5, 4)
    back = read_osm_xml(spark, out)
    ways = {r.way_id: (len(r.refs), r.tags) for r in back.ways.collect()}
    assert ways == {1: (3, {"highway": "residential", "oneway": "no", "maxspeed": "20 mph"}), 2: (3, {"highway": "cycleway", "oneway": "no"})}
    assert any(abs(r.lat - 51 - D) < 1e-6 and abs(r.lon + 3) < 1e-6 for r in back.nodes.collect())


def test_build_on_existing_streets(spark, tmp_path, capsys):
    none = "node_id long, lon double, lat double, tags map<string,string>"
    nodes = spark.createDataFrame([(1, -3.0, 51.0, {"barrier": "gate"}), (2, -3.0, 51 + D, None), (3, -3.0, 51 + 3 * D, None), (4, -3.0, 51 + 5 * D, None), (5, -3.0, 51 + 6 * D, None)], none)
    ways = spark.createDataFrame([(10, [1, 2, 3, 99, 4, 5], {"highway": "residential", "name": "Row"})], "way_id long, refs array<long>, tags map<string,string>")
    osm, out = str(tmp_path / "in.osm"), str(tmp_path / "out.osm")
    write_osm_xml(nodes, ways, osm)
    custom = layer(tmp_path / "a.geojson", [(("LineString", [[-3 - D, 51 + 2 * D], [-3 + D, 51 + 2 * D]]), {"highway": "residential"})])
    assert main(["build", "--custom", custom, "--out", out, "--osm", osm]) == 0
    back = read_osm_xml(spark, out)
    got = {r.way_id: r for r in back.ways.collect()}
    assert set(got) == {10, 11, 12} and got[11].refs == [4, 5] and got[11].tags == got[10].tags and got[10].tags["name"] == "Row" and len(got[10].refs) == 4 and got[10].refs[:2] == [1, 2] and got[10].refs[3] == 3
    assert len(got[12].refs) == 3 and got[12].refs[1] == got[10].refs[2]
    assert {r.node_id: r.tags for r in back.nodes.collect()}[1] == {"barrier": "gate"}


def test_check_and_presets(spark, tmp_path, capsys):
    rows = [(("LineString", [[0, 0], [0, 1]]), {"highway": "path"}), (("LineString", [[0, 0], [0, 91]]), {"highway": "path", "lanes": "x"}), (("Polygon", [[[0, 0], [1, 1], [0, 1], [0, 0]]]), {}), (None, {}), (("LineString", [[0, 0], [0, 1]]), {})]
    assert main(["check", "--custom", layer(tmp_path / "b.geojson", rows)]) == 3
    events = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(e.get("feature"), e["problems"]) for e in events] == [("1", ["off the earth", "value of lanes"]), ("2", ["no line or point"]), ("3", ["no line or point"]), ("4", ["no mode may use it"]), (None, 4)]
    assert main(["build", "--custom", str(tmp_path / "b.geojson"), "--out", str(tmp_path / "o.osm")]) == 3
    assert main(["presets"]) == 0
    assert len([x for x in capsys.readouterr().out.splitlines() if '"preset"' in x]) == len(PRESETS) == 12
    with pytest.raises(SystemExit):
        main(["build"])


def test_relations_follow_their_ways(spark, tmp_path):
    """Way 10 falls apart at an unknown node: members move to the piece at the junction; what lost a member goes."""
    nodes = spark.createDataFrame([(i, -3.0 + (D if i == 6 else 0), 51 + D * i, None) for i in range(1, 7)], "node_id long, lon double, lat double, tags map<string,string>")
    ways = spark.createDataFrame([(10, [1, 2, 99, 3, 4, 5], {"highway": "residential"}), (11, [4, 6], {"highway": "residential"})], "way_id long, refs array<long>, tags map<string,string>")
    member = lambda *m: [{"type": t, "ref": r, "role": o} for t, r, o in m]
    rels = spark.createDataFrame([
        (1, {"type": "restriction", "restriction": "no_left_turn"}, member(("way", 10, "from"), ("node", 4, "via"), ("way", 11, "to"))),
        (2, {"type": "restriction", "restriction": "no_left_turn"}, member(("way", 10, "from"), ("node", 99, "via"), ("way", 11, "to"))),
        (3, {"type": "route", "route": "bus"}, member(("way", 10, ""), ("way", 77, ""))), (4, {"type": "multipolygon"}, member(("way", 10, "outer")))],
        "rel_id long, tags map<string,string>, members array<struct<type:string,ref:long,role:string>>")
    osm, out = str(tmp_path / "in.osm"), str(tmp_path / "out.osm")
    write_osm_xml(nodes, ways, osm, rels)
    custom = layer(tmp_path / "a.geojson", [(("LineString", [[-3 - D, 51 + 1.5 * D], [-3 + D, 51 + 1.5 * D]]), {"highway": "residential"})])
    assert main(["build", "--custom", custom, "--out", out, "--osm", osm]) == 0
    back = read_osm_xml(spark, out)
    refs = {r.way_id: r.refs for r in back.ways.collect()}
    assert refs[12] == [3, 4, 5] and refs[10][0] == 1 and refs[10][-1] == 2 and len(refs[10]) == 3
    got = {r.rel_id: [(m.type, m.ref, m.role) for m in r.members] for r in back.relations.collect()}
    assert got == {1: [("way", 12, "from"), ("node", 4, "via"), ("way", 11, "to")], 3: [("way", 10, ""), ("way", 12, "")]}
