"""Relations and restrictions through cuts, as paths and as lines, on a small grid."""

import pytest

from streetloom.operators import relations as rel

WAYS = [(1, [17, 18, 19]), (2, [18, 23]), (3, [23, 24, 25]), (4, [13, 18]), (5, [24, 29])]
XY = {17: (100, 300), 18: (200, 300), 19: (300, 300), 23: (200, 400), 24: (300, 400), 25: (400, 400), 13: (200, 200), 29: (300, 500)}


def m(*members):
    return [{"type": t, "ref": r, "role": o} for t, r, o in members]


RELATIONS = [
    (9001, {"type": "restriction", "restriction": "no_left_turn"}, m(("way", 1, "from"), ("node", 18, "via"), ("way", 2, "to"))),
    (9100, {"type": "restriction", "restriction": "no_u_turn"}, m(("way", 4, "from"), ("way", 2, "via"), ("way", 3, "to"))),
    (9200, {"type": "route"}, m(("way", 1, ""), ("way", 77, ""), ("node", 18, "stop"), ("node", 99, "stop"))),
    (9300, {"type": "restriction", "restriction": "no_left_turn"}, m(("way", 1, "from"), ("node", 99, "via"), ("way", 2, "to"))),
    (9400, {"type": "route"}, m(("node", 18, "stop"))),
    (9500, {"type": "restriction", "restriction": "no_u_turn"}, m(("way", 2, "from"), ("way", 3, "via"), ("way", 5, "to"))),
]


@pytest.fixture(scope="module")
def net(spark):
    ways = spark.createDataFrame([(i, r, {"highway": "residential"}) for i, r in WAYS], "way_id long, refs array<long>, tags map<string,string>")
    nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in XY.items()], "node_id long, x double, y double")
    return ways, nodes, spark.createDataFrame(RELATIONS, "rel_id long, tags map<string,string>, members array<struct<type:string,ref:long,role:string>>")


def rewritten(spark, net, pieces):
    ways, nodes, relations = net
    p = spark.createDataFrame(pieces, "way_id long, part int, piece_id long, refs array<long>")
    return {r.rel_id: [(x.type, x.ref, x.role) for x in r.members] for r in rel.rewrite(relations, ways, p, nodes).collect()}


def test_untouched_ways_keep_their_relations(spark, net):
    got = rewritten(spark, net, [(i, 0, i, r) for i, r in WAYS])
    assert got[9001] == [("way", 1, "from"), ("node", 18, "via"), ("way", 2, "to")]
    assert got[9200] == [("way", 1, ""), ("node", 18, "stop")] and set(got) == {9001, 9100, 9200, 9500}


def test_pieces_at_the_junction(spark, net):
    pieces = [(1, 0, 1, [17, 18]), (1, 1, 1001, [18, 19]), (2, 0, 2, [18, 50]), (2, 1, 1002, [50, 23]), (3, 0, 3, [23, 24]), (3, 1, 1003, [24, 25]), (4, 0, 4, [13, 18]), (5, 0, 5, [24, 29])]
    got = rewritten(spark, net, pieces)
    assert got[9001] == [("way", 1, "from"), ("node", 18, "via"), ("way", 2, "to")]
    assert got[9100] == [("way", 4, "from"), ("way", 2, "via"), ("way", 1002, "via"), ("way", 3, "to")]
    assert got[9200] == [("way", 1, ""), ("way", 1001, ""), ("node", 18, "stop")]
    broken = rewritten(spark, net, [p for p in pieces if p[2] != 1002])
    assert set(broken) == {9001, 9200}
    gone = rewritten(spark, net, [p for p in pieces if p[0] != 1])
    assert set(gone) == {9100, 9500}


def test_paths_and_lines(spark, net):
    ways, nodes, relations = net
    got = {r.rel_id: r for r in rel.restriction_lines(relations, ways, nodes).collect()}
    assert set(got) == {9001, 9100}
    r = got[9001]
    assert (r.from_way, r.via_node, list(r.via_ways), r.to_way, r.arrive, r.via, r.leave) == (1, 18, [], 2, [17, 18], [18], [18, 23])
    assert [(p.x, p.y) for p in r.line] == [(180, 300), (200, 300), (200, 320)]
    r = got[9100]
    assert (list(r.via_ways), r.arrive, r.via, r.leave) == ([2], [13, 18], [18, 23], [23, 24, 25])
    assert [(p.x, p.y) for p in r.line] == [(200, 280), (200, 300), (200, 400), (220, 400)]
    assert rel.restriction_lines(relations.limit(0), ways, nodes).count() == 0


def test_cuts(spark, net):
    cuts = spark.createDataFrame([(18, 17, 18), (23, 24, 24), (5, 6, 5)], "a long, b long, node long")
    got = sorted((r.way_id, r.part, r.refs) for r in rel.cut_at(net[0], cuts).collect())
    assert got == [(1, 0, [17, 18]), (1, 1, [18, 19]), (2, 0, [18, 23]), (3, 0, [23, 24]), (3, 1, [24, 25]), (4, 0, [13, 18]), (5, 0, [24, 29])]
