"""The network build on a five by five grid of streets, and on lines alone."""

import pytest

from streetloom.operators.build import build

EXISTING = [(1 + r * 5 + c, c * 100.0, r * 100.0) for r in range(5) for c in range(5)]
PAIRS = [(i, i + 1) for i, x, _ in EXISTING if x < 400] + [(i, i + 5) for i, _, y in EXISTING if y < 400]


def run(spark, lines, grid=True, flags=None, **more):
    flags = flags or {}
    rows = [(i, k, float(x), float(y), *flags.get(i, (False, 0))) for i, line in enumerate(lines) for k, (x, y) in enumerate(line)]
    d = spark.createDataFrame(rows, "line_id long, pos int, x double, y double, separated boolean, layer int")
    if grid:
        more["nodes"] = spark.createDataFrame(EXISTING, "node_id long, x double, y double")
        more["edges"] = spark.createDataFrame([(k, u, v, False, 0) for k, (u, v) in enumerate(PAIRS)], "edge_id long, u long, v long, separated boolean, layer int")
    nodes, edges = build(d, **more)
    return {r.node_id: (r.x, r.y) for r in nodes.collect()}, [r.asDict() for r in edges.collect()]


def test_road_across_joins_five_streets(spark):
    nodes, edges = run(spark, [[(-50, 150), (450, 150)]])
    mine = [e for e in edges if e["custom"]]
    assert len(nodes) == 25 + 7 and min(set(nodes) - {i for i, _, _ in EXISTING}) == 26
    assert [e["part"] for e in sorted(mine, key=lambda e: e["part"])] == list(range(6)) and sum(e["length"] for e in mine) == pytest.approx(500)
    assert len([e for e in edges if not e["custom"]]) == len(PAIRS) + 5
    assert all(e["u"] in nodes and e["v"] in nodes for e in edges)


def test_diagonal_moves_onto_nodes(spark):
    nodes, edges = run(spark, [[(200.5, 200), (300, 300)]])
    assert [(e["u"], e["v"]) for e in edges if e["custom"]] == [(13, 19)] and len(nodes) == 25


def test_drawn_along_a_street(spark):
    _, edges = run(spark, [[(0, 0), (200, 0)]])
    assert sorted((e["u"], e["v"]) for e in edges if e["custom"]) == [(1, 2), (2, 3)]


def test_bridge_shares_no_node_with_the_streets_below(spark):
    nodes, edges = run(spark, [[(-50, 150), (450, 150)]], flags={0: (True, 1)})
    assert len(nodes) == 27 and len([e for e in edges if e["custom"]]) == 1


LOOP = [(300, 300), (400, 400), (400, 350), (300, 350)]
BRIDGE, CROSS = [(0, 30), (50, 30), (90, 30)], [[(0, 50), (100, 50)], [(50, 0), (50, 100)]]
#: name: lines, flags (separated, layer) of the lines, nodes, edges.
ALONE = {
    "loop": ([LOOP], {}, 5, 5), "loop on a bridge": ([LOOP], {0: (True, 0)}, 4, 3),
    "cross": (CROSS, {}, 5, 4), "cross on two layers": (CROSS, {1: (False, 1)}, 4, 2),
    "end under a bridge": ([BRIDGE, [(50, 0), (50, 30)]], {0: (True, 1)}, 4, 3),
    "road under a bridge": ([BRIDGE, [(50, 0), (50, 30), (50, 90)]], {0: (True, 1)}, 6, 4),
    "ends nearly meet": ([[(0, 0), (100, 0)], [(100.5, 0), (200, 0)]], {}, 3, 2),
    "three times the same": ([[(0, 0), (100, 0)]] * 3, {}, 2, 3),
    "one place": ([[(7, 7), (7, 7)]], {}, 0, 0), "no number": ([[(5, 5), (float("nan"), 5)]], {}, 0, 0),
    "three at one crossing": ([[(0, 0), (99, 99)], [(0, 99), (99, 0)], [(50, 0), (49, 99)]], {}, 7, 6),
}


@pytest.mark.parametrize("join_at", ["crossings", "vertices"])
def test_lines_alone(spark, join_at):
    lines, flags, home = [], {}, {}
    for k, (name, (group, own, _, _)) in enumerate(ALONE.items()):
        for i, line in enumerate(group):
            if i in own:
                flags[len(lines)] = own[i]
            home[len(lines)] = name
            lines.append([(x + k * 5000, y) for x, y in line])
    nodes, edges = run(spark, lines, grid=False, flags=flags, join_at=join_at)
    got = {name: [0, 0] for name in ALONE}
    for x, _ in nodes.values():
        got[list(ALONE)[int(x // 5000)]][0] += 1
    for e in edges:
        got[home[e["line_id"]]][1] += 1
    want = {name: [n, m] for name, (_, _, n, m) in ALONE.items()}
    if join_at == "vertices":
        want |= {"loop": [4, 3], "cross": [4, 2], "three at one crossing": [6, 3]}
    assert got == want
    assert sorted(nodes) == list(range(len(nodes)))


def test_nothing_tiny_and_wrong(spark):
    assert run(spark, [], grid=False) == ({}, [])
    assert len(run(spark, [[(0, 0), (0.2, 0)]])[0]) == 25
    with pytest.raises(ValueError):
        run(spark, [], grid=False, join_at="streets")


def test_pieces_by_star_steps(spark):
    import random

    from streetloom.operators.graph import pieces

    rng = random.Random(3)
    e = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(20)] + [(None, 1), (300, 300)]
    d = spark.createDataFrame(e, "u long, v long")
    up = {x: x for p in e if None not in p for x in p}
    for _ in up:
        for a, b in e:
            if a is not None:
                up[a] = up[b] = min(up[a], up[b])
    for limit in (0, 10**6):
        assert {r.node: r.piece for r in pieces(d, limit).collect()} == up
    assert pieces(d.limit(0)).count() == 0
