"""A routable network out of drawn lines, alone or joined to existing nodes and edges.

Lines come as vertices: line_id, pos, x, y, and per line separated (bridge, tunnel, motorway, ferry) and layer.
Joins go by grid cells that a segment passes through, so their size follows the length drawn, not the area spanned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom
from .graph import _written, pieces

#: Two places at most this far apart (m) are one; a point this close to a segment lies on it.
SAME = 1e-6
#: Segments a block of crossing_counts (48 bytes each); a task holds two blocks.
BLOCK_ROWS = 4_000


def clean(lines: DataFrame) -> DataFrame:
    """Vertices of lines without null or infinite coordinates and repeats, renumbered, with is_end; lines of one vertex go."""
    w = Window.partitionBy("line_id").orderBy("pos")
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("x", "y")]
    d = lines.where(ok[0] & ok[1]).withColumns({"lx": F.lag("x").over(w), "ly": F.lag("y").over(w)})
    d = d.where("lx is null or lx <> x or ly <> y").drop("lx", "ly")
    d = d.withColumns({"k": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("line_id"))}).where("n >= 2")
    return d.withColumns({"pos": F.col("k"), "is_end": (F.col("k") == 0) | (F.col("k") == F.col("n") - 1)}).drop("k", "n")


def _near(a: DataFrame, b: DataFrame, reach: float) -> DataFrame:
    """Pairs of a and b (columns b_*) at most reach apart, with away."""
    size = max(reach, SAME) * 2
    a = a.withColumn("_cx", F.explode(F.sequence(geom.cell(F.col("x") - reach, size), geom.cell(F.col("x") + reach, size))))
    a = a.withColumn("_cy", F.explode(F.sequence(geom.cell(F.col("y") - reach, size), geom.cell(F.col("y") + reach, size))))
    b = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns), geom.cell(F.col("x"), size).alias("_cx"), geom.cell(F.col("y"), size).alias("_cy"))
    d = a.join(b, ["_cx", "_cy"]).withColumn("away", geom.distance(F.col("x"), F.col("y"), F.col("b_x"), F.col("b_y")))
    return d.where(F.col("away") <= reach).drop("_cx", "_cy")


def gather(points: DataFrame, reach: float, other_lines: bool) -> DataFrame:
    """(x, y, nx, ny) of the places that move: to the first (by rank, line_id, pos) of all that a chain of steps within reach links.

    With other_lines, two places of one and the same line don't link by themselves. Equal places count once, however often they occur.
    """
    spots = _written(points.groupBy("x", "y").agg(F.min(F.struct("rank", "line_id", "pos")).alias("id"), F.min("line_id").alias("low"), F.max("line_id").alias("high")))
    d = _near(spots, spots, reach).where("id < b_id")
    if other_lines:
        d = d.where("not (low = high and b_low = b_high and low = b_low)")
    group = pieces(d.select(F.col("id").alias("u"), F.col("b_id").alias("v"))).where("node <> piece")
    first = spots.select(F.col("id").alias("piece"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    return _written(group.join(first, "piece").join(spots.select(F.col("id").alias("node"), "x", "y"), "node").select("x", "y", "nx", "ny"))


def _moved(d: DataFrame, moves: DataFrame, only: Column | None = None) -> DataFrame:
    cond = F.lit(True) if only is None else only
    d = d.join(moves, ["x", "y"], "left")
    put = cond & F.col("nx").isNotNull()
    return d.withColumns({"x": F.when(put, F.col("nx")).otherwise(F.col("x")), "y": F.when(put, F.col("ny")).otherwise(F.col("y"))}).drop("nx", "ny")


def segments(vertices: DataFrame) -> DataFrame:
    """Each vertex with the next of its line: x1, y1, x2, y2."""
    w = Window.partitionBy("line_id").orderBy("pos")
    return vertices.select("line_id", "pos", "separated", "layer", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null")


def _by_cell(s: DataFrame, size: float, pad: float) -> DataFrame:
    return s.withColumn("_c", F.explode(geom.cells_along(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), size, pad))).select("*", "_c.*").drop("_c")


def crossings(segs: DataFrame, size: float = 100.0) -> DataFrame:
    """Where two segments at grade and of one layer cross inside both, a line with itself too: both lines, places along them, x, y."""
    a = _by_cell(segs.where("not separated"), size, SAME)
    b = a.select(*(F.col(c).alias(c if c in ("cx", "cy", "layer") else f"b_{c}") for c in a.columns))
    d = a.join(b, ["cx", "cy", "layer"]).where(F.struct("line_id", "pos") < F.struct(F.col("b_line_id").alias("line_id"), F.col("b_pos").alias("pos")))
    here, there = (tuple(F.col(p + c) for c in ("x1", "y1", "x2", "y2")) for p in ("", "b_"))
    x, y, t, s = geom.meeting(here, there)
    d = d.where(geom.crosses(here, there)).withColumns({"x": x, "y": y, "at": F.col("pos") + t, "b_at": F.col("b_pos") + s})
    d = d.where((geom.cell(F.col("x"), size) == F.col("cx")) & (geom.cell(F.col("y"), size) == F.col("cy")))  # once a pair: in the crossing's own cell
    return d.select("line_id", "at", F.col("b_line_id").alias("other"), F.col("b_at").alias("other_at"), "pos", F.col("b_pos").alias("other_pos"), "layer", "x", "y")


def snap_to_network(vertices: DataFrame, nodes: DataFrame, segs: DataFrame, reach: float, size: float = 100.0) -> DataFrame:
    """Vertices moved to the nearest node within reach (ties: smallest id), else onto the nearest segment.

    Ends go to anything; others only to nodes (joinable) and segments that aren't separated, and never on separated lines.
    """
    may = F.col("is_end") | ~F.col("separated")
    v = vertices.where(may).select("line_id", "pos", "x", "y", "is_end")
    n = _near(v, nodes, reach).where("is_end or b_joinable").groupBy("line_id", "pos").agg(F.min(F.struct("away", "b_node_id", "b_x", "b_y")).alias("m")).select("line_id", "pos", F.col("m.b_x").alias("nx"), F.col("m.b_y").alias("ny"))
    s = _by_cell(segs.select(F.col("line_id").alias("s_id"), F.col("separated").alias("s_sep"), "x1", "y1", "x2", "y2"), size, reach)
    e = v.withColumns({"cx": geom.cell(F.col("x"), size), "cy": geom.cell(F.col("y"), size)}).join(s, ["cx", "cy"]).where("is_end or not s_sep")
    t = geom.place_on(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")))
    e = e.withColumn("t", t).withColumns({"px": F.expr("x1 + t * (x2 - x1)"), "py": F.expr("y1 + t * (y2 - y1)")})
    e = e.withColumn("away", geom.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py"))).where(F.col("away") <= reach)
    e = e.groupBy("line_id", "pos").agg(F.min(F.struct("away", "s_id", "px", "py")).alias("m")).select("line_id", "pos", F.col("m.px").alias("ex"), F.col("m.py").alias("ey"))
    d = vertices.join(n, ["line_id", "pos"], "left").join(e, ["line_id", "pos"], "left")
    return d.withColumns({"x": F.coalesce("nx", "ex", "x"), "y": F.coalesce("ny", "ey", "y")}).drop("nx", "ny", "ex", "ey")


def numbered(d: DataFrame, order: str, first: int, name: str) -> DataFrame:
    """d with a gapless number in the order of a column, counted by ranges, not in one task."""
    w = _written(d.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()))
    sizes = w.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a range
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    k = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return w.withColumn("_k", k).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_k") + first).drop("_part", "_k", "_before")


def _block_counts(table: pa.Table) -> pa.Table:
    """(line_id, cuts) of the segments of two blocks, or of one with itself: how many pairs of them cross inside both."""
    of, here = table.column("block").to_numpy(), table.column("i")[0].as_py()
    line, pos, layer, x1, y1, x2, y2 = (table.column(c).to_numpy() for c in ("line_id", "pos", "layer", "x1", "y1", "x2", "y2"))
    west, east, south, north = np.minimum(x1, x2), np.maximum(x1, x2), np.minimum(y1, y2), np.maximum(y1, y2)
    order, cuts = np.argsort(west), np.zeros(len(line), np.int64)
    a, one = order[of[order] == here], here == table.column("j")[0].as_py()
    b = a if one else order[of[order] != here]
    for lo in range(0, len(a), 64):
        i = a[lo: lo + 64]
        near = b[(west[b] <= east[i].max()) & (east[b] >= west[i].min()) & (south[b] <= north[i].max()) & (north[b] >= south[i].min())]
        ax, ay, bx, by = (c[i][:, None] for c in (x1, y1, x2, y2))
        for at in range(0, len(near), 512):  # arrays that stay in the cache
            j = near[at: at + 512]
            cx, cy, dx, dy = (c[j] for c in (x1, y1, x2, y2))
            ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
            hit = (ux * (cy - ay) - uy * (cx - ax)) * (ux * (dy - ay) - uy * (dx - ax)) < 0  # as geom.crosses
            hit &= (vx * (ay - cy) - vy * (ax - cx)) * (vx * (by - cy) - vy * (bx - cx)) < 0
            hit &= layer[i][:, None] == layer[j]
            if one:
                hit &= (line[i][:, None] < line[j]) | ((line[i][:, None] == line[j]) & (pos[i][:, None] < pos[j]))
            cuts[i] += hit.sum(1)
            cuts[j] += hit.sum(0)
    ids, at = np.unique(line[cuts > 0], return_inverse=True)
    return pa.table({"line_id": ids, "cuts": np.bincount(at, cuts[cuts > 0], len(ids)).astype(np.int64)})


def crossing_counts(segs: DataFrame) -> DataFrame:
    """(line_id, cuts): at how many crossings() each line that has any is cut; they are counted and not listed.

    Where lines cross everywhere, crossings grow with the square of the lines. Here the segments are dealt to blocks by
    their place, and a task compares two blocks whose boxes meet: each pair of segments is looked at in one task, and
    only counts go on. The time still follows the pairs of segments whose boxes are near each other.
    """
    d = segs.where("not separated and layer is not null").select("line_id", "pos", "layer", "x1", "y1", "x2", "y2", F.expr("x1 + x2").alias("mx"), F.expr("y1 + y2").alias("my"))
    box = d.agg(F.min("mx").alias("low"), F.max("mx").alias("high"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.count("*") / BLOCK_ROWS))).alias("strips"))  # one row
    strip = F.when(F.col("high") > F.col("low"), F.floor((F.col("mx") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("strips"))).otherwise(0)
    d = d.crossJoin(F.broadcast(box)).withColumn("place", F.struct("layer", strip.alias("strip"), "my", "line_id", "pos")).drop("low", "high", "strips", "mx", "my")
    d = _written(numbered(d, "place", 0, "k").withColumn("block", F.floor(F.col("k") / BLOCK_ROWS)).drop("place", "k"))
    bounds = [f(F.expr(e)).alias(n) for n, f, e in (("west", F.min, "least(x1, x2)"), ("east", F.max, "greatest(x1, x2)"), ("south", F.min, "least(y1, y2)"), ("north", F.max, "greatest(y1, y2)"), ("bottom", F.min, "layer"), ("top", F.max, "layer"))]
    blocks = _written(d.groupBy("block").agg(*bounds))  # one row a block
    p, q = blocks.alias("p"), blocks.alias("q")
    meet = F.expr("p.block <= q.block and p.west <= q.east and q.west <= p.east and p.south <= q.north and q.south <= p.north and p.bottom <= q.top and q.bottom <= p.top")
    tasks = p.join(F.broadcast(q), meet).select(F.col("p.block").alias("i"), F.col("q.block").alias("j"))
    tasks = tasks.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    found = d.join(tasks, "block").groupBy("i", "j").applyInArrow(_block_counts, "line_id long, cuts long")
    return _written(found).groupBy("line_id").agg(F.sum("cuts").alias("cuts"))


def build(lines: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None, reach: float = 1.0, join_at: str = "crossings", size: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the network that lines (line_id long >= 0, pos, x, y, separated, layer) make, with existing nodes
    (node_id, x, y) and edges (edge_id long, u, v, separated, layer) where given.

    Line ends within reach of each other meet; vertices near the network move onto it; lines are cut where they cross at grade on one
    layer and where a point of another line that may join lies on them. An end joins anything it touches; the middle of a
    separated line shares its node with ends alone. join_at="vertices" joins at drawn vertices only.
    Nodes: node_id, x, y, existing. Edges: custom, line_id (edge_id if existing), part, u, v, length. An edge from a node to itself
    goes. Empty lines give the existing network back.
    """
    if join_at not in ("crossings", "vertices"):
        raise ValueError(f"join_at is crossings or vertices, not {join_at!r}")
    spark, everywhere = lines.sparkSession, join_at == "vertices"
    v = _written(clean(lines.select("line_id", "pos", "x", "y", "separated", "layer")))
    ends = v if everywhere else v.where("is_end")
    v = _moved(v, gather(ends.withColumn("rank", F.lit(1)), reach, True), None if everywhere else F.col("is_end"))
    if nodes is None or edges is None:
        nodes = spark.createDataFrame([], "node_id long, x double, y double")
        edges = spark.createDataFrame([], "edge_id long, u long, v long, separated boolean, layer int")
    # Existing edges are lines of two vertices with ids below zero.
    e = edges.select((-1 - F.col("edge_id")).alias("line_id"), "u", "v", "separated", "layer")
    at_grade = e.where("not separated").select(F.explode(F.array("u", "v")).alias("node_id")).distinct().withColumn("joinable", F.lit(True))
    n = _written(nodes.select("node_id", "x", "y").join(at_grade, "node_id", "left").fillna(False, ["joinable"]))
    old = e.withColumn("_e", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.col("u").alias("node_id")), F.struct(F.lit(1).alias("pos"), F.col("v").alias("node_id"))))).select("line_id", "separated", "layer", "_e.*")
    old = _written(old.join(n.select("node_id", "x", "y"), "node_id").select("line_id", "pos", "x", "y", "separated", "layer", F.lit(True).alias("is_end")))
    v = _written(clean(snap_to_network(v, n, segments(old), reach, size).drop("is_end")))
    new_segs = segments(v)
    segs = _written(new_segs.unionByName(segments(old)))

    if everywhere:
        cross = spark.createDataFrame([], "line_id long, at double, other long, other_at double, layer int, x double, y double")
    else:
        cross = crossings(segs, size).where("line_id >= 0 or other >= 0")
        cross = cross.withColumns({"key": F.monotonically_increasing_id()})
        cross = _written(cross)
        hit = _near(cross.select("key", "x", "y"), n.where("joinable"), reach).groupBy("key").agg(F.min(F.struct("away", "b_node_id", "b_x", "b_y")).alias("m"))
        cross = cross.join(hit, "key", "left").withColumns({"x": F.coalesce("m.b_x", "x"), "y": F.coalesce("m.b_y", "y")}).drop("m", "key")
        cross = _written(cross)
    # Points: existing nodes first, then drawn vertices, then crossings; what lies within SAME is one place, at the first.
    none = F.lit(None)
    points = n.select(F.lit(0).alias("rank"), (-1 - F.col("node_id")).alias("line_id"), F.lit(0.0).alias("pos"), "x", "y", F.lit(False).alias("is_end"), none.cast("boolean").alias("separated"), none.cast("int").alias("layer"), F.col("node_id"))
    met = old.select(F.lit(0).alias("rank"), "line_id", F.col("pos").cast("double").alias("pos"), "x", "y", F.lit(False).alias("is_end"), "separated", "layer")  # the layers that meet at a node
    points = points.unionByName(met, allowMissingColumns=True)
    points = points.unionByName(v.select(F.lit(1).alias("rank"), "line_id", F.col("pos").cast("double").alias("pos"), "x", "y", "is_end", "separated", "layer"), allowMissingColumns=True)
    both = cross.select(F.explode(F.array(F.struct("line_id", F.col("at").alias("pos")), F.struct(F.col("other").alias("line_id"), F.col("other_at").alias("pos")))).alias("p"), "x", "y", "layer")
    points = points.unionByName(both.select(F.lit(2).alias("rank"), "p.line_id", "p.pos", "x", "y", F.lit(False).alias("is_end"), F.lit(False).alias("separated"), "layer"), allowMissingColumns=True)
    points = _written(points)
    points = _moved(points, gather(points, SAME, False))
    places = points.groupBy("x", "y").agg(F.bool_or("is_end").alias("any_end"), F.bool_and("separated").alias("all_separated"), F.collect_set("layer").alias("layers"), F.min("node_id").alias("node_id"))
    places = _written(places)
    # The middle of a separated line stays apart from all but ends.
    points = points.join(places.select("x", "y", "any_end"), ["x", "y"]).withColumn("apart", F.when((F.col("rank") == 1) & F.col("separated") & ~F.col("any_end"), F.col("line_id")))
    cuts = points.where("rank > 0").select("line_id", F.col("pos").alias("at"), "x", "y", "apart")
    cuts = cuts.unionByName(old.select("line_id", F.col("pos").cast("double").alias("at"), "x", "y", none.cast("long").alias("apart")))
    # Places that lie on a segment of another line and may join it.
    c = _by_cell(segs, size, SAME)
    p = places.withColumns({"cx": geom.cell(F.col("x"), size), "cy": geom.cell(F.col("y"), size)})
    if everywhere:
        p = p.where(F.lit(False))
    on = p.join(c, ["cx", "cy"]).where("any_end or (not all_separated and not separated and array_contains(layers, layer))")
    on = on.withColumn("t", geom.place_on(*(F.col(k) for k in ("x", "y", "x1", "y1", "x2", "y2"))))
    on = on.where(geom.distance(F.col("x"), F.col("y"), F.expr("x1 + t * (x2 - x1)"), F.expr("y1 + t * (y2 - y1)")) <= 2 * SAME)
    cuts = cuts.unionByName(on.select("line_id", (F.col("pos") + F.col("t")).alias("at"), "x", "y", none.cast("long").alias("apart")))
    cuts = _written(cuts)

    spots = cuts.groupBy("x", "y", "apart").agg(F.min(F.struct(F.when(F.col("line_id") >= 0, 0).otherwise(1).alias("late"), "line_id", "at")).alias("first"))
    spots = _written(spots.join(places.select("x", "y", "node_id"), ["x", "y"], "left"))
    taken = n.agg(F.max("node_id")).first()[0]
    fresh = numbered(spots.where("node_id is null or apart is not null").drop("node_id"), "first", 0 if taken is None else taken + 1, "node_id")
    ids = _written(spots.where("node_id is not null and apart is null").select("x", "y", "apart", "node_id").unionByName(fresh.select("x", "y", "apart", "node_id")))
    same = [cuts[k].eqNullSafe(ids[k]) for k in ("x", "y", "apart")]
    at = cuts.join(ids, same[0] & same[1] & same[2]).select(cuts["line_id"], cuts["at"], cuts["x"], cuts["y"], ids["node_id"]).distinct()
    w = Window.partitionBy("line_id").orderBy("at", "node_id")
    step = at.select("line_id", "at", F.col("node_id").alias("u"), F.lead("node_id").over(w).alias("v"), geom.distance(F.col("x"), F.col("y"), F.lead("x").over(w), F.lead("y").over(w)).alias("length")).where("v is not null and u <> v")
    step = step.withColumn("part", F.row_number().over(Window.partitionBy("line_id").orderBy("at")) - 1)
    custom = F.col("line_id") >= 0
    out = step.select(custom.alias("custom"), F.when(custom, F.col("line_id")).otherwise(-1 - F.col("line_id")).alias("line_id"), "part", "u", "v", "length")
    all_nodes = n.select("node_id", "x", "y", F.lit(True).alias("existing")).unionByName(fresh.select("node_id", "x", "y", F.lit(False).alias("existing")))
    return all_nodes, out
