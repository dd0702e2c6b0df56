"""Queries over edits of existing ways, points, turns and relations; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits, points, relations, turns
from ..sources import derived as src
from .oracle import _NODES, _POINTS, _STREETS

#: Edits keep this far (m) from the streets that they cover.
NEAR = 1.0
#: Tells streets apart: way, order, line and start (an order may have a line number twice).
_ID = "((cast(way_id AS bigint) * 1000000 + okey) * 10 + line) * 10000 + u AS street_id"


def _streets(spark, sf_dir):
    """Streets as the edits take them: two-way ones drawn with even line numbers, the rest stored as reversed copies."""
    d = src.streets(spark, sf_dir)
    tag = F.map_filter(F.create_map(F.lit("highway"), F.col("highway"), F.lit("maxspeed"), F.col("maxspeed"), F.lit("oneway"), F.col("oneway")), lambda k, v: v.isNotNull())
    return d.select(F.expr(_ID), "way_id", "u", "v", (F.col("line") % 4 == 1).alias("reversed"), tag.alias("tags"))


def _ways(spark, sf_dir):
    """Ways: a part's size as speed and direction."""
    p, size = src.table(spark, sf_dir, "part"), F.col("p_size")
    speed = F.when(size % 2 == 0, F.concat(size.cast("string"), F.lit(" mph")))
    own = F.map_filter(F.create_map(F.lit("maxspeed"), speed, F.lit("oneway"), F.when(size % 3 == 0, "yes"), F.lit("lit"), F.lit("no")), lambda k, v: v.isNotNull())
    return p.select(F.col("p_partkey").alias("way_id"), own.alias("tags"))


def _edits(spark, sf_dir):
    """An edit an order: drawn along its first street (against it for odd customers), with tags by customer."""
    s = src.streets(spark, sf_dir).where("line = 1").groupBy("okey").agg(F.min(F.struct("way_id", "u", "v")).alias("s")).select("okey", "s.*")
    n = src.nodes(spark, sf_dir)
    o = src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("okey"), F.col("o_custkey").alias("c"))
    d = s.join(o, "okey").join(n.toDF("u", "x1", "y1"), "u").join(n.toDF("v", "x2", "y2"), "v")
    line = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    c = F.col("c")
    tag = F.map_filter(F.create_map(F.lit("maxspeed"), F.when(c % 3 == 0, F.lit("20 mph")), F.lit("oneway"), F.when(c % 5 < 2, F.lit("yes"))), lambda k, v: v.isNotNull())
    return d.select(F.col("okey").alias("number"), F.col("okey").alias("feature"), "way_id", F.when(c % 2 == 1, F.reverse(line)).otherwise(line).alias("line"), tag.alias("tags"),
                    F.when(c % 11 == 0, "yes").alias("remove"), F.when(c % 7 == 0, "lit; name").alias("remove_tags"))


def _steps(streets):
    return streets.select("way_id", "u", "v").distinct()


def _cover(spark, sf_dir):
    return edits.covered(_streets(spark, sf_dir), src.nodes(spark, sf_dir), _edits(spark, sf_dir), NEAR)


def _changes(spark, sf_dir):
    s, e = _streets(spark, sf_dir), _edits(spark, sf_dir)
    along = edits.votes(s, src.nodes(spark, sf_dir), e, _steps(s), _cover(spark, sf_dir))
    return edits.changes(e, _ways(spark, sf_dir), along)


def jn_23_covered(spark, sf_dir):
    """Streets of an edit's way that its line runs along, and how far their middles are from it."""
    return _cover(spark, sf_dir).select("number", "street_id", F.round("away", 6).alias("away"))


def scl_15_along(spark, sf_dir):
    """Whether each edit is drawn its way's own way, by the votes of the steps that it covers."""
    s = _streets(spark, sf_dir)
    return edits.votes(s, src.nodes(spark, sf_dir), _edits(spark, sf_dir), _steps(s), _cover(spark, sf_dir))


def edt_01_changes(spark, sf_dir):
    """What each edit sets and deletes on its way."""
    c = F.col("change")
    return _changes(spark, sf_dir).select("number", "way_id", c["maxspeed"].alias("maxspeed"), c["oneway"].alias("oneway"), F.map_contains_key(c, F.lit("lit")).alias("drops_lit"), F.map_contains_key(c, F.lit(edits.REMOVED)).alias("removed"), F.size(c).alias("size"))


def win_06_claims(spark, sf_dir):
    """Each street goes to the nearest edit that claims it, the smallest number on a tie; claims of the same stretch with another change clash."""
    d = edits.claims(_cover(spark, sf_dir), _changes(spark, sf_dir))
    return d.groupBy("street_id").agg(F.min(F.when(F.col("place") == 1, F.col("number"))).alias("owner"), F.count("*").alias("claims"), F.count_if("clash").alias("clashes"))


def edt_02_direction(spark, sf_dir):
    """Streets of ways whose speed is given rebuilt for the direction that their way's tag says."""
    s = _streets(spark, sf_dir)
    d = s.join(_ways(spark, sf_dir).select("way_id", edits.oneway_state(F.when(F.col("tags")["oneway"].isNotNull(), F.lit("-1"))).alias("state")), "way_id")
    return edits.in_direction(d, _steps(s)).select("street_id", "u", "v", "reversed")


def edt_01_apply(spark, sf_dir):
    """The streets after all edits, withdrawn ones left out: no SQL, the withdrawing is sequential (see the tests)."""
    s, w = _streets(spark, sf_dir), _ways(spark, sf_dir)
    refs = src.streets(spark, sf_dir).groupBy("way_id").agg(F.array(F.min("u"), F.min("v")).alias("refs"))
    d, _, _ = edits.apply_edits(s, src.nodes(spark, sf_dir), w.join(refs, "way_id"), _edits(spark, sf_dir), NEAR)
    return d.select("street_id", "u", "v", "reversed", F.col("tags")["maxspeed"].alias("maxspeed"), "modified", "edit")


def flt_10_way_ids(spark, sf_dir):
    """Way ids out of two columns, the later one first."""
    c, name = src.table(spark, sf_dir, "customer"), F.array(F.lit("w"), F.lit(""), F.lit("n"), F.lit("W"))
    d = c.select(F.col("c_custkey").alias("id"), F.concat(F.get(name, F.col("c_nationkey") % 4), F.col("c_custkey").cast("string")).alias("osm_id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey").cast("string")).alias("osmid"))
    return edits.take_way_ids(d).select("id", F.coalesce("way_id", F.lit(-1)).alias("way_id"), "wrong_id")


def scl_11_removal(spark, sf_dir):
    """Answers to remove: yes, no, or neither."""
    words = F.array(*map(F.lit, ("Yes", " true", "1", "no", "FALSE", "0", " ", "maybe", "2")))
    d = src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.get(words, F.col("c_custkey") % 10).alias("value"))
    return d.select("id", F.coalesce(edits.wants_removal(F.col("value")).cast("string"), F.lit("unclear")).alias("removes"))


def scl_10_state(spark, sf_dir):
    """Directions of streets by oneway; part containers stand for junctions."""
    p = src.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("way_id"), F.when(F.col("p_size") % 4 == 0, "roundabout").when(F.col("p_size") % 4 == 1, "circular").alias("junction"))
    d = src.streets(spark, sf_dir).join(p, "way_id")
    return d.groupBy("oneway", "junction").agg(F.count("*").alias("n")).select("oneway", "junction", "n", edits.oneway_state(F.col("oneway"), F.col("junction")).alias("state"))


def _order_ways(spark, sf_dir):
    """A way an order: the suppliers of its lines in order."""
    li = src.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("way_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda s: s["l_suppkey"]).alias("all"))
    li = li.select("way_id", F.filter("all", lambda x, i: (i == 0) | (x != F.get("all", i - 1))).alias("refs"))  # no node follows itself
    return li.where(F.size("refs") >= 2).select("way_id", F.col("refs").cast("array<bigint>").alias("refs"), F.create_map(F.lit("highway"), F.lit("service")).alias("tags"))


def _order_relations(spark, sf_dir):
    """A restriction an order: from its way, by the way's second node, to the first way that holds that node."""
    w = _order_ways(spark, sf_dir)
    first = w.select("way_id", F.explode("refs").alias("node")).groupBy("node").agg(F.min("way_id").alias("to"))
    d = w.select("way_id", F.get("refs", F.lit(1)).alias("node")).join(first, "node")
    member = lambda t, r, o: F.struct(F.lit(t).alias("type"), F.col(r).alias("ref"), F.lit(o).alias("role"))
    return d.select(F.col("way_id").alias("rel_id"), F.create_map(F.lit("type"), F.lit("restriction")).alias("tags"), F.array(member("way", "way_id", "from"), member("node", "node", "via"), member("way", "to", "to")).alias("members"))


def _order_pieces(spark, sf_dir):
    """The ways cut at their inner nodes with x = 300; the first piece keeps the id, others get way x 100 + part, negative."""
    w = _order_ways(spark, sf_dir)
    at = src.nodes(spark, sf_dir).where("x = 300").select(F.col("node_id").cast("bigint").alias("node"))
    step = w.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("refs") - 2), lambda i: F.struct(F.get("refs", i).alias("a"), F.get("refs", i + 1).alias("b")))).alias("s")).select("s.a", "s.b").distinct()
    cuts = step.join(at, (F.col("a") == at["node"]) | (F.col("b") == at["node"])).select("a", "b", "node")
    d = relations.cut_at(w, cuts)
    return d.select("way_id", "part", F.when(F.col("part") == 0, F.col("way_id")).otherwise(-(F.col("way_id") * 100 + F.col("part"))).alias("piece_id"), "refs")


def way_05_cuts(spark, sf_dir):
    """Pieces of ways cut at junctions."""
    return _order_pieces(spark, sf_dir).select("way_id", "part", F.array_join(F.col("refs").cast("array<string>"), "-").alias("refs"))


def way_08_members(spark, sf_dir):
    """Restrictions on the pieces: the from and to pieces at the via node."""
    d = relations.rewrite(_order_relations(spark, sf_dir), _order_ways(spark, sf_dir), _order_pieces(spark, sf_dir), src.nodes(spark, sf_dir).select(F.col("node_id").cast("bigint").alias("node_id")))
    return d.select("rel_id", F.get("members", F.lit(0))["ref"].alias("from_piece"), F.get("members", F.lit(2))["ref"].alias("to_piece"))


def way_07_routes(spark, sf_dir):
    """Routes (a customer's orders) on the pieces: how many members are left."""
    o = src.table(spark, sf_dir, "orders").select("o_custkey", F.struct(F.lit("way").alias("type"), F.col("o_orderkey").cast("bigint").alias("ref"), F.lit("").alias("role")).alias("m"))
    r = o.groupBy(F.col("o_custkey").cast("bigint").alias("rel_id")).agg(F.collect_list("m").alias("members")).select("rel_id", F.create_map(F.lit("type"), F.lit("route")).alias("tags"), "members")
    d = relations.rewrite(r, _order_ways(spark, sf_dir), _order_pieces(spark, sf_dir), src.nodes(spark, sf_dir).select(F.col("node_id").cast("bigint").alias("node_id")))
    return d.select("rel_id", F.size("members").alias("members"))


def qgs_04_paths(spark, sf_dir):
    """Restrictions as paths: the longer side of the from way up to the via node, and of the to way from it."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), "-").alias(c)
    return relations.restriction_paths(_order_relations(spark, sf_dir), _order_ways(spark, sf_dir)).select("rel_id", "to_way", text("arrive"), text("via"), text("leave"))


def qgs_03_lengths(spark, sf_dir):
    """Restrictions as lines: how long each is drawn and where it starts."""
    n = src.nodes(spark, sf_dir).withColumn("node_id", F.col("node_id").cast("bigint"))
    d = relations.restriction_lines(_order_relations(spark, sf_dir), _order_ways(spark, sf_dir), n)
    first, last = F.get("line", F.lit(0)), F.element_at("line", -1)
    return d.select("rel_id", F.round(first["x"], 6).alias("x1"), F.round(first["y"], 6).alias("y1"), F.round(last["x"], 6).alias("x2"), F.round(last["y"], 6).alias("y2"))


def jn_26_under(spark, sf_dir):
    """Points by where they go: the nearest node within 30 m, else the street under them within 30 m and how many lie there."""
    p = src.points(spark, sf_dir).withColumn("layer", F.lit(None).cast("string"))
    s = src.streets(spark, sf_dir).select("u", "v", F.create_map(F.lit("layer"), F.col("layer")).alias("tags"))
    n = src.nodes(spark, sf_dir)
    on = points.nearest_node(p, n, 30.0)
    under = points.street_under(p.join(on, "point_id", "left_anti"), n, s, 30.0)
    d = p.select("point_id").join(on, "point_id", "left").join(under.select("point_id", "many"), "point_id", "left")
    return d.select("point_id", F.coalesce("node_id", F.lit(-1)).alias("node_id"), F.coalesce("many", F.lit(0)).alias("many"))


def flt_42_turn_tags(spark, sf_dir):
    """Turn tags of features and those with wrong values."""
    k = F.col("c_custkey")
    value = F.get(F.array(*map(F.lit, ("no_left_turn", "only_u_turn", "no_turn", " ", "no_u_turn"))), k % 5)
    other = F.get(F.array(*map(F.lit, ("bus", "bus; cat", "hgv;psv"))), k % 4)
    own = F.map_filter(F.create_map(F.lit("restriction"), F.when(k % 2 == 0, value), F.lit("restriction:hgv"), F.when(k % 3 == 0, value), F.lit("except"), other, F.lit("name"), F.lit("x")), lambda a, v: v.isNotNull())
    d = src.table(spark, sf_dir, "customer").select(k.alias("id"), own.alias("t"))
    return d.select("id", F.size(turns.turn_tags(F.col("t"))).alias("tags"), F.array_join(turns.problems(F.col("t")), ";").alias("wrong"))


QUERIES = {f.__name__: f for f in (jn_23_covered, scl_15_along, edt_01_changes, win_06_claims, edt_02_direction, edt_01_apply, flt_10_way_ids, scl_11_removal, scl_10_state, way_05_cuts, way_08_members, way_07_routes, qgs_04_paths, qgs_03_lengths, jn_26_under, flt_42_turn_tags)}

_DX, _DY = "(e.qx - e.ax)", "(e.qy - e.ay)"
_EDITS = f"""{_NODES}, {_STREETS}, ends AS (SELECT ((way_id::BIGINT * 1000000 + okey) * 10 + line) * 10000 + u AS street_id, okey, line, way_id, u, v, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM streets JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v),
e AS (SELECT okey AS number, way_id, o_custkey AS c, CASE WHEN o_custkey % 2 = 1 THEN x2 ELSE x1 END AS ax, CASE WHEN o_custkey % 2 = 1 THEN y2 ELSE y1 END AS ay, CASE WHEN o_custkey % 2 = 1 THEN x1 ELSE x2 END AS qx, CASE WHEN o_custkey % 2 = 1 THEN y1 ELSE y2 END AS qy
 FROM (SELECT *, row_number() OVER (PARTITION BY okey ORDER BY way_id, u, v) AS k FROM ends WHERE line = 1) q JOIN orders ON o_orderkey = okey WHERE k = 1),
spot AS (SELECT number, street_id, u, v, x1, y1, x2, y2, e.ax, e.ay, e.qx, e.qy, greatest(0.0, least(1.0, (((x1 + x2) / 2 - e.ax) * {_DX} + ((y1 + y2) / 2 - e.ay) * {_DY}) / ({_DX} * {_DX} + {_DY} * {_DY}))) AS t FROM e JOIN ends USING (way_id)),
cov AS (SELECT *, sqrt(((x1 + x2) / 2 - ax - t * (qx - ax)) ** 2 + ((y1 + y2) / 2 - ay - t * (qy - ay)) ** 2) AS away FROM spot
 WHERE sqrt(((x1 + x2) / 2 - ax - t * (qx - ax)) ** 2 + ((y1 + y2) / 2 - ay - t * (qy - ay)) ** 2) <= 1 AND abs((x2 - x1) * (qx - ax) + (y2 - y1) * (qy - ay)) >= (cos(radians(45)) - 1e-9) * sqrt(((x2 - x1) ** 2 + (y2 - y1) ** 2) * ((qx - ax) ** 2 + (qy - ay) ** 2))),
vote AS (SELECT DISTINCT number, u, v, greatest(0.0, least(1.0, ((x1 + 0.25 * (x2 - x1) - ax) * (qx - ax) + (y1 + 0.25 * (y2 - y1) - ay) * (qy - ay)) / ((qx - ax) ** 2 + (qy - ay) ** 2))) AS early,
 greatest(0.0, least(1.0, ((x1 + 0.75 * (x2 - x1) - ax) * (qx - ax) + (y1 + 0.75 * (y2 - y1) - ay) * (qy - ay)) / ((qx - ax) ** 2 + (qy - ay) ** 2))) AS late FROM cov),
along AS (SELECT number, sum(sign(late - early)) >= 0 AS along FROM vote GROUP BY 1),
w AS (SELECT p_partkey AS way_id, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR || ' mph' END AS speed, p_size % 3 = 0 AS oneway FROM part),
change AS (SELECT number, way_id, c % 11 = 0 AS removed, CASE WHEN c % 11 <> 0 AND c % 3 = 0 AND speed IS DISTINCT FROM '20 mph' THEN '20 mph' END AS maxspeed,
 CASE WHEN c % 11 <> 0 AND c % 5 < 2 AND NOT (along AND oneway) THEN CASE WHEN along THEN 'yes' ELSE '-1' END END AS oneway, c % 11 <> 0 AND c % 7 = 0 AS drops_lit FROM e JOIN along USING (number) JOIN w USING (way_id))"""
_WAYS = """ways AS (SELECT l_orderkey AS way_id, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS refs FROM (SELECT *, lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS before FROM lineitem) l WHERE before IS DISTINCT FROM l_suppkey GROUP BY 1 HAVING count(*) >= 2),
spots AS (SELECT way_id, len(refs) AS n, unnest(refs) AS node, unnest(range(1, len(refs) + 1)) AS p FROM ways),
cuts AS (SELECT way_id, p FROM spots WHERE p > 1 AND p < n AND node % 10 = 3),
bounds AS (SELECT way_id, refs, list_concat([1], coalesce((SELECT list(p ORDER BY p) FROM cuts c WHERE c.way_id = ways.way_id), []), [len(refs)]) AS b FROM ways),
firsts AS (SELECT node, min(way_id) AS "to" FROM spots GROUP BY 1),
rels AS (SELECT way_id AS rel_id, refs[2] AS via, "to" FROM ways JOIN firsts ON node = refs[2]),
part_of AS (SELECT s.way_id, s.node, min((SELECT count(*) FROM cuts c WHERE c.way_id = s.way_id AND c.p < s.p)) AS part FROM spots s GROUP BY 1, 2)"""
_PIECE = "CASE WHEN {0}.part = 0 THEN {0}.way_id ELSE -({0}.way_id * 100 + {0}.part) END"
_SIDES = _WAYS + """, hits AS (SELECT rel_id, "to" AS to_way, via, f.refs AS fr, t.refs AS tr, list_position(f.refs, via) AS i, list_position(t.refs, via) AS j FROM rels JOIN ways f ON f.way_id = rel_id JOIN ways t ON t.way_id = "to"),
sides AS (SELECT rel_id, to_way, via, CASE WHEN i >= len(fr) - i + 1 THEN fr[1:i] ELSE list_reverse(fr[i:]) END AS arrive, CASE WHEN j >= len(tr) - j + 1 THEN list_reverse(tr[1:j]) ELSE tr[j:] END AS leave FROM hits),
paths AS (SELECT * FROM sides WHERE len(arrive) >= 2 AND len(leave) >= 2)"""
ORACLE_SQL: dict[str, str] = {
    "jn_23_covered": f"WITH {_EDITS} SELECT number, street_id, round(away, 6) AS away FROM cov",
    "scl_15_along": f"WITH {_EDITS} SELECT number, along FROM along",
    "edt_01_changes": f"WITH {_EDITS} SELECT number, way_id, maxspeed, oneway, drops_lit, removed, (removed::INT + (maxspeed IS NOT NULL)::INT + (oneway IS NOT NULL)::INT + drops_lit::INT) AS size FROM change",
    "win_06_claims": f"""WITH {_EDITS}, k AS (SELECT street_id, number, away, concat_ws('|', removed::VARCHAR, coalesce(maxspeed, '-'), coalesce(oneway, '-'), drops_lit::VARCHAR) AS what FROM cov JOIN change USING (number) WHERE removed OR maxspeed IS NOT NULL OR oneway IS NOT NULL OR drops_lit),
f AS (SELECT *, first_value(number) OVER w AS owner, first_value(away) OVER w AS near, first_value(what) OVER w AS asked FROM k WINDOW w AS (PARTITION BY street_id ORDER BY away, number)) SELECT street_id, min(owner) AS owner, count(*) AS claims, count(*) FILTER (WHERE away - near <= 0.01 AND what <> asked) AS clashes FROM f GROUP BY 1""",
    "edt_02_direction": f"""WITH {_STREETS}, s AS (SELECT ((way_id::BIGINT * 1000000 + okey) * 10 + line) * 10000 + u AS street_id, u, v, p_size % 3 = 0 AS oneway FROM streets JOIN part ON p_partkey = way_id WHERE line % 4 <> 1)
SELECT street_id, CASE WHEN oneway THEN v ELSE u END AS u, CASE WHEN oneway THEN u ELSE v END AS v, false AS reversed FROM s UNION ALL SELECT street_id, v, u, true FROM s WHERE NOT oneway""",
    "flt_10_way_ids": """WITH c AS (SELECT c_custkey AS id, c_custkey, c_nationkey % 4 AS k, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS other FROM customer)
SELECT id, CASE WHEN other > 0 THEN other WHEN k <> 2 AND c_custkey > 0 THEN c_custkey ELSE -1 END AS way_id, CASE WHEN k = 2 OR c_custkey = 0 THEN 'osm_id=' || ['w', '', 'n', 'W'][k + 1] || c_custkey WHEN other = 0 THEN 'osmid=0' END AS wrong_id FROM c""",
    "scl_11_removal": "SELECT c_custkey AS id, CASE WHEN c_custkey % 10 < 3 THEN 'true' WHEN c_custkey % 10 < 7 OR c_custkey % 10 = 9 THEN 'false' ELSE 'unclear' END AS removes FROM customer",
    "scl_10_state": f"""WITH {_STREETS}, j AS (SELECT oneway, CASE p_size % 4 WHEN 0 THEN 'roundabout' WHEN 1 THEN 'circular' END AS junction FROM streets JOIN part ON p_partkey = way_id)
SELECT oneway, junction, count(*) AS n, CASE WHEN oneway = 'yes' OR (oneway IS NULL AND junction IS NOT NULL) THEN 'forward' WHEN oneway = '-1' THEN 'backward' ELSE 'both' END AS state FROM j GROUP BY 1, 2""",
    "way_05_cuts": f"WITH {_WAYS}, k AS (SELECT way_id, refs, b, unnest(range(0, len(b) - 1)) AS part FROM bounds) SELECT way_id, part::INT AS part, list_aggregate(refs[b[part + 1]:b[part + 2]], 'string_agg', '-') AS refs FROM k",
    "way_08_members": f"""WITH {_WAYS} SELECT rel_id, {_PIECE.format('f')} AS from_piece, {_PIECE.format('t')} AS to_piece FROM rels JOIN part_of f ON f.way_id = rel_id AND f.node = via JOIN part_of t ON t.way_id = "to" AND t.node = via""",
    "way_07_routes": f"WITH {_WAYS} SELECT o_custkey AS rel_id, sum(len(b) - 1)::INT AS members FROM orders JOIN bounds ON way_id = o_orderkey GROUP BY 1",
    "qgs_04_paths": f"WITH {_SIDES} SELECT rel_id, to_way, list_aggregate(arrive, 'string_agg', '-') AS arrive, via::VARCHAR AS via, list_aggregate(leave, 'string_agg', '-') AS leave FROM paths",
    "qgs_03_lengths": f"""WITH {_SIDES}, {_NODES}, tips AS (SELECT rel_id, arrive[len(arrive)] AS a, arrive[len(arrive) - 1] AS b, leave[1] AS c, leave[2] AS d, len(arrive) AS n, len(leave) AS m FROM paths),
g AS (SELECT rel_id, a.x AS ax, a.y AS ay, b.x AS qx, b.y AS qy, c.x AS cx, c.y AS cy, d.x AS dx, d.y AS dy, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS la, sqrt((c.x - d.x) ** 2 + (c.y - d.y) ** 2) AS lc FROM tips JOIN nodes a ON a.node_id = tips.a JOIN nodes b ON b.node_id = tips.b JOIN nodes c ON c.node_id = tips.c JOIN nodes d ON d.node_id = tips.d)
SELECT rel_id, round(ax + (qx - ax) * 20 / la, 6) AS x1, round(ay + (qy - ay) * 20 / la, 6) AS y1, round(cx + (dx - cx) * 20 / lc, 6) AS x2, round(cy + (dy - cy) * 20 / lc, 6) AS y2 FROM g WHERE la > 0 AND lc > 0""",
    "jn_26_under": f"""WITH {_NODES}, {_POINTS}, {_STREETS}, onn AS (SELECT point_id, node_id, row_number() OVER (PARTITION BY point_id ORDER BY sqrt((n.x - p.x) ** 2 + (n.y - p.y) ** 2), node_id) AS k FROM points p JOIN nodes n ON sqrt((n.x - p.x) ** 2 + (n.y - p.y) ** 2) <= 30),
s AS (SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b FROM streets), g AS (SELECT a, b, m.x AS x1, m.y AS y1, n.x AS x2, n.y AS y2 FROM s JOIN nodes m ON m.node_id = a JOIN nodes n ON n.node_id = b),
d AS (SELECT point_id, p.x, p.y, a, b, x1, y1, x2, y2, greatest(0.0, least(1.0, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t FROM points p, g WHERE point_id NOT IN (SELECT point_id FROM onn)),
f AS (SELECT point_id, a, b, sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) AS away FROM d), h AS (SELECT *, min(away) OVER (PARTITION BY point_id) AS low FROM f WHERE away <= 30),
u AS (SELECT point_id, count(*) AS many FROM h WHERE away <= low + 0.01 GROUP BY 1) SELECT p.point_id, coalesce(o.node_id, -1) AS node_id, coalesce(u.many, 0) AS many FROM points p LEFT JOIN onn o ON o.point_id = p.point_id AND o.k = 1 LEFT JOIN u ON u.point_id = p.point_id""",
    "flt_42_turn_tags": """WITH c AS (SELECT c_custkey AS id, ['no_left_turn', 'only_u_turn', 'no_turn', NULL, 'no_u_turn'][c_custkey % 5 + 1] AS v, c_custkey % 4 AS x FROM customer), t AS (SELECT id, CASE WHEN id % 2 = 0 THEN v END AS a, CASE WHEN id % 3 = 0 THEN v END AS b, x FROM c)
SELECT id, CASE WHEN a IS NULL AND b IS NULL THEN 0 ELSE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (x < 3)::INT END AS tags, concat_ws(';', CASE WHEN a = 'no_turn' THEN 'restriction' END, CASE WHEN b = 'no_turn' THEN 'restriction:hgv' END, CASE WHEN x = 1 AND (a IS NOT NULL OR b IS NOT NULL) THEN 'except' END) AS wrong FROM t""",
}
