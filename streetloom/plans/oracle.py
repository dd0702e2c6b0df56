"""SQL of the street-network queries, written apart from the plans."""

from __future__ import annotations

_NODES = "nodes AS (SELECT s_suppkey AS node_id, CAST((s_suppkey % 10) * 100 AS DOUBLE) AS x, CAST(floor(s_suppkey / 10.0) * 100 AS DOUBLE) AS y FROM supplier)"
_STREETS = """streets AS (SELECT * FROM (SELECT l_orderkey AS okey, l_linenumber AS line, l_suppkey AS u, (l_suppkey + l_linenumber) % (SELECT count(*) FROM supplier) AS v, p_partkey AS way_id,
 CASE WHEN p_type LIKE 'PROMO%' THEN 'motorway' WHEN p_type LIKE 'LARGE%' THEN 'primary' WHEN p_type LIKE 'STANDARD%' THEN 'residential' WHEN p_type LIKE 'MEDIUM%' THEN 'cycleway' WHEN p_type LIKE 'SMALL%' THEN 'footway' ELSE 'service' END AS highway,
 CASE l_returnflag WHEN 'A' THEN p_size::VARCHAR || ' mph' WHEN 'R' THEN p_size::VARCHAR END AS maxspeed,
 CASE WHEN l_linenumber % 3 = 0 THEN 'yes' WHEN l_linenumber % 5 = 0 THEN '-1' END AS oneway,
 CASE WHEN o_orderpriority LIKE '1%' THEN 'private' END AS access, CASE WHEN o_orderpriority LIKE '2%' THEN 'no' END AS motor_vehicle,
 CASE WHEN o_orderpriority LIKE '3%' THEN 'designated' END AS bicycle, CASE WHEN o_orderpriority LIKE '4%' THEN 'yes' END AS foot,
 CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN 'yes' END AS bridge, (l_linenumber % 2)::VARCHAR AS layer
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey) WHERE u <> v)"""
_SPEED = """coalesce(CASE WHEN maxspeed LIKE '% mph' THEN nullif(replace(maxspeed, ' mph', '')::DOUBLE, 0) * 1.609344 ELSE nullif(maxspeed::DOUBLE, 0) END,
 CASE highway WHEN 'motorway' THEN 100.0 WHEN 'primary' THEN 60.0 WHEN 'residential' THEN 30.0 WHEN 'cycleway' THEN 15.0 WHEN 'footway' THEN 5.0 ELSE 15.0 END::DOUBLE)"""
_DRIVE = "(access IS NULL AND motor_vehicle IS NULL AND highway NOT IN ('cycleway', 'footway', 'service'))"
_DRIVE_SERVICE = "(access IS NULL AND motor_vehicle IS NULL AND highway NOT IN ('cycleway', 'footway'))"
_BIKE = "(access IS NULL AND highway <> 'motorway' AND (highway <> 'footway' OR bicycle = 'designated'))"
_WALK = "(access IS NULL AND highway <> 'motorway' AND (highway <> 'cycleway' OR foot = 'yes'))"
_DIRECTION = "CASE oneway WHEN 'yes' THEN 'forward' WHEN '-1' THEN 'backward' ELSE 'both' END"
_MODES = f"concat_ws(';', CASE WHEN {_DRIVE} THEN 'drive' END, CASE WHEN {_DRIVE_SERVICE} THEN 'drive_service' END, CASE WHEN coalesce({_WALK}, false) THEN 'walk' END, CASE WHEN coalesce({_BIKE}, false) THEN 'bike' END)"
_LINES = """lines AS (SELECT vec_id AS line_id, p.pos AS pos, CASE p.pos WHEN 0 THEN embedding[1] WHEN 1 THEN embedding[3] ELSE embedding[5] END::DOUBLE * 1000 AS x,
 CASE p.pos WHEN 0 THEN embedding[2] WHEN 1 THEN embedding[4] ELSE embedding[6] END::DOUBLE * 1000 AS y FROM embeddings, (VALUES (0), (1), (2)) p(pos))"""
_SEGMENTS = _LINES + """, seg AS (SELECT * FROM (SELECT line_id, pos, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM lines WINDOW w AS (PARTITION BY line_id ORDER BY pos))
 WHERE x2 IS NOT NULL AND NOT (x1 = x2 AND y1 = y2))"""
_BUCKETS = """bands(name, days, a, b, roads, factor, speed) AS (VALUES ('peak', [1, 2, 3, 4, 5], 420, 570, ['primary', 'residential'], 0.6::DOUBLE, NULL::DOUBLE), ('evening', [1, 2, 3, 4, 5], 960, 1110, ['primary'], 0.5, NULL),
 ('night', [5, 6], 1320, 120, ['primary', 'residential', 'service'], NULL, 25.0), ('sunday', [0], 0, 1440, ['service'], 1.2, NULL)),
buckets AS (SELECT name, roads, factor, speed, ((d * 288 + a // 5 + k) % 2016)::INT AS bucket FROM (SELECT *, unnest(days) AS d FROM bands) q, range(2016) r(k)
 WHERE k < (b - a) // 5 + CASE WHEN b <= a THEN 288 ELSE 0 END)"""
_WEEK = _BUCKETS + """, week AS (SELECT road, k::INT AS bucket, round(greatest(coalesce(min(coalesce(b.speed, normal * b.factor)), normal), 1.0), 6) AS kph
 FROM (VALUES ('primary', 60.0::DOUBLE), ('residential', 30.0), ('service', 15.0)) r(road, normal) CROSS JOIN range(2016) t(k) LEFT JOIN buckets b ON b.bucket = k AND list_contains(b.roads, road) GROUP BY road, k, normal)"""
_POINTS = "points AS (SELECT c_custkey AS point_id, (c_custkey * 37 % 1000)::DOUBLE AS x, (c_custkey * 91 % 1000)::DOUBLE AS y FROM customer)"
_NEAR = f"{_NODES}, {_POINTS}, near AS (SELECT point_id, node_id, n.x AS nx, n.y AS ny, sqrt((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y)) AS away FROM points p JOIN nodes n ON n.x BETWEEN p.x - 40 AND p.x + 40 AND n.y BETWEEN p.y - 40 AND p.y + 40)"
_ENDS = "JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v"
_LENGTH = "sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))"
_ALL_STREETS = _STREETS.replace(" WHERE u <> v)", ")")
_PIECES = f"""RECURSIVE {_STREETS}, s AS (SELECT DISTINCT u, v FROM (SELECT u, v FROM streets UNION ALL SELECT v, u FROM streets)),
 reach(node_id, r) AS (SELECT u, u FROM s UNION SELECT s.v, reach.r FROM reach JOIN s ON s.u = reach.node_id), found AS (SELECT node_id, min(r) AS piece FROM reach GROUP BY node_id)"""
_KEY = "okey, line, u, v, way_id"
_CROSS = "(({0}x2 - {0}x1) * ({1} - {0}y1) - ({0}y2 - {0}y1) * ({2} - {0}x1))"


def _side(s: str, t: str, k: int) -> str:
    return _CROSS.format(f"{s}.", f"{t}.y{k}", f"{t}.x{k}")


_LINE_PIECES = f"""RECURSIVE {_SEGMENTS}, c AS (SELECT DISTINCT a.line_id AS u, b.line_id AS v FROM seg a JOIN seg b ON a.line_id % 4 = b.line_id % 4 AND a.line_id <> b.line_id
 AND {_side('a', 'b', 1)} * {_side('a', 'b', 2)} < 0 AND {_side('b', 'a', 1)} * {_side('b', 'a', 2)} < 0),
 reach(n, r) AS (SELECT DISTINCT line_id, line_id FROM lines UNION SELECT c.v, reach.r FROM reach JOIN c ON c.u = reach.n), found AS (SELECT n AS line_id, min(r) AS piece FROM reach GROUP BY n)"""


ORACLE_SQL: dict[str, str] = {
    "qgs_01": f"""WITH {_NODES}, {_STREETS}, e AS (SELECT *, {_LENGTH} AS len, {_SPEED} AS speed FROM streets {_ENDS})
SELECT {_KEY}, {_DRIVE} AS car, coalesce({_BIKE}, false) AS bike, coalesce({_WALK}, false) AS walk, round(speed, 1) AS speed_kph, round(len, 2) AS length_m, round(len / 1000 / speed * 60, 4) AS car_minutes,
 round(len / 1000 / 15.0 * 60, 4) AS bike_minutes, round(len / 1000 / 5.0 * 60, 4) AS walk_minutes, {_DIRECTION} AS car_direction FROM e""",
    "flt_12_separated": f"WITH {_STREETS} SELECT highway, (highway = 'motorway' OR bridge IS NOT NULL) AS separated, layer::INT AS layer, count(*) AS n FROM streets GROUP BY ALL",
    "flt_22_effective_access": f"""WITH {_STREETS} SELECT {_KEY}, CASE WHEN motor_vehicle IS NOT NULL THEN 'motor_vehicle' WHEN access IS NOT NULL THEN 'access' END AS drive_key, coalesce(motor_vehicle, access) AS drive_value,
 CASE WHEN bicycle IS NOT NULL THEN 'bicycle' WHEN access IS NOT NULL THEN 'access' END AS bike_key, coalesce(bicycle, access) AS bike_value, CASE WHEN foot IS NOT NULL THEN 'foot' WHEN access IS NOT NULL THEN 'access' END AS walk_key, coalesce(foot, access) AS walk_value FROM streets""",
    "flt_24_usable_modes": f"WITH {_STREETS} SELECT {_KEY}, {_MODES} AS modes FROM streets",
    "agg_10_mode_counts": f"WITH {_STREETS} SELECT {_MODES} AS modes, count(*) AS n FROM streets GROUP BY 1",
    "flt_29_resolve_tags": f"WITH {_STREETS} SELECT {_KEY}, coalesce(maxspeed, '20 mph') AS filled_maxspeed, coalesce(oneway, 'no') AS filled_oneway, coalesce(foot, 'yes') AS filled_foot, '20 mph' AS replaced_maxspeed, 'no' AS replaced_oneway, 'yes' AS replaced_foot FROM streets",
    "flt_30_value_problems": r"""WITH p AS (SELECT page_id, regexp_extract(url, '(\d+)', 1) AS maxspeed, regexp_extract(url, '/([a-z]{2})/', 1) AS oneway, regexp_extract(url, 'page=(.*)$', 1) AS lanes, '1.5' AS layer FROM pages)
SELECT page_id, concat_ws(';', CASE WHEN NOT regexp_matches(maxspeed, '^\s*\d+(\.\d+)?\s*(mph|knots)?\s*$') THEN 'maxspeed' END, CASE WHEN lower(oneway) NOT IN ('yes', 'no', 'true', 'false', '1', '0', '-1', 'reverse') THEN 'oneway' END,
 CASE WHEN NOT regexp_matches(lanes, '^[1-9]\d*$') THEN 'lanes' END, CASE WHEN NOT regexp_matches(layer, '^-?\d+$') THEN 'layer' END) AS problems FROM p WHERE maxspeed IS NOT NULL
UNION ALL SELECT page_id, 'layer' FROM p WHERE maxspeed IS NULL""",
    "scl_03_listed_keys": """WITH p AS (SELECT page_id, unnest(string_split(replace(translate(url, '/.?', ';, '), ',', ';'), ';')) AS k, generate_subscripts(string_split(replace(translate(url, '/.?', ';, '), ',', ';'), ';'), 1) AS i FROM pages WHERE url IS NOT NULL),
q AS (SELECT page_id, trim(k) AS k, min(i) AS i FROM p WHERE trim(k) <> '' GROUP BY 1, 2) SELECT page_id, string_agg(k, '|' ORDER BY i) AS keys FROM q GROUP BY 1""",
    "scl_04_maxspeed": f"""WITH {_STREETS}, m AS (SELECT maxspeed, count(*) AS n FROM streets GROUP BY 1), k AS (SELECT *, CASE WHEN maxspeed LIKE '% mph' THEN nullif(replace(maxspeed, ' mph', '')::DOUBLE, 0) * 1.609344 ELSE nullif(maxspeed::DOUBLE, 0) END AS own FROM m)
SELECT maxspeed, n, round(CASE WHEN own IS NULL THEN 30 * 1.609344::DOUBLE ELSE (own + 30 * 1.609344::DOUBLE) / 2 END, 6) AS kph FROM k""",
    "scl_05_car_speed": f"WITH {_STREETS} SELECT highway, maxspeed, count(*) AS n, round({_SPEED}, 6) AS kph FROM streets GROUP BY highway, maxspeed",
    "scl_06_duration": "SELECT event_id, round(extract(hour FROM ts) + extract(minute FROM ts) / 60.0::DOUBLE + floor(extract(second FROM ts)) / 3600.0::DOUBLE, 6) AS hours FROM events",
    "scl_07_direction": f"WITH {_STREETS} SELECT oneway, {_DIRECTION} AS direction, count(*) AS n FROM streets GROUP BY 1, 2",
    "win_04_buckets": f"WITH {_BUCKETS} SELECT name, bucket FROM buckets",
    "agg_13_week_speeds": f"WITH {_WEEK} SELECT road, bucket, kph FROM week",
    "jn_34_override": f"""WITH {_WEEK}, e AS (SELECT event_id, user_id, ['primary', 'residential', 'service'][user_id % 3 + 1] AS road, (extract(dow FROM ts) * 288 + (extract(hour FROM ts) * 60 + extract(minute FROM ts)) // 5)::INT AS bucket FROM events)
SELECT event_id, e.road, e.bucket, CASE WHEN user_id % 7 = 0 THEN 12.5 ELSE kph END AS kph FROM e JOIN week w ON w.bucket = e.bucket AND w.road = e.road""",
    "agg_07_degree": f"WITH {_STREETS} SELECT u AS node_id, count(DISTINCT v) AS degree FROM (SELECT u, v FROM streets UNION ALL SELECT v, u FROM streets) GROUP BY 1",
    "agg_09_line_length": f"WITH {_NODES}, {_STREETS} SELECT way_id, round(sum({_LENGTH}), 3) AS length_m, count(*) AS streets FROM streets {_ENDS} GROUP BY 1",
    "agg_12_summary": f"WITH {_STREETS} SELECT count(*) AS streets, count(DISTINCT way_id) AS ways, count(oneway) AS directed, count(*) FILTER (WHERE highway = 'motorway' OR bridge IS NOT NULL) AS separated, count(*) FILTER (WHERE maxspeed IS NULL) AS without_speed FROM streets",
    "win_01_ends": f"WITH {_LINES} SELECT line_id, pos, pos IN (0, 2) AS is_end FROM lines",
    "win_03_lengths": f"WITH {_SEGMENTS} SELECT line_id, pos, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 4) AS length_m FROM seg",
    "jn_09_crossings": f"""WITH {_SEGMENTS} SELECT a.line_id AS line_a, a.pos AS pos_a, b.line_id AS line_b, b.pos AS pos_b FROM seg a JOIN seg b ON a.line_id % 4 = b.line_id % 4 AND a.line_id < b.line_id
 AND {_side('a', 'b', 1)} * {_side('a', 'b', 2)} < 0 AND {_side('b', 'a', 1)} * {_side('b', 'a', 2)} < 0""",
    "jn_01_snap_nodes": f"WITH {_NEAR} SELECT point_id, node_id, nx AS x, ny AS y FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY away, node_id) AS k FROM near WHERE away <= 40) WHERE k = 1",
    "jn_13_new_nodes": f"WITH {_NEAR} SELECT * FROM points p WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.point_id = p.point_id AND away <= 40)",
    "jn_18_integrity": f"""WITH {_NODES}, {_STREETS}, d AS (SELECT u + CASE WHEN line = 7 THEN 5 ELSE 0 END AS "end" FROM streets UNION ALL SELECT v + CASE WHEN line = 7 THEN 5 ELSE 0 END FROM streets) SELECT "end", count(*) AS streets FROM d WHERE "end" NOT IN (SELECT node_id FROM nodes) GROUP BY 1""",
    "grf_08_self_loops": f"WITH {_ALL_STREETS} SELECT okey, line, u AS node_id, way_id FROM streets WHERE u = v",
    "grf_02_pieces": f"WITH {_PIECES} SELECT node_id, piece FROM found",
    "agg_06_largest": f"WITH {_LINE_PIECES}, n AS (SELECT piece, count(*) AS lines FROM found GROUP BY 1) SELECT piece, lines, row_number() OVER (ORDER BY lines DESC, piece) = 1 AS largest FROM n",
    "way_03_chains": f"WITH {_STREETS} SELECT way_id, string_agg(u::VARCHAR || '-' || v::VARCHAR, ';' ORDER BY okey, line, u, v) AS chain FROM streets GROUP BY 1",
    "set_01_union": f"WITH {_STREETS}, {_LINES} SELECT highway, custom, count(*) AS n, sum(u)::BIGINT AS sum_u FROM (SELECT u, highway, NULL AS custom FROM streets UNION ALL SELECT line_id, NULL, 'yes' FROM lines) GROUP BY 1, 2",
    "set_06_difference": f"WITH {_NODES} SELECT c_custkey AS node_id FROM customer WHERE c_custkey NOT IN (SELECT node_id FROM nodes)",
    "set_07_dedupe": f"WITH {_STREETS} SELECT okey, line, way_id, u FROM (SELECT *, row_number() OVER (PARTITION BY okey, line ORDER BY way_id DESC, u DESC) AS k FROM streets) WHERE k = 1",
    "cov_03_crossed": f"""WITH {_SEGMENTS}, c AS (SELECT *, unnest(range(floor(least(x1, x2) / 25)::BIGINT, floor(greatest(x1, x2) / 25)::BIGINT + 1)) AS cx FROM seg), d AS (SELECT *, unnest(range(floor(least(y1, y2) / 25)::BIGINT, floor(greatest(y1, y2) / 25)::BIGINT + 1)) AS cy FROM c)
SELECT cx, cy, count(*) AS segments FROM d WHERE abs((x2 - x1) * (cy * 25 + 12.5 - y1) - (y2 - y1) * (cx * 25 + 12.5 - x1)) <= (abs(x2 - x1) + abs(y2 - y1)) * 12.5 GROUP BY 1, 2""",
    "scl_16_turn_direction": f"""WITH {_SEGMENTS}, h AS (SELECT line_id, pos, degrees(atan2(y2 - y1, x2 - x1)) AS h FROM seg), t AS (SELECT line_id, h - lag(h) OVER (PARTITION BY line_id ORDER BY pos) AS d FROM h),
n AS (SELECT line_id, d - 360 * floor((d + 180) / 360) AS d FROM t WHERE d IS NOT NULL) SELECT line_id, CASE WHEN abs(d) < 35 THEN 'straight' WHEN abs(d) > 150 THEN 'u_turn' WHEN d > 0 THEN 'left' ELSE 'right' END AS turn FROM n""",
}
