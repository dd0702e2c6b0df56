"""Scans of files: OSM XML, GeoJSON, speed tables, bands, areas."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions import tags, traffic

_TAGS = "tag array<struct<_k: string, _v: string>>"
#: Kinds of relations a router acts on.
ROUTES = ("bicycle", "bus", "foot", "hiking", "mtb")


@dataclass(frozen=True)
class Osm:
    """nodes: node_id, lon, lat, tags. ways: way_id, refs, tags. relations: rel_id, tags, members (type, ref, role)."""

    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame


def _map(tag: str = "tag") -> Column:
    """Tags as a map; of a key given twice the last value."""
    pairs = F.coalesce(F.col(tag), F.array().cast("array<struct<_k: string, _v: string>>"))
    return F.map_from_arrays(F.array_distinct(F.transform(pairs, lambda t: t["_k"])), F.transform(F.array_distinct(F.transform(pairs, lambda t: t["_k"])), lambda k: F.element_at(F.filter(pairs, lambda t: t["_k"] == k), -1)["_v"]))


def read_osm_xml(spark: SparkSession, path: str) -> Osm:
    """OSM XML, also gzipped or as a folder of parts; of elements with one id the last by version stays."""

    def scan(row: str, schema: str) -> DataFrame:
        d = spark.read.format("xml").option("rowTag", row).schema(f"_id long, _version long, {schema}, {_TAGS}").load(path).where("_id is not null")
        w = Window.partitionBy("_id").orderBy(F.col("_version").desc_nulls_last(), *(F.col(c.split()[0]).cast("string") for c in schema.split(", ")[:1]))
        return d.withColumn("_k", F.row_number().over(w)).where("_k = 1")

    nodes = scan("node", "_lat double, _lon double").select(F.col("_id").alias("node_id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), _map().alias("tags"))
    ways = scan("way", "nd array<struct<_ref: bigint>>").select(F.col("_id").alias("way_id"), F.coalesce(F.col("nd._ref"), F.array().cast("array<bigint>")).alias("refs"), _map().alias("tags"))
    member = F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")))
    rels = scan("relation", "member array<struct<_type: string, _ref: bigint, _role: string>>").select(F.col("_id").alias("rel_id"), _map().alias("tags"), member.alias("members"))
    return Osm(nodes, ways, rels)


def keeps_relation(tag: tags.Get, keys: Column) -> Column:
    kind = F.coalesce(tag("type"), F.lit(""))
    return kind.isin("restriction", "connectivity") | F.exists(keys, lambda k: k.startswith("restriction:")) | ((kind == "route") & F.coalesce(tag("route").isin(*ROUTES), F.lit(False)))


def steps(osm: Osm, mode: str | None = None) -> DataFrame:
    """Streets of ways from node to node: way_id, pos, u, v, tags; a step with an unknown node or of a node to itself goes.

    With a mode only ways that it may use. Ferries and ways without highway go.
    """
    get = tags.from_map(F.col("tags"))
    ways = osm.ways.where(tags.allows_mode(get, mode) if mode else F.lit(True)).where(F.col("tags")["highway"].isNotNull())
    pair = F.transform(F.slice("refs", 1, F.greatest(F.size("refs") - 1, F.lit(0))), lambda r, i: F.struct(i.alias("pos"), r.alias("u"), F.get(F.col("refs"), i + 1).alias("v")))
    d = ways.select("way_id", "tags", F.explode(pair).alias("s")).select("way_id", "s.*", "tags").where("u <> v")
    known = osm.nodes.select("node_id")
    return d.join(known, d["u"] == known["node_id"], "left_semi").join(known, d["v"] == known["node_id"], "left_semi")


def known_runs(osm: Osm) -> DataFrame:
    """way_id, run, refs: the longest stretches of two or more nodes in a row that are known."""
    d = osm.ways.select("way_id", F.posexplode("refs").alias("pos", "ref"))
    d = d.join(osm.nodes.select(F.col("node_id").alias("ref")), "ref")
    d = d.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("way_id").orderBy("pos")))
    d = d.groupBy("way_id", "island").agg(F.array_sort(F.collect_list(F.struct("pos", "ref"))).alias("s")).where(F.size("s") >= 2)
    return d.select("way_id", (F.row_number().over(Window.partitionBy("way_id").orderBy("island")) - 1).alias("run"), F.col("s.ref").alias("refs"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """feature_id, part, geom_type, coords array<array<double>>, attrs map<string, string>: one row a line or point.

    Multi-geometries come apart; other geometries stay with null coords. Numbers keep their text; null attributes go. A file is one
    JSON document, read by one task; a layer beyond that comes as many files.
    """
    feature = "struct<id: string, geometry: string, properties: map<string, string>>"
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"features array<{feature}>")["features"]).alias("f"))
    d = d.select("f.*").withColumn("geom_type", F.get_json_object("geometry", "$.type")).withColumn("c", F.get_json_object("geometry", "$.coordinates"))
    line, many = F.from_json("c", "array<array<double>>"), F.from_json("c", "array<array<array<double>>>")
    point = F.array(F.from_json("c", "array<double>"))
    parts = F.when(F.col("geom_type") == "LineString", F.array(line)).when(F.col("geom_type") == "MultiLineString", many).when(F.col("geom_type") == "Point", F.array(point)).when(F.col("geom_type") == "MultiPoint", F.transform(line, lambda p: F.array(p)))
    d = d.withColumn("feature_id", F.coalesce("id", F.col("properties")["fid"], F.col("properties")["id"]))
    attrs = F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())
    return d.select("feature_id", "geom_type", attrs.alias("attrs"), F.posexplode_outer(parts).alias("part", "coords")).select("feature_id", "part", "geom_type", "coords", "attrs")


def read_extent(text: str) -> tuple[float, float, float, float]:
    """'W,S,E,N' in degrees."""
    try:
        w, s, e, n = (float(v) for v in text.split(","))
    except ValueError:
        raise InputError(f"An area is W,S,E,N, not {text!r}") from None
    if not (w < e and s < n and abs(w) <= 180 and abs(e) <= 180 and abs(s) <= 90 and abs(n) <= 90):
        raise InputError(f"An area needs W < E and S < N on the earth: {text!r}")
    return w, s, e, n


def read_bands(spark: SparkSession, path: str) -> DataFrame:
    """Bands of a TOML or JSON settings file (key band): name, days, start, end, roads, factor, speed. All faults are named at once."""
    with open(path, "rb") as f:
        settings = json.load(f) if path.endswith(".json") else tomllib.load(f)
    rows = settings.get("band") if isinstance(settings, dict) else None
    if not isinstance(rows, list) or not rows or not all(isinstance(r, dict) for r in rows):
        raise InputError("The traffic settings need a list of tables under band")
    known = ("name", "days", "time", "roads", "factor", "speed_kph")
    odd = sorted({k for r in rows for k in r} - set(known))
    text = lambda v: None if v is None or isinstance(v, bool) else str(v)
    flat = [(i, text(r.get("name")) or f"Band {i}", text(r.get("days", "Mo-Su")), text(r.get("time")), [str(x) for x in ([r["roads"]] if isinstance(r.get("roads"), str) else r.get("roads") or [])], text(r.get("factor")), text(r.get("speed_kph"))) for i, r in enumerate(rows, 1)]
    d = spark.createDataFrame(flat, "number int, name string, days string, time string, roads array<string>, factor string, speed_kph string")
    d = d.select("number", "name", traffic.days(F.col("days")).alias("days"), traffic.time_range(F.col("time")).alias("time"), traffic.roads(F.col("roads")).alias("roads"), traffic.rate(F.col("factor"), F.col("speed_kph")).alias("rate"))
    bad = [f"band {r.number} ({r.name}): {', '.join(k for k in ('days', 'time', 'roads', 'rate') if r[k] is None)}" for r in d.collect() if None in tuple(r)]  # a settings file's rows
    if odd or bad:
        raise InputError("; ".join(bad + [f"unknown setting {k}" for k in odd]))
    return d.select("name", "days", "time.start", "time.end", "roads", "rate.factor", "rate.speed")


def read_speed_table(spark: SparkSession, path: str) -> DataFrame:
    """Speed rows by way id from CSV, all text; problems names the fields that break their rule, an empty list if none does."""
    d = spark.read.csv(path, header=True, inferSchema=False)
    if not {"osm_id", "osmid"} & set(d.columns):
        raise InputError("A speed table needs a column osm_id")
    get = lambda k: F.col(k) if k in d.columns else F.lit(None).cast("string")
    way = F.coalesce(get("osm_id"), get("osmid"))
    fields = [get(k) for k in ("days", "time", "factor", "speed_kph", "direction")]
    day = F.when(traffic.empty(fields[0]), "Mo-Su").otherwise(fields[0])
    side = F.lower(F.trim(F.when(traffic.empty(fields[4]), "both").otherwise(fields[4])))
    rate, time = traffic.rate(fields[2], fields[3]), traffic.time_range(fields[1])
    return d.select(traffic.number(way).cast("long").alias("way_id"), traffic.days(day).alias("days"), time["start"].alias("start"), time["end"].alias("end"), rate["factor"].alias("factor"), rate["speed"].alias("speed"), side.alias("direction"), traffic.row_problems(*fields, way).alias("problems"))
