"""A network out of layers: checks of features, presets, build and output."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import projection, tags
from .operators.build import build, numbered
from .operators.relations import rewrite
from .sinks.files import chains, line_ways, write_osm_xml
from .sources.files import InputError, Osm, keeps_relation, read_geojson, read_osm_xml, steps

# Presets of tags for drawn lines.
PRESETS = {
    "motorway": {"highway": "motorway", "oneway": "no"}, "trunk_road": {"highway": "trunk", "oneway": "no"}, "primary_road": {"highway": "primary", "oneway": "no"},
    "secondary_road": {"highway": "secondary", "oneway": "no"}, "tertiary_road": {"highway": "tertiary", "oneway": "no"}, "residential_street": {"highway": "residential", "oneway": "no"},
    "service_road": {"highway": "service", "oneway": "no"}, "cycleway": {"highway": "cycleway", "oneway": "no"}, "footpath": {"highway": "footway"},
    "shared_path": {"highway": "path", "bicycle": "designated", "foot": "designated"}, "pedestrian_street": {"highway": "pedestrian", "bicycle": "yes"},
    "car_free_street": {"highway": "residential", "motor_vehicle": "no", "oneway": "no"},
}


@dataclass(frozen=True)
class Network:
    """nodes: node_id, lon, lat, existing. edges: custom, line_id, part, u, v, length. line_tags: line_id, feature_id, tags. source: the existing data."""

    nodes: DataFrame
    edges: DataFrame
    line_tags: DataFrame
    source: Osm | None

    def write_osm(self, path: str) -> None:
        """OSM XML: existing ways as they are but for the nodes that cuts put in, drawn lines as new ways.

        Restrictions and routes that still make sense are written on what their ways became.
        """
        mine = self.edges.where("custom")
        ways = line_ways(mine, self.line_tags.select("line_id", "tags"))
        nodes = self.nodes.select("node_id", "lon", "lat")
        rels = None
        if self.source is not None:
            old_tags = self.source.nodes.select("node_id", "tags")
            nodes = nodes.join(old_tags, "node_id", "left")
            step = self.edges.where("not custom").join(_numbered_steps(self.source).select("line_id", "way_id", "pos"), "line_id")
            old = chains(step, "way_id", ["pos", "part"]).join(self.source.ways.select("way_id", "tags"), "way_id")
            top = self.source.ways.agg(F.max("way_id")).first()[0] or 0
            # Further stretches of a way that lacks steps get ids above all known ones, then the drawn lines.
            more = numbered(old.where("run > 0").withColumn("key", F.struct("way_id", "run")).drop("way_id"), "key", top + 1, "way_id")
            top += more.count()
            ways = ways.withColumn("way_id", F.col("way_id") + top)
            for d in (old.where("run = 0"), more):
                ways = ways.unionByName(d.select("way_id", "refs", "tags"))
            written = old.where("run = 0").select("way_id", F.lit(0).alias("part"), F.col("way_id").alias("piece_id"), "refs")
            written = written.unionByName(more.select(F.col("key.way_id").alias("way_id"), F.col("key.run").cast("int").alias("part"), F.col("way_id").alias("piece_id"), "refs"))
            kept = self.source.relations.where(keeps_relation(tags.from_map(F.col("tags")), F.map_keys("tags")))
            rels = rewrite(kept, self.source.ways, written, nodes.select("node_id"))
        else:
            nodes = nodes.withColumn("tags", F.lit(None).cast("map<string,string>"))
        write_osm_xml(nodes, ways, path, rels)


def _numbered_steps(source: Osm) -> DataFrame:
    """Steps with an id of their own: way and position, as one number (up to 65,536 nodes a way)."""
    return steps(source).withColumn("line_id", F.col("way_id") * 65536 + F.col("pos"))


def features(layer: DataFrame, blanket: dict[str, str] | None = None, overwrite: bool = False) -> DataFrame:
    """Features with tags: text attributes, blanket tags where none is given (all of them with overwrite)."""
    extra = F.create_map(*(F.lit(t) for kv in (blanket or {}).items() for t in kv)).cast("map<string,string>")
    low, high = (F.col("attrs"), extra) if overwrite else (extra, F.col("attrs"))
    return layer.withColumn("tags", F.map_concat(F.map_filter(low, lambda k, _: ~F.array_contains(F.map_keys(high), k)), high))


def problems(layer: DataFrame, blanket: dict[str, str] | None = None) -> DataFrame:
    """feature_id, part, problems: what keeps a feature from being a line or point of the network; an empty list if nothing does."""
    d, get = features(layer, blanket), tags.from_map(F.col("tags"))
    off = F.exists("coords", lambda p: F.coalesce((F.size(p) < 2) | (F.abs(p[0]) > 180) | (F.abs(p[1]) > 90) | F.isnan(p[0]) | F.isnan(p[1]), F.lit(True)))
    kind = F.coalesce(F.col("geom_type").isin("LineString", "MultiLineString", "Point", "MultiPoint"), F.lit(False))
    line = F.coalesce(F.col("geom_type").endswith("LineString"), F.lit(False))
    found = {"no line or point": ~kind | F.col("coords").isNull(), "off the earth": F.coalesce(off, F.lit(False)), "no mode may use it": line & (F.size(tags.usable_modes(get)) == 0)}
    named = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in found.items())))
    return d.select("feature_id", "part", F.concat(named, F.transform(tags.value_problems(get), lambda k: F.concat(F.lit("value of "), k))).alias("problems"))


def build_network(layer: DataFrame, source: Osm | None = None, blanket: dict[str, str] | None = None, overwrite: bool = False, snap_tolerance: float = 1.0, join_at: str = "crossings", strict: bool = True) -> Network:
    """The network of a layer's lines (lon, lat), joined to existing data where given.

    With strict a feature with problems stops the build, otherwise it stays out. Lengths are metres in the UTM zone of the layer's middle.
    """
    bad = problems(layer, blanket).where(F.size("problems") > 0)
    if strict:
        first = bad.orderBy("feature_id", "part").limit(11).collect()  # named in the message
        if first:
            raise InputError("; ".join(f"feature {r.feature_id}: {', '.join(r.problems)}" for r in first[:10]) + ("; and more" if len(first) > 10 else ""))
    d = features(layer, blanket, overwrite).where(F.col("geom_type").endswith("LineString")).join(bad.select("feature_id", "part"), ["feature_id", "part"], "left_anti")
    d = numbered(d.withColumn("key", F.struct("feature_id", "part")), "key", 0, "line_id").drop("key")
    box = d.select(F.explode("coords").alias("p")).agg(F.avg(F.col("p")[0]).alias("lon"), F.min(F.col("p")[1]).alias("lat")).first()
    if box.lon is None:
        raise InputError("No line to build")
    zone, south = projection.zone(box.lon), box.lat < 0
    get = tags.from_map(F.col("tags"))
    v = d.select("line_id", tags.grade_separated(get).alias("separated"), tags.layer(get).alias("layer"), F.posexplode("coords").alias("pos", "p"))
    x, y = projection.to_utm(F.col("p")[0], F.col("p")[1], zone, south)
    v = v.select("line_id", "pos", x.alias("x"), y.alias("y"), "separated", "layer")
    nodes = edges = None
    if source is not None:
        s = _numbered_steps(source)
        edges = s.select(F.col("line_id").alias("edge_id"), "u", "v", tags.grade_separated(get).alias("separated"), tags.layer(get).alias("layer"))
        used = edges.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
        x, y = projection.to_utm(F.col("lon"), F.col("lat"), zone, south)
        nodes = source.nodes.join(used, "node_id", "left_semi").select("node_id", x.alias("x"), y.alias("y"))
    n, e = build(v, nodes, edges, snap_tolerance, join_at)
    lon, lat = projection.to_degrees(F.col("x"), F.col("y"), zone, south)
    return Network(n.select("node_id", lon.alias("lon"), lat.alias("lat"), "existing"), e, d.select("line_id", "feature_id", "tags"), source)


def build_files(spark: SparkSession, custom: str, out: str, osm: str | None = None, **more) -> Network:
    """Reads a GeoJSON layer and maybe OSM XML, builds, writes OSM XML."""
    net = build_network(read_geojson(spark, custom), read_osm_xml(spark, osm) if osm else None, **more)
    net.write_osm(out)
    return net
