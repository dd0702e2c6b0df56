"""Files of a network: OSM XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.build import numbered


def xml_text(text: Column) -> Column:
    """Text for an XML attribute in double quotes; characters that XML 1.0 can't hold go."""
    out = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _element(name: str, key: str, attrs: list[tuple[str, Column]], body: Column | None, tags: Column) -> Column:
    head = F.concat(F.lit(f'  <{name} id="'), F.col(key).cast("string"), F.lit('"'), *(F.concat(F.lit(f' {k}="'), v, F.lit('"')) for k, v in attrs), F.lit(' version="1">'))
    lines = F.transform(F.array_sort(F.map_entries(F.coalesce(tags, F.create_map().cast("map<string,string>")))), lambda t: F.concat(F.lit('    <tag k="'), xml_text(t["key"]), F.lit('" v="'), xml_text(t["value"]), F.lit('"/>')))
    lines = F.filter(lines, lambda x: x.isNotNull())
    return F.array_join(F.concat(F.array(head), body if body is not None else F.array().cast("array<string>"), lines, F.array(F.lit(f"  </{name}>"))), "\n")


def osm_lines(nodes: DataFrame, ways: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """kind, id, value: the elements of an OSM XML document as text, to be put in the order of kind and id.

    nodes: node_id, lon, lat, tags; ways: way_id, refs, tags; relations: rel_id, tags, members (type, ref, role).
    """
    degree = lambda c: F.format_string("%.7f", F.col(c))
    n = nodes.select(F.lit(1).alias("kind"), F.col("node_id").alias("id"), _element("node", "node_id", [("lat", degree("lat")), ("lon", degree("lon"))], None, F.col("tags")).alias("value"))
    refs = F.transform("refs", lambda r: F.concat(F.lit('    <nd ref="'), r.cast("string"), F.lit('"/>')))
    out = n.union(ways.select(F.lit(2), "way_id", _element("way", "way_id", [], refs, F.col("tags"))))
    if relations is not None:
        member = F.transform("members", lambda m: F.concat(F.lit('    <member type="'), m["type"], F.lit('" ref="'), m["ref"].cast("string"), F.lit('" role="'), xml_text(F.coalesce(m["role"], F.lit(""))), F.lit('"/>')))
        out = out.union(relations.select(F.lit(3), "rel_id", _element("relation", "rel_id", [], member, F.col("tags"))))
    return out


def write_osm_xml(nodes: DataFrame, ways: DataFrame, path: str, relations: DataFrame | None = None) -> None:
    """OSM XML: a folder of text parts which, in the order of their names, are one document, sorted by kind and id.

    A path that ends in .osm becomes one file: the parts are copied behind each other through the file system, never held in memory.
    """
    spark = nodes.sparkSession
    box = nodes.agg(*(f(c).alias(k) for f, c, k in ((F.min, "lat", "minlat"), (F.min, "lon", "minlon"), (F.max, "lat", "maxlat"), (F.max, "lon", "maxlon"))))
    sides = F.concat(*(F.concat(F.lit(f' {k}="'), F.format_string("%.7f", F.col(k)), F.lit('"')) for k in ("minlat", "minlon", "maxlat", "maxlon")))
    head = box.select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<osm version="0.6" generator="streetloom">'), F.coalesce(F.concat(F.lit("\n  <bounds"), sides, F.lit("/>")), F.lit(""))).alias("value"))
    foot = spark.range(1).select(F.lit(4), F.lit(0).cast("long"), F.lit("</osm>"))
    text = head.union(osm_lines(nodes, ways, relations)).union(foot).repartitionByRange("kind", "id").sortWithinPartitions("kind", "id").select("value")
    if not path.endswith(".osm"):
        text.write.mode("overwrite").text(path)
        return
    parts = path + ".parts"
    text.write.mode("overwrite").text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(parts)
    fs = folder.getFileSystem(conf)
    names = sorted(s.getPath().toString() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    out = fs.create(jvm.org.apache.hadoop.fs.Path(path), True)
    for name in names:
        part = fs.open(jvm.org.apache.hadoop.fs.Path(name))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
        part.close()
    out.close()
    fs.delete(folder, True)


def chains(edges: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, run, refs: the nodes of each stretch of edges (u, v) of one key that follow each other in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    d = edges.withColumn("new", F.when(F.lag("v").over(w).eqNullSafe(F.col("u")), 0).otherwise(1)).withColumn("run", F.sum("new").over(w) - 1)
    d = d.groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct(*order, "u", "v"))).alias("s"))
    return d.select(key, "run", F.concat(F.array(F.col("s")[0]["u"]), F.col("s.v")).alias("refs"))


def line_ways(edges: DataFrame, tags: DataFrame) -> DataFrame:
    """way_id, refs, tags out of edges (line_id, part, u, v): a way for each stretch of a line."""
    d = chains(edges, "line_id", ["part"]).join(tags, "line_id", "left").withColumn("first", F.struct("line_id", "run"))
    return numbered(d, "first", 1, "way_id").select("way_id", "refs", "tags")
