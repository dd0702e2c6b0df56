"""The street network that the driver's tables stand for: nodes, streets, lines, points, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name, days (0 Sunday), from and to in minutes (to before from: past midnight), road classes, factor, speed.
BANDS = (
    ("peak", (1, 2, 3, 4, 5), 420, 570, ("primary", "residential"), 0.6, None),
    ("evening", (1, 2, 3, 4, 5), 960, 1110, ("primary",), 0.5, None),
    ("night", (5, 6), 1320, 120, ("primary", "residential", "service"), None, 25.0),
    ("sunday", (0,), 0, 1440, ("service",), 1.2, None),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(s.alias("node_id"), ((s % 10) * 100).cast("double").alias("x"), (F.floor(s / 10) * 100).cast("double").alias("y"))


def streets(spark: SparkSession, sf_dir: str, loops: bool = False) -> DataFrame:
    """One row a street: order key and line, u, v, way_id and tag columns; u = v is left out, unless loops are wanted."""
    li, part, orders = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    size = table(spark, sf_dir, "supplier").agg(F.count("*").alias("size"))  # one row
    d = li.join(part, li["l_partkey"] == part["p_partkey"]).join(orders, li["l_orderkey"] == orders["o_orderkey"]).crossJoin(F.broadcast(size))
    first = F.substring("o_orderpriority", 1, 1)
    kind = F.when(F.col("p_type").startswith("PROMO"), "motorway").when(F.col("p_type").startswith("LARGE"), "primary").when(F.col("p_type").startswith("STANDARD"), "residential").when(F.col("p_type").startswith("MEDIUM"), "cycleway").when(F.col("p_type").startswith("SMALL"), "footway").otherwise("service")
    n = F.col("l_linenumber")
    out = d.select(
        F.col("l_orderkey").alias("okey"), n.alias("line"), F.col("l_suppkey").alias("u"), ((F.col("l_suppkey") + n) % F.col("size")).alias("v"), F.col("p_partkey").alias("way_id"), kind.alias("highway"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.col("p_size").cast("string"), F.lit(" mph"))).when(F.col("l_returnflag") == "R", F.col("p_size").cast("string")).alias("maxspeed"),
        F.when(n % 3 == 0, "yes").when(n % 5 == 0, "-1").alias("oneway"), F.when(first == "1", "private").alias("access"), F.when(first == "2", "no").alias("motor_vehicle"),
        F.when(first == "3", "designated").alias("bicycle"), F.when(first == "4", "yes").alias("foot"), F.when((F.col("l_linestatus") == "O") & (n == 7), "yes").alias("bridge"), (n % 2).cast("string").alias("layer"))
    return out if loops else out.where("u <> v")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom lines of three vertices: line_id, pos, x, y, one row a vertex."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line_id"), F.col("embedding").cast("array<double>").alias("e"))
    at = F.expr("explode(array(named_struct('pos', 0, 'x', e[0] * 1000, 'y', e[1] * 1000), named_struct('pos', 1, 'x', e[2] * 1000, 'y', e[3] * 1000), named_struct('pos', 2, 'x', e[4] * 1000, 'y', e[5] * 1000))) as p")
    return e.select("line_id", at).select("line_id", "p.pos", "p.x", "p.y")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("point_id"), (k * 37 % 1000).cast("double").alias("x"), (k * 91 % 1000).cast("double").alias("y"))


def bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, list(d), a, b, list(r), f, s) for n, d, a, b, r, f, s in BANDS], "name string, days array<int>, start_min int, end_min int, roads array<string>, factor double, speed double")
