"""Command line: build, check, presets. Exit codes: 0 done, 1 other errors, 2 wrong arguments, 3 input that can't be used, 5 a network that breaks a rule."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api
from .errors import StreetloomError
from .functions import tags


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="streetloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("build", "check"):
        c = sub.add_parser(name)
        c.add_argument("--custom", required=True, help="GeoJSON layer")
        c.add_argument("--preset", choices=sorted(api.PRESETS))
        c.add_argument("--tag", action="append", default=[], metavar="KEY=VALUE")
        if name == "build":
            c.add_argument("--out", required=True, help="OSM XML: a file *.osm, else a folder of parts")
            c.add_argument("--osm", help="existing network, OSM XML")
            c.add_argument("--overwrite-tags", action="store_true")
            c.add_argument("--snap-tolerance", type=float, default=1.0)
            c.add_argument("--join-at", choices=("crossings", "vertices"), default="crossings")
            c.add_argument("--lenient", action="store_true", help="leave out features with problems")
    sub.add_parser("presets")
    return p


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("streetloom").getOrCreate()
    emit = lambda **event: print(json.dumps(event))
    try:
        if args.command == "presets":
            d = spark.createDataFrame(list(api.PRESETS.items()), "name string, tags map<string,string>")
            for r in d.select("name", "tags", tags.usable_modes(tags.from_map(F.col("tags"))).alias("modes")).collect():  # twelve rows
                emit(event="preset", name=r.name, tags=r.tags, modes=r.modes)
            return 0
        if not all("=" in t for t in args.tag):
            parser.error("--tag takes KEY=VALUE")
        blanket = dict(api.PRESETS[args.preset] if args.preset else {}) | dict(t.split("=", 1) for t in args.tag)
        if args.command == "check":
            bad = api.problems(api.read_geojson(spark, args.custom), blanket).where(F.size("problems") > 0)
            n = 0
            for r in bad.orderBy("feature_id", "part").toLocalIterator():
                n += 1
                emit(event="problem", feature=r.feature_id, problems=r.problems)
            emit(event="done", problems=n)
            return 3 if n else 0
        net = api.build_files(spark, args.custom, args.out, args.osm, blanket=blanket, overwrite=args.overwrite_tags, snap_tolerance=args.snap_tolerance, join_at=args.join_at, strict=not args.lenient)
        emit(event="done", nodes=net.nodes.count(), edges=net.edges.count(), custom=net.edges.where("custom").count(), out=args.out)
        return 0
    except StreetloomError as e:
        emit(event="error", type=type(e).__name__, message=str(e), issues=e.issues)
        return e.exit_code


if __name__ == "__main__":
    sys.exit(main())
