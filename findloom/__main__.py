"""Command line: ``python -m findloom opt|pkg|db build|index``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from findloom.api import CrawlOptions, Engine
from findloom.errors import EngineError
from findloom.functions.text import parse_attrs
from findloom.schemas import OPTIONS, PACKAGES


def default_db() -> str:
    return os.path.join(os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache"), "findloom", "files")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="findloom")
    top.add_argument("--json", action="store_true")
    top.add_argument("--verbose", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    opt = commands.add_parser("opt")
    source = opt.add_mutually_exclusive_group(required=True)
    source.add_argument("--module-options")
    source.add_argument("--db")
    opt.add_argument("query")
    pkg = commands.add_parser("pkg")
    pkg.add_argument("--db", default=default_db())
    pkg.add_argument("query")
    build = commands.add_parser("db").add_subparsers(dest="action", required=True).add_parser("build")
    build.add_argument("--manifest", required=True)
    build.add_argument("--output", required=True)
    index = commands.add_parser("index")
    index.add_argument("--output", default=default_db())
    index.add_argument("--enumeration", action="append", required=True, help="[attr=]file.xml")
    index.add_argument("--cache-dir", required=True)
    index.add_argument("--system", default="")
    which = index.add_mutually_exclusive_group()
    which.add_argument("--scope", default="")
    which.add_argument("--attrs", default="")
    index.add_argument("--follow-refs", action=argparse.BooleanOptionalAction, default=False)
    return top


def run(args: argparse.Namespace, engine: Engine) -> list[str]:
    """The lines to print."""
    if args.command in ("opt", "pkg"):
        if args.command == "opt" and args.module_options:
            db = engine.options_from_json(args.module_options)
        else:
            db = engine.open(args.db, OPTIONS if args.command == "opt" else PACKAGES)
        return [r["value"] for r in db.search(args.query, "json" if args.json else "text").toLocalIterator()]
    if args.command == "db":
        said = engine.build(args.manifest, args.output)
    else:
        runs = [tuple(e.split("=", 1)) if "=" in os.path.basename(e) else ("", e) for e in args.enumeration]
        options = CrawlOptions(runs, args.cache_dir, args.scope, parse_attrs(args.attrs), args.system, args.follow_refs)
        said = engine.crawl(options, args.output)
    return [json.dumps(said)] if args.json else [", ".join(f"{k}: {v}" for k, v in said.items())]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("findloom").getOrCreate()
    if not args.verbose:
        spark.sparkContext.setLogLevel("ERROR")
    try:
        for line in run(args, Engine(spark)):
            print(line)
    except EngineError as error:
        print(f"findloom: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
