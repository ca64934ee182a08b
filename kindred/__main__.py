"""python -m kindred update [--backfill] (--data FOLDER | --jdbc URL) [--models FOLDER] | similar --post ID ..."""

from __future__ import annotations

import argparse
import logging
from dataclasses import replace

from pyspark.sql import SparkSession

from kindred.config import EngineConfig
from kindred.engine import Engine, Sources, backfill, update


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kindred")
    commands = parser.add_subparsers(dest="command", required=True)
    up = commands.add_parser("update", help="fold new events, or rebuild all")
    up.add_argument("--backfill", action="store_true")
    where = up.add_mutually_exclusive_group(required=True)
    where.add_argument("--data", help="folder with posts, tags, favorites and favorite_events as Parquet")
    where.add_argument("--jdbc", help="URL of a database with these tables")
    up.add_argument("--jdbc-option", action="append", default=[], metavar="NAME=VALUE", help="for instance driver=..., user=..., password=...")
    ask = commands.add_parser("similar", help="print the posts most similar to one")
    ask.add_argument("--post", type=int, required=True)
    ask.add_argument("--limit", type=int, default=6)
    ask.add_argument("--mode", default="favorites")
    ask.add_argument("--explain", action="store_true")
    for p in (up, ask):
        p.add_argument("--models")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("kindred").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config = EngineConfig.from_env()
    config = replace(config, model_dir=args.models) if args.models else config
    if args.command == "update":
        options = dict(x.split("=", 1) for x in args.jdbc_option)
        sources = Sources.parquet(spark, args.data) if args.data else Sources.jdbc(spark, args.jdbc, **options)
        print((backfill if args.backfill else update)(spark, sources, config))
    else:
        Engine.open(spark, config).similar(args.post, args.limit, args.explain, mode=args.mode).orderBy("rank").show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
