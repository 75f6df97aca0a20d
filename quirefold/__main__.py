"""Command line: collections, records, query, validate, materialize and index over a database of record files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quirefold.errors import QuirefoldError
from quirefold.functions.predicates import parse_filter
from quirefold.sources.database import Database


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quirefold")
    parser.add_argument("--db", default=".")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("collections")
    for name in ("records", "index"):
        commands.add_parser(name).add_argument("collection")
    query = commands.add_parser("query")
    query.add_argument("collection")
    query.add_argument("--filter", action="append", default=[])
    query.add_argument("--order-by")
    query.add_argument("--direction", default="asc")
    commands.add_parser("validate").add_argument("collection", nargs="?")
    view = commands.add_parser("materialize")
    view.add_argument("collection")
    view.add_argument("view")
    view.add_argument("--group-by")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        return _run(args, Database(spark, args.db))
    except (QuirefoldError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(args: argparse.Namespace, db: Database) -> int:
    if args.command == "collections":
        print("\n".join(db.collections()))
        return 0
    if args.command == "validate":
        rows = db.validate(args.collection).collect()
        for r in rows:
            print(f"{r.collection}/{r.path}: {r.field}: [{r.severity}] {r.message}")
        return int(any(r.severity == "error" for r in rows))
    collection = db.collection(args.collection)
    if args.command == "index":
        print(f"indexed {collection.build_index()} records")
        return 0
    if args.command == "materialize":
        print(db.materialize_view(args.view, collection, group_by=args.group_by))
        return 0
    q = collection.query()
    if args.command == "query":
        for spec in args.filter:
            q = q.where(*parse_filter(spec))
        if args.order_by:
            order = q.order_by(args.order_by)
            q = order.desc() if args.direction == "desc" else order.asc()
    n = 0
    for n, row in enumerate(q.iterate(), 1):
        print(row.path)
    print(f"{n} records", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
