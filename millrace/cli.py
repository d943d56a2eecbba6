"""Command line: ``gen``, ``info`` and ``scan`` over one table.

Exit codes: 0, 1 for an engine error, 2 for a wrong call.
"""

from __future__ import annotations

import argparse
import sys

from millrace.errors import EngineError
from millrace.functions import count_rows, sum_
from millrace.functions.expressions import ColumnRef, parse_comparison
from millrace.functions.types import format_value, parse_literal
from millrace.plans import run, table
from millrace.session import session
from millrace.sources.datagen import generate
from millrace.sources.inspect import prune_estimate, table_report
from millrace.sources.tables import ROWS_PER_GROUP, read_table, write_table


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace", description="columnar tables on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    gen = sub.add_parser("gen", help="write a synthetic table")
    gen.add_argument("path")
    gen.add_argument("rows", type=int)
    gen.add_argument("rows_per_group", type=int, nargs="?", default=ROWS_PER_GROUP)
    info = sub.add_parser("info", help="schema, encodings and value ranges")
    info.add_argument("path")
    scan = sub.add_parser("scan", help="scan, filter, group")
    scan.add_argument("path")
    scan.add_argument("--where", nargs=3, action="append", default=[], metavar=("COL", "OP", "VALUE"))
    scan.add_argument("--no-pushdown", action="store_true", help="filter without skipping row groups")
    scan.add_argument("--group-by", action="append", default=[], metavar="COL")
    scan.add_argument("--sum", metavar="COL")
    scan.add_argument("--limit", type=int, default=10, help="rows or groups to print")
    sub.add_parser("help", help="this text")
    return p


def _print(columns: list[str], rows: list) -> None:
    print("".join(f"{c:<20}" for c in columns).rstrip())
    for r in rows:
        print("".join(f"{format_value(v):<20}" for v in r).rstrip())


def _gen(args) -> None:
    spark = session()
    write_table(generate(spark, args.rows), args.path, args.rows_per_group, cluster_by=["day"])
    print(f"wrote {args.rows:,} rows")


def _info(args) -> None:
    spark = session()
    read_table(spark, args.path)
    report = table_report(spark, args.path).collect()
    print(f"{report[0]['rows'] if report else 0:,} rows, {report[0]['row_groups'] if report else 0:,} row groups")
    _print(["column", "type", "encoding", "bytes", "bits_per_row", "nulls", "range"], [(r["column"], r["type"], r["encoding"], r["bytes"], round(r["bits_per_row"], 2), r["nulls"], r["range"]) for r in report])
    if any(r["encoding"].endswith("*") for r in report):
        print("* encoding differs between row groups")


def _scan(args) -> None:
    spark = session()
    schema = read_table(spark, args.path).schema
    where = [(c, parse_comparison(op), parse_literal(v, ColumnRef(c).type(schema))) for c, op, v in args.where]
    query = table(spark, args.path, where=where, pushdown=not args.no_pushdown)
    if args.group_by:
        grouped = query.aggregate(args.group_by, [count_rows("count"), *([sum_(args.sum, "sum")] if args.sum else [])])
        shown = grouped.df.orderBy(*args.group_by)
        _print(shown.columns, shown.limit(args.limit).collect())
        print(f"{grouped.count():,} groups")
    else:
        _print(query.df.columns, query.limit(args.limit).collect())
    groups = prune_estimate(spark, args.path, [] if args.no_pushdown else where)
    print(f"row groups {groups.groups_read:,} of {groups.groups_total:,} read ({groups.skip_rate:.1%} skipped)")
    print(f"rows decoded {run(query.df).rows_scanned:,}")


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    if args.command == "help":
        parser.print_help()
        return 0
    try:
        {"gen": _gen, "info": _info, "scan": _scan}[args.command](args)
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
