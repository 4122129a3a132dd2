"""Command line: ``python -m stallworks <clean | load | check | report | list> ...``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from stallworks.registry import CHECKS, PLANS, VARIANTS
from stallworks.sources.raw_csv import clean_all
from stallworks.sources.warehouse import load_warehouse, read_clean


def _arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="stallworks")
    commands = parser.add_subparsers(dest="command", required=True)

    clean = commands.add_parser("clean", help="raw CSV folder to cleaned tables")
    clean.add_argument("raw")
    clean.add_argument("clean")
    clean.add_argument("--format", choices=("parquet", "csv"), default="parquet")

    load = commands.add_parser("load", help="cleaned tables to a warehouse stored by month")
    load.add_argument("clean")
    load.add_argument("warehouse")

    check = commands.add_parser("check", help="keys, references, NULLs and domains")
    check.add_argument("clean")

    report = commands.add_parser("report", help="print a report, or write it with --out")
    report.add_argument("clean")
    report.add_argument("name", choices=sorted(PLANS | VARIANTS), metavar="name")
    report.add_argument("--rows", type=int, default=50, help="rows to print")
    report.add_argument("--out", help="folder to write the whole report to as Parquet")

    commands.add_parser("list", help="names of all reports")
    for sub in (load, check, report):
        sub.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> None:
    args = _arguments(argv)
    if args.command == "list":
        print("\n".join(sorted(PLANS | VARIANTS)))
        return
    spark = SparkSession.builder.appName("stallworks").getOrCreate()
    if args.command == "clean":
        clean_all(spark, args.raw, args.clean, args.format).show(truncate=False)
        return
    loaded = read_clean(spark, args.clean, args.format)
    for name in loaded.missing:
        print(f"skipped {name}: not found")
    if args.command == "load":
        for name, path in load_warehouse(loaded.tables, args.warehouse).items():
            print(f"{name}: {path}")
    elif args.command == "check":
        for check in CHECKS.values():
            check(loaded.tables).show(100, truncate=False)
    else:
        report = (PLANS | VARIANTS)[args.name](loaded.tables)
        if args.out:
            report.write.mode("overwrite").parquet(args.out)
        else:
            report.show(args.rows, truncate=False)


if __name__ == "__main__":
    main()
