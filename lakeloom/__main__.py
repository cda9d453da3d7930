"""Command line: list and run registered queries, show or export a table, report a store's coverage."""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lakeloom", description=__doc__)
    p.add_argument("--cores", default="8")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="names of the registered queries")
    run = sub.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name")
    run.add_argument("folder")
    run.add_argument("--out", help="write Parquet here instead of showing rows")
    run.add_argument("--rows", type=int, default=20)
    explain = sub.add_parser("explain", help="the physical plan of a query")
    explain.add_argument("name")
    explain.add_argument("folder")
    coverage = sub.add_parser("coverage", help="datasets, partitions and rows of a store")
    coverage.add_argument("root")
    bars = sub.add_parser("bars", help="bars of a CSV file as stored")
    bars.add_argument("path")
    a = p.parse_args(args)
    from .plans import registry

    if a.command == "queries":
        print("\n".join(sorted(registry.queries())))
        return 0
    from .session import local_session

    spark = local_session(a.cores)
    if a.command == "coverage":
        from .sources.store import Tables

        Tables(spark, a.root).summary().show(200, truncate=False)
        return 0
    if a.command == "bars":
        from .sources.readers import read_bars_csv

        read_bars_csv(spark, a.path).show(20, truncate=False)
        return 0
    df = registry.queries()[a.name](spark, a.folder)
    if a.command == "explain":
        df.explain("formatted")
    elif a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
