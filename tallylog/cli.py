"""Command line: ``python -m tallylog FILE`` prints the report on a log; exit status 2 on any error."""

from __future__ import annotations

import argparse
import os
import sys

from . import __version__


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallylog", description="Summarize large access and application logs")
    p.add_argument("file", nargs="?", default="-", help="log file, directory or glob; - or nothing for standard input")
    p.add_argument("-f", "--format", choices=("access", "app"), help="default: found from the first lines")
    p.add_argument("--latency-unit", choices=("s", "ms", "us"), default="s", help="unit of response times in access logs")
    p.add_argument("--gap", type=float, default=300.0, help="report silences longer than this many seconds")
    p.add_argument("--top", type=int, default=5, help="entries per list")
    p.add_argument("-j", "--threads", type=int, default=0, help="local threads; 0: all processors")
    p.add_argument("--block-mib", type=int, default=128, help="size of an input split")
    p.add_argument("--store", help="folder that keeps what was found; the report is on all that was ever added to it, and only what is new in FILE is read")
    p.add_argument("--json", action="store_true", help="print JSON")
    p.add_argument("-V", "--version", action="version", version=f"tallylog {__version__}")
    return p


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    try:
        if not 0 < args.gap < float("inf"):
            raise ValueError("--gap must be a positive number of seconds")
        path = args.file
        if path != "-" and "://" not in path and not any(c in path for c in "*?[{") and not os.path.exists(path):
            raise ValueError(f"{path}: no such file")
        print(report(path, args), end="")
        return 0
    except Exception as e:
        print(f"tallylog: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 2


def report(path: str, args: argparse.Namespace) -> str:
    from .plans import store
    from .plans.render import to_json, to_text
    from .plans.report import summarize_path
    from .sources.lines import spooled
    from .sources.scratch import dropped, scratch

    spark, folder = session(args), None
    try:
        if path == "-":
            path = folder = spooled(sys.stdin.buffer, scratch(spark, "stdin"), max(1, args.block_mib) << 20)
        if args.store:
            store.add(spark, args.store, os.path.abspath(path) if "://" not in path else path, args.format, args.latency_unit, args.gap, max(1, args.block_mib) << 20)
            found = store.report(spark, args.store, args.top)
        else:
            found = summarize_path(spark, path, fmt=args.format, latency_unit=args.latency_unit, gap_seconds=args.gap, top=args.top)
        return to_json(found) + "\n" if args.json else to_text(found, args.gap)
    finally:
        if folder:
            dropped(spark, folder)


def session(args: argparse.Namespace):
    from pyspark.sql import SparkSession

    build = SparkSession.builder.appName("tallylog").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", f"{max(1, args.block_mib)}m")
    if not os.environ.get("MASTER") and not os.environ.get("SPARK_REMOTE"):
        build = build.master(f"local[{args.threads or '*'}]").config("spark.sql.shuffle.partitions", "16").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = build.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
