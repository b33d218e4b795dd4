"""The summary of a log: parse once, keep the narrow rows, aggregate them several ways."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.times import minute_label, utc_text
from ..functions.words import level_name
from ..operators import folding, parsers, series, sketch
from ..operators.parsers import LogFormat
from ..sources.lines import head_of, read_lines
from ..sources.scratch import dropped, scratch

QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}
#: Timed requests a route needs to be listed as slow, and examples of each kind.
MIN_ROUTE_SAMPLES, MAX_EXAMPLES = 20, 5


#: Keeps generated methods below the 8,000 bytes up to which the JVM compiles them; beyond, each operator gets methods of its own.
COMPILED = {"spark.sql.codegen.hugeMethodLimit": "8000"}
#: Rows of facts up to which one task works them up, so that nothing is shuffled; beyond, the same plans run over many.
SMALL = 200_000


def summarize_path(spark: SparkSession, path: str | list[str], fmt: LogFormat | str | None = None, **kwargs) -> dict:
    """The report on files; see ``summarize``. The format is found from the head of the first file."""
    head = head_of(spark, path)
    if head is None:
        raise ValueError("input is empty")
    return summarize(read_lines(spark, path), fmt, head=head, in_order=True, **kwargs)


def summarize(lines: DataFrame, fmt: LogFormat | str | None = None, latency_unit: str = "s", gap_seconds: float = 300.0, top: int = 5, in_order: bool = False, head: DataFrame | None = None) -> dict:
    """The report as a dictionary whose keys stand in output order.

    Lines are read and parsed once; ``in_order`` says that they come as a scan of files leaves them. ``head``: the
    first of the lines, if they are at hand. Raises ValueError for an empty input, an unknown format or a gap that
    isn't positive.
    """
    if not 0 < gap_seconds < float("inf"):
        raise ValueError("the gap must be a positive number of seconds")
    if head is None and lines.isEmpty():
        raise ValueError("input is empty")
    with parsers.settings(lines.sparkSession, COMPILED):
        fmt = LogFormat(fmt) if fmt else parsers.detect(lines if head is None else head)
        if fmt is None:
            raise ValueError("none of the first lines is in a known format; name the format")
        gap_ms = int(gap_seconds * 1000)
        facts = folding.folded(lines, fmt, parsers.LATENCY_UNITS[latency_unit], gap_ms, in_order)
        return report_of(facts, fmt, gap_ms, max(1, top))


def report_of(facts: DataFrame, fmt: LogFormat, gap_ms: int, top: int) -> dict:
    """The report from what ``folding.folded`` or ``folding.merged`` gives.

    Facts, a few rows for each block, minute, route and message, are written once: what follows reads them
    several times, and plans that begin with a table are made much faster than plans that begin with the parsers.
    """
    spark = facts.sparkSession
    path = scratch(spark, "facts")
    facts.write.parquet(path)
    try:
        kept = spark.read.schema(facts.schema).parquet(path)
        return assembled(kept.coalesce(1) if kept.count() <= SMALL else kept, fmt, gap_ms, top)
    finally:
        dropped(spark, path)


def assembled(facts: DataFrame, fmt: LogFormat, gap_ms: int, top: int) -> dict:
    """The report from a table of facts, which is read a few times."""
    access = fmt == LogFormat.ACCESS
    placed = folding.blocks(facts)
    minutes = folding.sums(facts, "minute").select(F.col("number").alias("minute"), "n", "errors")
    buckets = folding.sums(facts, "route").select(F.col("key").alias("route"), F.col("number").cast("int").alias("bucket"), "n", "errors", "top")
    timed = buckets.filter("bucket IS NOT NULL")
    named = F.concat(F.col("number").cast("string"), F.lit("xx")) if access else level_name(F.col("number").cast("int"))
    ms = lambda c, name: (F.col(c) * 1000).alias(name)
    stats = series.statistics(minutes, ["n", "errors"])
    one_row = {c: facts.sparkSession.createDataFrame([stats[c]], series.STATS) for c in stats}
    spike_rows = lambda value: series.spikes(minutes, value, one_row[value], top).select("minute_utc", "count", "times_median")
    work = {
        "totals": folding.totals(placed, fmt, gap_ms).withColumn("bytes", F.col("bytes").cast("string")),
        "span": minutes.agg(minute_label(F.min("minute")).alias("a"), minute_label(F.max("minute")).alias("b")),
        "traffic_spikes": spike_rows("n"),
        "error_spikes": spike_rows("errors"),
        "kinds": folding.sums(facts, "class" if access else "level").select(named.alias("kind"), "n"),
        "latency": sketch.quantiles(sketch.merged(timed), QUANTILES).select("samples", *[ms(q, f"{q}_ms") for q in QUANTILES], ms("top", "max_ms")),
        "seen": folding.examples(facts, placed, fmt, gap_ms, MAX_EXAMPLES).withColumn("at_utc", utc_text(F.col("ts_ms"))).withColumn("previous_utc", utc_text(F.col("prev_ts_ms"))),
    }
    if access:
        routes = buckets.groupBy("route").agg(F.sum("n").alias("requests"), F.sum("errors").alias("errors"))
        failing = routes.filter("errors > 0").orderBy(F.desc("errors"), "route").limit(top)
        work["slow"] = sketch.slow_routes(buckets, MIN_ROUTE_SAMPLES, top)
        work["failing"] = failing.join(sketch.quantiles(timed, {"p95": 0.95, "p99": 0.99}, ["route"]), "route", "left")
    else:
        work["messages"] = folding.sums(facts, "message").orderBy(F.desc("n"), "key").limit(top)
    # All parts of the report in one job; each is one row or a short list.
    tagged = [df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row")) for name, df in work.items()]
    got: dict[str, list] = {name: [] for name in work}
    for part, row in reduce(DataFrame.unionAll, tagged).collect():
        got[part].append(Row(**json.loads(row)))
    orders = {"traffic_spikes": lambda r: (-r["count"], r.minute_utc), "error_spikes": lambda r: (-r["count"], r.minute_utc), "kinds": lambda r: r.kind, "seen": lambda r: r.line, "slow": lambda r: (-r.p95, r.route), "failing": lambda r: (-r.errors, r.route), "messages": lambda r: (-r.n, r.key)}
    for name in got.keys() & orders.keys():
        got[name].sort(key=orders[name])

    median, _, peak, peak_minute, _ = stats["n"]
    all_, span = got["totals"][0], got["span"][0]
    spikes = lambda v: [r.asDict() for r in v]
    route = lambda r: {"route": r.route, "requests": r.requests, "errors": r.errors, "p95_ms": r.p95 and r.p95 * 1000, "p99_ms": r.p99 and r.p99 * 1000}
    seen = lambda tag: [{"line": r.line, "at_utc": r.at_utc, "previous_utc": r.previous_utc} for r in got["seen"] if r.tag == tag]
    latency = got["latency"][0].asDict() if got["latency"] else None
    kinds = {r.kind: r.n for r in got["kinds"]}
    return {
        "format": fmt.value,
        "lines": all_.lines,
        "parsed": all_.parsed,
        "unparseable": all_.unparseable,
        "continuation_lines": all_.continuation_lines,
        "first_utc": span.a,
        "last_utc": span.b,
        "median_per_minute": median,
        "peak_per_minute": peak,
        "peak_minute_utc": None if peak_minute is None else datetime.fromtimestamp(peak_minute * 60, UTC).strftime("%Y-%m-%d %H:%M"),
        "traffic_spikes": spikes(got["traffic_spikes"]),
        "error_spikes": spikes(got["error_spikes"]),
        "status_classes": kinds if access else {},
        "levels": {} if access else kinds,
        "bytes": int(all_.bytes),
        "latency": latency if latency and latency["samples"] else None,
        "slow_routes": [route(r) for r in got.get("slow", [])],
        "error_routes": [route(r) for r in got.get("failing", [])],
        "top_errors": [[r.key, r.n] for r in got.get("messages", [])],
        "out_of_order": all_.out_of_order,
        "out_of_order_examples": seen("back"),
        "gaps": all_.gaps,
        "longest_gap_seconds": all_.longest_gap_seconds,
        "gap_examples": seen("gap"),
        "unparseable_examples": [[r.line, r.text] for r in got["seen"] if r.tag == "failed"],
    }
