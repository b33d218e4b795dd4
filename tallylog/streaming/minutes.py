"""Minute counts and the quantile sketch over endless logs; ``sink`` keeps what they find, ``order`` checks the order of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import parsers, sketch
from ..operators.parsers import LogFormat


MINUTES, BUCKETS = "minute long, n long, errors long", "bucket int, n long, top double"


def stream_minute_counts(lines: DataFrame, fmt: LogFormat, late: str | None = None) -> DataFrame:
    """(minute, n, errors) of a stream of lines (value). ``late``: the delay of a watermark, for append mode; lines that come later than that are left out."""
    rows = parsers.with_record(lines, fmt, fields=["ts_ms", "status" if fmt == LogFormat.ACCESS else "level_rank"]).filter("rec IS NOT NULL")
    bad = F.col("rec.status") >= 500 if fmt == LogFormat.ACCESS else F.col("rec.level_rank") >= 4
    timed = rows.select(F.timestamp_millis("rec.ts_ms").alias("at"), bad.alias("is_error"))
    timed = timed.withWatermark("at", late) if late else timed
    counted = timed.groupBy(F.window("at", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("errors"))
    return counted.select(F.floor(F.unix_millis("w.start") / 60_000).cast("long").alias("minute"), "n", "errors")


def stream_sketch(lines: DataFrame, scale: float = 1.0) -> DataFrame:
    """(bucket, n, top) of a stream of access lines, for update or complete mode: counts that a new line adds to."""
    rows = parsers.with_record(lines, LogFormat.ACCESS, scale=scale, fields=["latency_s"]).filter("rec IS NOT NULL")
    return sketch.sketch(rows.select(F.col("rec.latency_s").alias("latency_s")), "latency_s")
