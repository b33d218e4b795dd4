"""Line parsers as columns: one nullable struct per line; null means that the line doesn't parse."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import times, words


class LogFormat(str, Enum):
    ACCESS = "access"
    APP = "app"


#: Seconds in a unit of bare trailing numbers.
LATENCY_UNITS = {"s": 1.0, "ms": 1e-3, "us": 1e-6}
MAX_CHARS = 1 << 30
#: The largest byte count, an unsigned number of 64 bits.
MOST_BYTES = "18446744073709551615"

_WS, _GAP = words.WS, r"[ \t\n\f\r]"
#: An access line, checked but for days of the month, zones and the size of numbers. Groups in order: date, clock, what follows the clock,
#: method, path, status, bytes without leading zeros (nothing for -), and the rest.
_ACCESS = (
    r"(?s)^[^\[]*+\[(\d{2}/[A-Za-z]{3}/\d{4}):((?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60))([^\]]*+)\]"
    rf'{_WS}*+"([^" ]*+)(?: ([^" ]*+)[^"]*+)?"{_WS}*+'
    rf"\+?([0-9]++){_GAP}++(?:-|\+?(?=[0-9])0*+([0-9]*+))(?![^ \t\n\f\r])(.*)$"
)


def _barrier(df: DataFrame, record: Column) -> DataFrame:
    """Adds ``record`` as ``rec``. The optimizer copies no expression through a generator, so parsing is not repeated in the filters above."""
    return df.select("*", F.explode(F.array(record)).alias("rec"))


def _after(text: Column, length: Column) -> Column:
    """What follows the first ``length`` characters."""
    return text.substr(length + 1, F.lit(MAX_CHARS))


ACCESS_FIELDS, APP_FIELDS = ("ts_ms", "method", "path", "status", "bytes", "latency_s"), ("ts_ms", "level_rank", "message", "latency_s")


def access_steps(line: Column, scale: float, fields: Sequence[str]) -> tuple[dict[str, Column], dict[str, Column], Column]:
    """Two steps of columns, the second from the first, and the record made from both; null if the line doesn't parse.

    One pattern takes a line apart. Its groups are joined by line feeds, which no line has, and split again: so it runs once for all of them.
    """
    groups = [1, 2, 3, 6, 7, *([4, 5] if {"method", "path"} & {*fields} else []), *([8] if "latency_s" in fields else [])]
    first = {"_p": F.split(F.regexp_replace(line, _ACCESS, "\n".join(f"${g}" for g in groups)), "\n", len(groups))}
    whole = F.size("_p") == len(groups)
    part = lambda g: F.get("_p", F.lit(groups.index(g)))
    second = {"_ms": F.when(whole, times.clf_parts_ms(part(1), part(2), part(3))), "_s": F.when(whole, part(6).try_cast("int")), "_b": F.when(whole, part(7))}
    each = {
        "ts_ms": lambda: F.col("_ms"),
        "method": lambda: part(4),
        "path": lambda: part(5),
        "status": lambda: F.col("_s"),
        "bytes": lambda: F.coalesce(F.col("_b").try_cast("decimal(20,0)"), F.lit(0)),
        "latency_s": lambda: access_seconds(part(8), scale),
    }
    record = F.struct(*[each[f]().alias(f) for f in fields])
    fits = (F.length("_b") < len(MOST_BYTES)) | ((F.length("_b") == len(MOST_BYTES)) & (F.col("_b") <= MOST_BYTES))
    return first, second, F.when(F.col("_ms").isNotNull() & F.col("_s").between(100, 599) & fits, record)


def access_fields(df: DataFrame, line: str = "value", scale: float = 1.0, fields: Sequence[str] = ACCESS_FIELDS) -> DataFrame:
    """Adds ``rec`` with ``fields``; what isn't asked for isn't computed."""
    first, second, record = access_steps(F.col(line), scale, fields)
    return _barrier(df.withColumns(first).withColumns(second), record).drop(*first, *second)


def access_seconds(after: Column, scale: float) -> Column:
    """Response time behind ``request_time=``, else ``rt=``, else a bare number as the last field if a quote came before."""

    def keyed(key: str) -> Column:
        rest = _after(after, F.instr(after, key) + len(key) - 1)
        value = words.seconds(F.regexp_extract(rest, r"^[0-9.]*", 0)) * F.lit(scale)
        return F.when(value < F.lit(float("inf")), value)

    bare = F.when(F.contains(after, F.lit('"')), words.seconds(F.substring_index(after, " ", -1)) * F.lit(scale))
    by_key = F.when(F.contains(after, F.lit("request_time=")), keyed("request_time=")).otherwise(keyed("rt="))
    return F.when(F.contains(after, F.lit("rt=")) | F.contains(after, F.lit("request_time=")), by_key).otherwise(bare)


def app_fields(df: DataFrame, line: str = "value", fields: Sequence[str] = APP_FIELDS) -> DataFrame:
    """Adds ``rec`` with ``fields``."""
    step = times.with_iso(df, line, "_ms", "_used")
    step = step.withColumn("_r", F.when(F.col("_ms").isNotNull(), _after(F.col(line), F.col("_used"))))
    step = step.withColumn("_w", F.regexp_extract("_r", words.LEVEL_LINE, 1)).withColumn("_l", words.level_rank(F.col("_w")))
    if {"message", "latency_s"} & {*fields}:
        step = step.withColumn("_m", F.when(F.col("_l").isNotNull(), F.regexp_extract("_r", words.LEVEL_LINE, 2)))
    if "latency_s" in fields:
        step = words.with_message_seconds(step, "_m", "_lat")
    at = {"ts_ms": "_ms", "level_rank": "_l", "message": "_m", "latency_s": "_lat"}
    record = F.struct(*[F.col(at[f]).alias(f) for f in fields])
    return _barrier(step, F.when(F.col("_l").isNotNull(), record)).drop("_ms", "_used", "_r", "_w", "_l", "_m", "_lat")


def with_record(df: DataFrame, fmt: LogFormat, line: str = "value", scale: float = 1.0, fields: Sequence[str] | None = None) -> DataFrame:
    if fmt == LogFormat.ACCESS:
        return access_fields(df, line, scale, fields or ACCESS_FIELDS)
    return app_fields(df, line, fields or APP_FIELDS)


#: Columns of parsed rows besides file, block, pos and kind, and the fields of a line that each is made from.
MADE_FROM = {
    LogFormat.ACCESS: {"ts_ms": ["ts_ms"], "minute": ["ts_ms"], "latency_s": ["latency_s"], "text": [], "is_error": ["status"], "status": ["status"], "bytes": ["bytes"], "route": ["method", "path"]},
    LogFormat.APP: {"ts_ms": ["ts_ms"], "minute": ["ts_ms"], "latency_s": ["latency_s"], "text": [], "is_error": ["level_rank"], "level_rank": ["level_rank"], "message": ["level_rank", "message"]},
}


def parsed(lines: DataFrame, fmt: LogFormat, scale: float = 1.0, columns: Sequence[str] | None = None) -> DataFrame:
    """Narrow rows for all aggregates: file, block, pos, kind and, of MADE_FROM, all columns or those asked for.

    ``kind``: ok, failed, indented (failed and indented) or blank. ``text`` is kept for failed lines only.
    """
    asked = columns if columns is not None else list(MADE_FROM[fmt])
    needed = {f for c in asked for f in MADE_FROM[fmt][c]} or {"ts_ms"}
    rows = with_record(lines, fmt, scale=scale, fields=[f for f in (ACCESS_FIELDS if fmt == LogFormat.ACCESS else APP_FIELDS) if f in needed])
    ok = F.col("rec").isNotNull()
    kind = F.when(ok, "ok").when(words.is_blank(F.col("value")), "blank").when(words.is_indented(F.col("value")), "indented").otherwise("failed")
    field = lambda name: F.col(f"rec.{name}")
    made = {
        "ts_ms": lambda: field("ts_ms"),
        "minute": lambda: times.minute_of(field("ts_ms")),
        "latency_s": lambda: field("latency_s"),
        "text": lambda: F.when(~ok, F.substring("value", 1, words.EXAMPLE_CHARS)),
        "is_error": lambda: field("status") >= 500 if fmt == LogFormat.ACCESS else field("level_rank") >= words.ERROR_RANK,
        "status": lambda: field("status"),
        "bytes": lambda: field("bytes"),
        "route": lambda: F.when(ok, F.concat_ws(" ", field("method"), words.route(field("path")))),
        "level_rank": lambda: field("level_rank"),
        "message": lambda: F.when(field("level_rank") >= words.ERROR_RANK, words.message_key(field("message"))),
    }
    return rows.select("file", "block", "pos", kind.alias("kind"), *[made[c]().alias(c) for c in asked])


#: For a few rows, which take less time than compiling code for them.
INTERPRETED = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while."""
    old = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def detect(lines: DataFrame, most: int = 50, head_bytes: int = 64 << 10) -> LogFormat | None:
    """The format of the first line that has one, among the first 50 lines that aren't blank within the first 64 KiB.

    ``lines`` come in order within their first file and block; only those are read. Blank lines count as a byte each.
    """
    head = lines.filter(~words.is_blank(F.col("value"))).orderBy("file", "block", "pos").limit(most)
    marked = app_fields(access_fields(head, fields=["ts_ms"]).withColumnRenamed("rec", "acc"), fields=["ts_ms"])
    marked = marked.select("file", "block", "pos", F.col("acc").isNotNull().alias("acc"), F.col("rec").isNotNull().alias("app"), F.octet_length("value").alias("n"))
    seen, before = 0, None
    with settings(lines.sparkSession, INTERPRETED):
        rows = marked.orderBy("file", "block", "pos").collect()  # at most 50
    for row in rows:
        if before is not None and before[:2] == (row.file, row.block):
            seen += row.pos - before[2] - 1
        if seen > head_bytes:
            break
        seen += row.n + 1
        before = row.file, row.block, row.pos
        if row.acc or row.app:
            return LogFormat.ACCESS if row.acc else LogFormat.APP
    return None


def formats(lines: DataFrame, most: int = 50) -> DataFrame:
    """(file, format): of each file the format of the first line that has one, among the first ``most`` lines of its first block that aren't blank; null if none has.

    One pass over the heads of all files: what is beyond them goes before lines are parsed or shuffled.
    """
    place = Window.partitionBy("file").orderBy("block", "pos")
    first = F.min("block").over(Window.partitionBy("file"))
    heads = lines.filter(~words.is_blank(F.col("value"))).withColumn("_k", F.row_number().over(place)).filter(F.col("_k") <= most).withColumn("_b", first).filter("block = _b")
    marked = app_fields(access_fields(heads, fields=["ts_ms"]).withColumnRenamed("rec", "acc"), fields=["ts_ms"])
    found = F.when(F.col("acc").isNotNull(), LogFormat.ACCESS.value).when(F.col("rec").isNotNull(), LogFormat.APP.value)
    return marked.select("file", "_k", found.alias("format")).groupBy("file").agg(F.min_by("format", F.when(F.col("format").isNotNull(), F.col("_k"))).alias("format"))


def by_format(lines: DataFrame) -> dict[LogFormat, DataFrame]:
    """The lines of each format's files; files in no known format are in neither. Lines keep the order in which they are read."""
    spark, known = lines.sparkSession, formats(lines).collect()  # a row for each file, which the driver lists anyway
    files = {fmt: spark.createDataFrame([(r.file,) for r in known if r.format == fmt.value], "file string") for fmt in LogFormat}
    return {fmt: lines.join(F.broadcast(own), "file", "left_semi").select("value", "file", "block", "pos") for fmt, own in files.items()}
