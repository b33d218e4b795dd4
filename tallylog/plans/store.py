"""Reports that go on: facts of a log kept as tables, to which later runs add what is new.

A store is a folder with ``facts/part-K``, what ``folding.folded`` found in part K, and
``ledger/part-K``, which byte range of which file that was. The ledger of a part is one file
and is written last, so a part counts only when all of it is there; what a run that broke off
has left is written over by the next one. Files may be added and may grow; bytes that the
ledger has are not read again, so adding the same files twice changes nothing. Facts of parts
add up to the facts of the whole log in the order of file names and bytes.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folding, parsers
from ..operators.parsers import LogFormat
from ..sources import reader
from ..sources.scratch import dropped
from .report import COMPILED, report_of

#: ``whole``: the part holds all that parts before it do.
LEDGER = "part long, whole boolean, file string, start long, stop long, format string, unit string, gap_ms long"


def ledger(spark: SparkSession, store: str) -> DataFrame:
    """LEDGER of the parts that count; empty for a new store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/ledger")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    if not there:
        return spark.createDataFrame([], LEDGER)
    every = spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(f"{store}/ledger")
    since = every.filter("whole").agg(F.max("part")).first()[0]
    return every if since is None else every.filter(F.col("part") >= since)


def add(spark: SparkSession, store: str, path: str, fmt: LogFormat | str | None = None, latency_unit: str = "s", gap_seconds: float = 300.0, block_bytes: int = reader.BLOCK, unfinished: bool = True) -> int:
    """Folds what the files at ``path`` hold beyond the ledger and adds it to ``store``; returns the number of bytes that were new.

    All parts have one format, unit and gap; another one is a ValueError, as is a file that has become
    shorter. With ``unfinished`` a last line without a line feed is read; what is written behind it
    later counts as a line of its own. The driver holds a row for each file, as it does to list them.
    """
    gap_ms = int(gap_seconds * 1000)
    if not 0 < gap_seconds < float("inf"):
        raise ValueError("the gap must be a positive number of seconds")
    known = ledger(spark, store)
    read = {r.file: r.stop for r in known.groupBy("file").agg(F.max("stop").alias("stop")).collect()}
    before = known.agg(F.max("part").alias("part"), F.first("format").alias("format"), F.first("unit").alias("unit"), F.first("gap_ms").alias("gap_ms")).first()
    sizes = reader.files_at(path)
    if short := [f for f, size in sizes.items() if size < read.get(f, 0)]:
        raise ValueError(f"{short[0]} has become shorter")
    ends = {f: size if unfinished else reader.whole_lines(f, read.get(f, 0), size) for f, size in sizes.items()}
    new = {f: (read.get(f, 0), end) for f, end in ends.items() if end > read.get(f, 0)}
    if not new:
        return 0
    source = reader.register(spark).read.format("tallylog").option("path", path).option("blockBytes", block_bytes)
    lines = source.option("from", json.dumps(read)).option("unfinished", "keep" if unfinished else "wait").load()
    fmt = LogFormat(fmt) if fmt else LogFormat(before.format) if before.format else parsers.detect(first_lines(spark, new, path))
    if fmt is None:
        raise ValueError("none of the first lines is in a known format; name the format")
    if before.part is not None and (before.format, before.unit, before.gap_ms) != (fmt.value, latency_unit, gap_ms):
        raise ValueError(f"the store holds {before.format} lines in {before.unit} with a gap of {before.gap_ms} ms")
    part = 0 if before.part is None else before.part + 1
    with parsers.settings(spark, COMPILED):
        folding.folded(lines, fmt, parsers.LATENCY_UNITS[latency_unit], gap_ms, in_order=True).write.mode("overwrite").parquet(f"{store}/facts/part-{part}")
    rows = [(part, False, f, start, stop, fmt.value, latency_unit, gap_ms) for f, (start, stop) in new.items()]
    spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{store}/ledger/part-{part}")
    return sum(stop - start for start, stop in new.values())


def first_lines(spark: SparkSession, new: dict[str, tuple[int, int]], path: str, n_bytes: int = 64 << 10) -> DataFrame:
    """The lines that begin in the first bytes of the first file."""
    file, (start, stop) = next(iter(new.items()))
    part = reader.Range(file, start, min(start + n_bytes, stop), stop)
    batch = next(reader.lines_of(part), None)
    return spark.createDataFrame([tuple(r.values()) for r in batch.to_pylist()] if batch else [], reader.SCHEMA)


def facts(spark: SparkSession, store: str) -> DataFrame:
    """The facts of all parts in the ledger, added up."""
    parts = [r.part for r in ledger(spark, store).select("part").distinct().collect()]
    if not parts:
        raise ValueError("the store is empty")
    kinds = ", ".join(f"{c} {kind}" for c, kind in folding.FACTS.items())
    return folding.merged(spark.read.schema(kinds).parquet(*[f"{store}/facts/part-{k}" for k in sorted(parts)]))


def report(spark: SparkSession, store: str, top: int = 5) -> dict:
    """The report on all that was added, as ``summarize`` gives it on the whole log."""
    kind = ledger(spark, store).first()
    if kind is None:
        raise ValueError("the store is empty")
    with parsers.settings(spark, COMPILED):
        return report_of(facts(spark, store), LogFormat(kind.format), kind.gap_ms, max(1, top))


def compact(spark: SparkSession, store: str) -> None:
    """Makes all parts one, which later reports read faster. The new ledger entry replaces those before it; only then do they go."""
    known = ledger(spark, store)
    parts = sorted(r.part for r in known.select("part").distinct().collect())
    if len(parts) < 2:
        return
    part = parts[-1] + 1
    facts(spark, store).write.mode("overwrite").parquet(f"{store}/facts/part-{part}")
    one = known.groupBy("file", "format", "unit", "gap_ms").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    one.select(F.lit(part).cast("long").alias("part"), F.lit(True).alias("whole"), "file", "start", "stop", "format", "unit", "gap_ms").coalesce(1).write.mode("overwrite").parquet(f"{store}/ledger/part-{part}")
    for k in parts:
        dropped(spark, f"{store}/ledger/part-{k}")
        dropped(spark, f"{store}/facts/part-{k}")
