"""Parsed lines folded into a few rows of partial results, which add up over any parts of a log.

A row has a ``tag`` and the columns it needs:

    block    file, block; lines, parsed and failed lines, first and last time, steps back, silences, bytes
    back, gap, failed   the first of these in a block, by pos
    minute   number: epoch minute; n, errors
    route    key, number: bucket or null; n, errors, top
    class, level   number; n
    message  key; n

``tallies`` counts by a partial and a final aggregation over a row for each line and tag. What
depends on the order of lines is found by ``ordered`` where they are read, a block at a time,
from times and positions alone. Lines are not shuffled if they come in line order, as from
files or ``lines_from``; otherwise blocks are brought together first.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import parsers, sketch
from .parsers import LogFormat

#: First findings of each kind that a block keeps, and bytes of a file (or rows of a table) to a range of blocks.
EXAMPLES, RANGE = 5, 1 << 36
FACTS = {
    "tag": "string", "file": "string", "block": "long", "pos": "long", "key": "string", "number": "long", "n": "long", "errors": "long", "top": "double",
    "lines": "long", "parsed": "long", "indented": "long", "before": "long", "after": "long", "first_pos": "long", "head_pos": "long", "head_ms": "long", "tail_ms": "long",
    "backs": "long", "gaps": "long", "longest_ms": "long", "bytes": "decimal(38,0)", "ts_ms": "long", "prev_ts_ms": "long", "text": "string",
}
#: What ``ordered`` finds; the rest of FACTS is null in it.
OF_BLOCKS = ("tag", "file", "block", "pos", "lines", "parsed", "indented", "before", "after", "first_pos", "head_pos", "head_ms", "tail_ms", "backs", "gaps", "longest_ms", "bytes", "ts_ms", "prev_ts_ms", "text")
ARROW = pa.schema([(c, {"string": pa.string(), "long": pa.int64()}.get(FACTS[c], pa.decimal128(38, 0))) for c in OF_BLOCKS])


class Block:
    """What a task has seen of one block."""

    def __init__(self, file: str, block: int, first_pos: int):
        self.row = {"tag": "block", "file": file, "block": block, "first_pos": first_pos, "head_pos": None, "head_ms": None, "tail_ms": None}
        self.row |= dict.fromkeys(("lines", "parsed", "indented", "before", "after", "backs", "gaps", "longest_ms"), 0)
        self.bytes, self.found = 0, {"back": [], "gap": [], "failed": []}

    def add(self, part: dict[str, np.ndarray], texts: pa.Array, fmt: LogFormat, gap_ms: int) -> None:
        r, kind, pos = self.row, part["kind"], part["pos"]
        ok = np.flatnonzero(kind == 0)
        r["lines"] += len(kind)
        r["indented"] += int(np.count_nonzero(kind == 2))
        started = r["parsed"] > 0
        early = np.zeros(len(kind), bool) if started else np.arange(len(kind)) < (ok[0] if len(ok) else len(kind))
        failed = kind == 3
        r["before"] += int(np.count_nonzero(failed & early))
        r["after"] += int(np.count_nonzero(failed & ~early))
        room = EXAMPLES - len(self.found["failed"])
        listed = kind >= 2 if fmt == LogFormat.ACCESS else failed & early
        for k in np.flatnonzero(listed)[:room].tolist() if room else ():
            self.found["failed"].append({"pos": int(pos[k]), "text": texts[k].as_py()})
        if not len(ok):
            return
        r["parsed"] += len(ok)
        ts = part["ts_ms"][ok]
        before = np.concatenate(([r["tail_ms"] if started else ts[0]], ts[:-1]))
        step = ts - before
        if not started:
            r["head_pos"], r["head_ms"] = int(pos[ok[0]]), int(ts[0])
        r["tail_ms"] = int(ts[-1])
        for name, total, at in (("back", "backs", np.flatnonzero(step < 0)), ("gap", "gaps", np.flatnonzero(step > gap_ms))):
            r[total] += len(at)
            for k in at[: EXAMPLES - len(self.found[name])].tolist():
                self.found[name].append({"pos": int(pos[ok[k]]), "ts_ms": int(ts[k]), "prev_ts_ms": int(before[k])})
        if len(at):
            r["longest_ms"] = max(r["longest_ms"], int(step[at].max()))

    def rows(self) -> Iterator[dict]:
        yield self.row | {"bytes": Decimal(self.bytes)}
        for name, found in self.found.items():
            yield from ({"tag": name, "file": self.row["file"], "block": self.row["block"]} | x for x in found)


def folded(lines: DataFrame, fmt: LogFormat, scale: float = 1.0, gap_ms: int = 300_000, in_order: bool = False) -> DataFrame:
    """FACTS of ``lines``: one row for each block, key and number, and the first findings."""
    order = ordered(lines, fmt, gap_ms, in_order).hint("rebalance")  # a row or so from each of many tasks
    return tallies(lines, fmt, scale).unionByName(order, allowMissingColumns=True).select(*[F.col(c).cast(kind).alias(c) for c, kind in FACTS.items()])


def tallies(lines: DataFrame, fmt: LogFormat, scale: float = 1.0) -> DataFrame:
    """(tag, key, number, n, errors, top) by minute, class or level, route and bucket, and message."""
    access = fmt == LogFormat.ACCESS
    rows = parsers.parsed(lines, fmt, scale, ["minute", "is_error", "latency_s", *(["status", "route"] if access else ["level_rank", "message"])])
    seconds = F.when(sketch.admitted(F.col("latency_s")), F.col("latency_s"))
    rows = rows.withColumn("latency_s", seconds).withColumn("is_error", F.col("is_error").cast("int"))
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("double")

    def entry(tag: str, key, number, errors, top=nothing, of=F.col("kind") == "ok"):
        return F.when(of, F.struct(F.lit(tag).alias("tag"), key.alias("key"), number.cast("long").alias("number"), errors.alias("errors"), top.alias("top")))

    bucket, bad, zero = sketch.bucket(F.col("latency_s")), F.col("is_error"), F.lit(0)
    found = [entry("minute", none, F.col("minute"), bad), entry("route", F.col("route") if access else none, bucket, bad, F.col("latency_s"))]
    if access:
        found.append(entry("class", none, F.floor(F.col("status") / 100), zero))
    else:
        found.append(entry("level", none, F.col("level_rank"), zero))
        found.append(entry("message", F.col("message"), zero, zero, of=bad == 1))
    each = rows.select(F.explode(F.array(*found)).alias("x")).filter("x IS NOT NULL").select("x.*")
    return each.groupBy("tag", "key", "number").agg(F.count(F.lit(1)).alias("n"), F.sum("errors").alias("errors"), F.max("top").alias("top"))


def ordered(lines: DataFrame, fmt: LogFormat, gap_ms: int = 300_000, in_order: bool = False) -> DataFrame:
    """The rows of FACTS with tags block, back, gap and failed."""
    access = fmt == LogFormat.ACCESS
    rows = parsers.parsed(lines, fmt, columns=["ts_ms", "text", *(["bytes"] if access else [])])
    kind = F.when(F.col("kind") == "ok", 0).when(F.col("kind") == "blank", 1).when(F.col("kind") == "indented", 2).otherwise(3)
    narrow = rows.select("file", "block", "pos", kind.alias("kind"), "ts_ms", "text", *(["bytes"] if access else []))
    if not in_order:
        narrow = narrow.repartition("file", "block").sortWithinPartitions("file", "block", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            values = {c: col[c].fill_null(0).to_numpy(zero_copy_only=False) for c in ("kind", "pos", "ts_ms")}
            files, blocks = col["file"].dictionary_encode(), col["block"].to_numpy(zero_copy_only=False)
            code, names = files.indices.to_numpy(zero_copy_only=False), files.dictionary.to_pylist()
            cuts = np.flatnonzero((code[1:] != code[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(code)], strict=True):
                name = (names[code[a]], int(blocks[a]))
                if block is None or name != (block.row["file"], block.row["block"]):
                    if block is not None:
                        yield as_batch(block.rows())
                    block = Block(*name, int(values["pos"][a]))
                block.add({c: x[a:b] for c, x in values.items()}, col["text"].slice(a, b - a), fmt, gap_ms)
                if access:
                    block.bytes += int(pc.sum(col["bytes"].slice(a, b - a)).as_py() or 0)
        if block is not None:
            yield as_batch(block.rows())

    return narrow.mapInArrow(run, ", ".join(f"{c} {FACTS[c]}" for c in OF_BLOCKS))


def as_batch(rows: Iterator[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(list(rows), ARROW)


# --- what the facts say -----------------------------------------------------------------------------


def merged(parts: DataFrame) -> DataFrame:
    """FACTS of a whole from those of its parts, whatever their number: sums by key; blocks and findings as they are."""
    by_key = parts.filter("tag IN ('minute', 'route', 'class', 'level', 'message')")
    added = by_key.groupBy("tag", "key", "number").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.max("top").alias("top"))
    return added.unionByName(parts.filter("tag IN ('block', 'back', 'gap', 'failed')"), allowMissingColumns=True).select(*FACTS)


def sums(facts: DataFrame, tag: str) -> DataFrame:
    """(key, number, n, errors, top) of whole or merged facts."""
    return facts.filter(F.col("tag") == tag).select("key", "number", "n", "errors", "top")


def blocks(facts: DataFrame, per_range: int = RANGE) -> DataFrame:
    """One row per block, with the number of lines before it, whether any of them parsed, and the last time before it."""
    own = facts.filter("tag = 'block'").withColumn("some", F.col("parsed") > 0)
    found = before(own, {"offset": ("sum", "lines"), "seen": ("any", "some"), "prev_ms": ("last", "tail_ms")}, per_range)
    return found.withColumns({"offset": F.coalesce("offset", F.lit(0)), "seen": F.coalesce("seen", F.lit(False))})


def before(blocks: DataFrame, found: dict[str, tuple[str, str]], per_range: int = RANGE) -> DataFrame:
    """Adds what stands before each of ``blocks`` (file, block): for each name the ``sum``, ``any`` or ``last`` value that isn't null of a column.

    In two levels: blocks add up to ranges of a file, ranges to what is before each of them, and windows over
    the blocks of one range do the rest. So only a row for each range, not for each block, meets in one task.
    """
    ranged = blocks.withColumn("_range", F.floor(F.col("block") / per_range))
    whole = {
        "sum": lambda c: F.sum(c),
        "any": lambda c: F.max(c),
        "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("block"))),
    }
    over = {"sum": lambda c, w: F.sum(c).over(w), "any": lambda c, w: F.max(c).over(w), "last": lambda c, w: F.last(c, ignorenulls=True).over(w)}
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "any": lambda a, b: F.coalesce(b, F.lit(False)) | F.coalesce(a, F.lit(False)), "last": lambda a, b: F.coalesce(b, a)}
    place = Window.orderBy("file", "_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = ranged.groupBy("file", "_range").agg(*[whole[how](c).alias(f"_{name}") for name, (how, c) in found.items()])
    tops = tops.select("file", "_range", *[over[how](f"_{name}", place).alias(f"_{name}") for name, (how, _) in found.items()])
    inside = Window.partitionBy("file", "_range").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumns({name: over[how](c, inside) for name, (how, c) in found.items()})
    joined = own.join(tops, ["file", "_range"])
    return joined.withColumns({name: both[how](F.col(f"_{name}"), F.col(name)) for name, (how, _) in found.items()}).drop("_range", *[f"_{name}" for name in found])


def border(gap_ms: int) -> tuple:
    """Of a row of ``blocks``: whether time steps back at its first parsed line, and whether a silence ends there."""
    step = F.col("head_ms") - F.col("prev_ms")
    return F.coalesce(step < 0, F.lit(False)), F.coalesce(step > gap_ms, F.lit(False)), step


def totals(placed: DataFrame, fmt: LogFormat, gap_ms: int) -> DataFrame:
    """One row: lines, parsed, unparseable, continuation_lines, bytes, out_of_order, gaps, longest_gap_seconds."""
    back, gap, step = border(gap_ms)
    if fmt == LogFormat.ACCESS:
        more, bad = F.lit(0), F.col("indented") + F.col("before") + F.col("after")
    else:  # lines that don't parse continue what parsed before them
        more = F.col("indented") + F.col("after") + F.when(F.col("seen"), F.col("before")).otherwise(0)
        bad = F.when(F.col("seen"), 0).otherwise(F.col("before"))
    whole = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return placed.agg(
        whole("lines", "lines"),
        whole("parsed", "parsed"),
        whole(bad, "unparseable"),
        whole(more, "continuation_lines"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        whole(F.col("backs") + back.cast("long"), "out_of_order"),
        whole(F.col("gaps") + gap.cast("long"), "gaps"),
        (F.coalesce(F.max(F.greatest("longest_ms", F.when(gap, step).otherwise(0))), F.lit(0)) / 1000).alias("longest_gap_seconds"),
    )


def examples(facts: DataFrame, placed: DataFrame, fmt: LogFormat, gap_ms: int, n: int = EXAMPLES) -> DataFrame:
    """(tag, line, ts_ms, prev_ts_ms, text): the first ``n`` steps back, silences and failed lines."""
    back, gap, _ = border(gap_ms)
    edge = placed.select(F.when(back, "back").when(gap, "gap").alias("tag"), "file", "block", F.col("head_pos").alias("pos"), F.col("head_ms").alias("ts_ms"), F.col("prev_ms").alias("prev_ts_ms"), F.lit(None).cast("string").alias("text"))
    inside = facts.filter("tag IN ('back', 'gap', 'failed')").select("tag", "file", "block", "pos", "ts_ms", "prev_ts_ms", "text")
    found = inside.unionByName(edge.filter("tag IS NOT NULL")).join(placed.select("file", "block", "offset", "first_pos", "seen"), ["file", "block"])
    if fmt == LogFormat.APP:
        found = found.filter("tag <> 'failed' OR NOT seen")
    lines = found.select("tag", (F.col("offset") + F.col("pos") - F.col("first_pos") + 1).alias("line"), "ts_ms", "prev_ts_ms", "text")
    first = F.row_number().over(Window.partitionBy("tag").orderBy("line"))
    return lines.withColumn("k", first).filter(F.col("k") <= n).drop("k")
