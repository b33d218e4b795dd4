"""Steps back and silences of endless logs, by source, in the order of lines.

Each batch is folded block by block where it is read, as a report does it; only a row for each block
goes to the state of its source, which knows the time of the last line and what was found so far.
With timers a silence is reported as soon as event time has gone on for longer than the gap, which
other sources' lines tell, and not only by the line that ends it.

A watermark would drop lines that come late, the very ones that step back. It is needed for timers
alone, so the column it is on goes before the state: all lines are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import folding
from ..operators.parsers import LogFormat

STATE = "tail_ms long, lines long, parsed long, out_of_order long, gaps long, longest_ms long, silent_since long"
ORDER = f"source string, {STATE}"
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class OrderOfLines(StatefulProcessor):
    """State of a source: the last time, sums, and since when it has been silent, if it has."""

    def __init__(self, gap_ms: int, timers: bool):
        self.gap_ms, self.timers = gap_ms, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("order", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tail, lines, parsed, backs, gaps, longest, silent = self.kept.get() if self.kept.exists() else (None, 0, 0, 0, 0, 0, None)
        for r in pd.concat(list(rows)).sort_values(["file", "block"]).itertuples():
            lines, parsed = lines + int(r.lines), parsed + int(r.parsed)
            if not r.parsed:
                continue
            step = 0 if tail is None else int(r.head_ms) - tail
            backs, gaps = backs + int(r.backs) + (step < 0), gaps + int(r.gaps) + (step > self.gap_ms)
            longest = max(longest, int(r.longest_ms), step if step > self.gap_ms else 0)
            tail, silent = int(r.tail_ms), None
        state = (tail, lines, parsed, backs, gaps, longest, silent)
        self.kept.update(state)
        if self.timers:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if tail is not None:
                self.handle.registerTimer(max(tail + self.gap_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield self.row(key, state)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = list(self.kept.get())
        state[-1] = state[0]
        self.kept.update(tuple(state))
        yield self.row(key, tuple(state))

    def row(self, key: tuple, state: tuple) -> pd.DataFrame:
        names = [c.split()[0] for c in STATE.split(", ")]
        return pd.DataFrame({"source": [key[0]]} | {c: pd.array([x], "Int64") for c, x in zip(names, state, strict=True)})

    def close(self) -> None:
        pass


def stream_order(lines: DataFrame, fmt: LogFormat, gap_ms: int = 300_000, source: Column | None = None, timers: bool = False) -> DataFrame:
    """ORDER of a stream of lines (value, file, block, pos), for update mode: a row for each source that has news.

    ``source``: of a line, by its ``file``; all files are one source without it. ``longest_ms`` is that of silences that have ended.
    """
    blocks = folding.ordered(lines, fmt, gap_ms, in_order=True).filter("tag = 'block'")
    if timers:
        blocks = blocks.withColumn("at", F.timestamp_millis("tail_ms")).withWatermark("at", "0 seconds")
    named = blocks.select((F.lit("") if source is None else source).alias("source"), "file", "block", "lines", "parsed", "head_ms", "tail_ms", "backs", "gaps", "longest_ms")
    return named.groupBy("source").transformWithStateInPandas(OrderOfLines(gap_ms, timers), ORDER, "update", "EventTime" if timers else "none")


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """States that outgrow memory go to RocksDB, which ``transformWithState`` asks for."""
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    return spark
