"""The most frequent keys in bounded memory, exactly.

Each task keeps a Misra-Gries summary of at most ``slots`` keys: when there are more, all counts are lowered
by the same amount and keys without a count go. Summaries add up, and no key occurs more often than its
count there plus the sum of all that was taken off. Keys that may be among the first are counted
exactly in a second pass. If the bound cannot rule out a key that is in no summary, both passes run
again with more slots; so nothing is lost, whatever the keys are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Summary:
    """Counts of at most ``slots`` keys, each at most ``off`` too low."""

    def __init__(self, slots: int):
        self.slots, self.counts, self.off = slots, {}, 0

    def add(self, keys: list, counts: list[int]) -> None:
        for key, n in zip(keys, counts, strict=True):
            self.counts[key] = self.counts.get(key, 0) + n
        if len(self.counts) > self.slots:
            most = sorted(self.counts.values(), reverse=True)[self.slots]
            self.off += most
            self.counts = {k: n - most for k, n in self.counts.items() if n > most}


def summaries(keys: DataFrame, slots: int) -> DataFrame:
    """(key, n): a row for each key of each task's summary; under a null key what was taken off. Null keys don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Summary(slots)
        for batch in batches:
            found = pc.value_counts(batch.column(0).drop_null())
            own.add(found.field("values").to_pylist(), found.field("counts").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([None, *own.counts], pa.string()), pa.array([own.off, *own.counts.values()], pa.int64())], names=["key", "n"])

    return keys.mapInArrow(run, "key string, n long")


def most_frequent(rows: DataFrame, key: str, most: int, slots: int = 10_000) -> DataFrame:
    """(key, n): the ``most`` most frequent values of a text column, equal counts by key."""
    keys = rows.select(F.col(key).alias(key))
    while True:
        found = summaries(keys, slots).groupBy("key").agg(F.sum("n").alias("n")).persist()  # at most ``slots`` rows for each task
        try:
            off = found.filter("key IS NULL").agg(F.sum("n")).first()[0] or 0
            top = found.filter("key IS NOT NULL").orderBy(F.desc("n"), "key").limit(most).collect()
            least = top[-1].n if len(top) == most else 0
            if off == 0 or least > off:  # a key in no summary occurs ``off`` times at most
                hopeful = [r.key for r in found.filter(F.col("key").isNotNull() & (F.col("n") + off >= least)).select("key").limit(slots + 1).collect()]
                if len(hopeful) <= slots:
                    break
        finally:
            found.unpersist()
        slots *= 4
    candidates = rows.sparkSession.createDataFrame([(k,) for k in hopeful], f"{key} string")  # ``slots`` rows at most
    exact = keys.join(F.broadcast(candidates), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return exact.orderBy(F.desc("n"), key).limit(most)
