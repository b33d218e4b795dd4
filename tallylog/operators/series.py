"""Spikes in a per-minute series whose missing minutes count as zero, without filling them in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import minute_label

#: Longest span looked at, deviations above the median, normal consistency of the MAD.
MAX_MINUTES, DEVIATIONS, CONSISTENCY = 5_000_000, 6.0, 1.4826
#: Parts into which a pass of ``ranked`` divides what the last one left; the first pass has 128 for each power of two.
PARTS = 4096
STATS = "median double, mad double, peak long, peak_minute long, minutes long"


def first_part(v: Column) -> Column:
    """A part for each number below 256, and 128 for each power of two beyond; larger numbers never come earlier."""
    up = F.greatest(F.lit(0), F.length(F.bin(v)) - 8)
    return up * 128 + F.expr("shiftright(v, greatest(0, length(bin(v)) - 8))")


def ranked(values: DataFrame, ranks: dict[str, Sequence[int]]) -> dict[str, list[int]]:
    """The values at ``ranks`` (from 0, ascending) of each series of ``values`` (series, v, w): whole numbers from 0 up, each ``w`` times.

    Passes count values by parts of the range and go on with the part in which a rank lies, until a part holds
    one value. A pass brings some thousand counts to the driver at most, however many values there are, and
    one or two passes do for series of counts.
    """
    found: dict[str, dict[int, int]] = {name: {} for name in ranks}
    open_ = [(name, rank, rank, None) for name, own in ranks.items() for rank in own]
    while open_:
        spans = sorted({(name, span) for name, _, _, span in open_}, key=str)
        part = F.lit(None).cast("long")
        which = F.lit(None).cast("int")
        for k, (name, span) in enumerate(spans):
            inside = F.col("series") == name
            own = first_part(F.col("v"))
            if span:
                lo, hi = span
                inside &= F.col("v").between(lo, hi)
                own = F.floor((F.col("v") - lo).cast("decimal(20,0)") * PARTS / F.lit(hi - lo + 1).cast("decimal(20,0)"))
            which, part = F.when(inside, k).otherwise(which), F.when(inside, own.cast("long")).otherwise(part)
        counts = values.select(which.alias("k"), part.alias("part"), "v", "w").filter("k IS NOT NULL").groupBy("k", "part").agg(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        rows = sorted(counts.collect(), key=lambda r: (r.k, r.part))
        left = []
        for name, rank, rest, span in open_:
            for r in (r for r in rows if r.k == spans.index((name, span))):
                if rest < r.n:
                    if r.lo == r.hi:
                        found[name][rank] = r.lo
                    else:
                        left.append((name, rank, rest, (r.lo, r.hi)))
                    break
                rest -= r.n
        open_ = left
    return {name: [found[name][rank] for rank in own] for name, own in ranks.items()}


def middles(values: DataFrame, sizes: dict[str, int]) -> dict[str, float]:
    """The median of each series; the mean of the two in the middle of an even number."""
    both = {name: sorted({(n - 1) // 2, n // 2}) for name, n in sizes.items()}
    return {name: (own[0] + own[-1]) / 2 for name, own in ranked(values, both).items()}


def statistics(minutes: DataFrame, names: Sequence[str]) -> dict[str, tuple]:
    """STATS of each of the columns ``names`` of ``minutes``, which is read three times."""
    spark = minutes.sparkSession
    peaks = [F.max(F.struct(F.col(c).cast("long").alias("v"), (-F.col("minute")).alias("m"))).alias(c) for c in names]
    span = minutes.agg(F.min("minute").alias("lo"), F.max("minute").alias("hi"), F.count(F.lit(1)).alias("there"), *peaks).first()
    if span.lo is None or span.hi - span.lo > MAX_MINUTES:
        return {c: (0.0, 0.0, 0, None, 0) for c in names}
    n = span.hi - span.lo + 1
    seen = minutes.select(F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("long").alias("v")) for c in names])).alias("x")).select("x.*", F.lit(1).cast("long").alias("w"))
    zeros = spark.createDataFrame([(c, 0, n - span.there) for c in names], "series string, v long, w long").filter("w > 0")
    values, sizes = seen.unionByName(zeros), dict.fromkeys(names, n)
    median = middles(values, sizes)
    middle = F.create_map(*[F.lit(x) for c in names for x in (c, median[c])])[F.col("series")]
    mad = middles(values.withColumn("v", F.round(F.abs(F.col("v") - middle)).cast("long")), sizes)
    return {c: (median[c], mad[c], span[c].v, -span[c].m if span[c].v > 0 else None, n) for c in names}


def traffic(minutes: DataFrame, value: str) -> DataFrame:
    """One row: median, mad, peak, peak_minute (null if the peak is 0), minutes. Zeros of missing minutes enter as one weighted value."""
    kept = minutes.select("minute", value).persist()  # a row for each minute
    try:
        return minutes.sparkSession.createDataFrame([statistics(kept, [value])[value]], STATS)
    finally:
        kept.unpersist()


def spikes(minutes: DataFrame, value: str, stats: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """(minute, minute_utc, count, times_median), largest first. A minute without lines is 0 and so never a spike."""
    one = F.broadcast(stats if stats is not None else traffic(minutes, value))  # one row
    v, median = F.col(value), F.col("median")
    high = v > median + DEVIATIONS * F.greatest(F.col("mad") * CONSISTENCY, F.lit(1.0))
    found = minutes.crossJoin(one).filter((F.col("minutes") > 0) & high & (v >= 2 * F.greatest(median, F.lit(1.0))))
    ratio = F.when(median > 0, v / median).otherwise(F.lit(0.0))
    listed = found.select("minute", minute_label(F.col("minute")).alias("minute_utc"), v.cast("long").alias("count"), ratio.alias("times_median"))
    ordered = listed.orderBy(F.desc("count"), "minute")
    return ordered if n is None else ordered.limit(max(1, n))
