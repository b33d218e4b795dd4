"""A mergeable quantile sketch as rows: counts by logarithmic bucket, whose bounds grow by the factor 1.02."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bucket ratio, and the least value told apart.
RATIO, FLOOR = 1.02, 1e-6


def admitted(v: Column) -> Column:
    return (v >= 0) & ~F.isnan(v) & (v < F.lit(float("inf")))


def bucket(v: Column) -> Column:
    """Null for null, which ``greatest`` would leave out."""
    return F.when(v.isNotNull(), F.ceil(F.log(F.greatest(v, F.lit(FLOOR))) / F.log(F.lit(RATIO))).cast("int"))


def sketch(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bucket, n, top): counts and largest value by bucket."""
    v = F.col(value)
    return rows.filter(admitted(v)).groupBy(*keys, bucket(v).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max(v).alias("top"))


def merged(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The sketch of all rows from sketches of parts, or of coarser keys."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def route_sketch(rows: DataFrame) -> DataFrame:
    """(route, bucket, n, errors, top) of parsed access lines; requests without a time stand in the bucket null."""
    v = F.when(admitted(F.col("latency_s")), F.col("latency_s"))
    return rows.groupBy("route", bucket(v).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("errors"), F.max(v).alias("top"))


def quantiles(sketches: DataFrame, qs: dict[str, float], keys: Sequence[str] = (), carried: Sequence[str] = ()) -> DataFrame:
    """One row per key: samples, top, a column per quantile, and ``carried`` columns, which are the same for a key; windows run over the buckets of one key, a few hundred at most."""
    whole = Window.partitionBy(*keys)
    upto = F.sum("n").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = sketches.withColumn("upto", upto).withColumn("samples", F.sum("n").over(whole)).withColumn("most", F.max("top").over(whole))
    middle = F.least(F.pow(F.lit(RATIO), F.col("bucket")) * 2 / (1 + RATIO), F.col("most"))
    rank = lambda q: F.greatest(F.ceil(F.lit(q) * F.col("samples")), F.lit(1))
    found = [F.min(F.when(F.col("upto") >= rank(q), F.struct("bucket", middle.alias("v"))))["v"].alias(name) for name, q in qs.items()]
    return rows.groupBy(*keys).agg(F.max("samples").alias("samples"), F.max("most").alias("top"), *found, *[F.max(c).alias(c) for c in carried])


def slow_routes(routes: DataFrame, least: int = 20, n: int = 5) -> DataFrame:
    """Of a ``route_sketch``, the routes with at least ``least`` timed requests, slowest p95 first."""
    whole = Window.partitionBy("route")
    counted = routes.withColumn("requests", F.sum("n").over(whole)).withColumn("errors", F.sum("errors").over(whole)).filter("bucket IS NOT NULL")
    timed = quantiles(counted, {"p95": 0.95, "p99": 0.99}, ["route"], ["requests", "errors"]).filter(F.col("samples") >= least)
    return timed.orderBy(F.desc("p95"), "route").limit(max(1, n))
