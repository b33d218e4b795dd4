"""Counts over parsed lines; all are partial and final hash aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words


def ok(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'ok'")


def status_classes(rows: DataFrame) -> DataFrame:
    name = F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx"))
    return ok(rows).groupBy(name.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def levels(rows: DataFrame) -> DataFrame:
    return ok(rows).groupBy("level_rank").agg(F.count(F.lit(1)).alias("n")).select(words.level_name(F.col("level_rank")).alias("level"), "n")


def byte_total(rows: DataFrame) -> DataFrame:
    """Sum of response bytes, wide enough not to overflow."""
    return ok(rows).agg(F.coalesce(F.sum(F.col("bytes").cast("decimal(20,0)")), F.lit(0)).alias("bytes"))


def minute_counts(rows: DataFrame) -> DataFrame:
    return ok(rows).groupBy("minute").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("errors"))


def route_counts(rows: DataFrame) -> DataFrame:
    return ok(rows).groupBy("route").agg(F.count(F.lit(1)).alias("requests"), F.count_if("is_error").alias("errors"))


def error_messages(rows: DataFrame) -> DataFrame:
    return ok(rows).filter("is_error").groupBy("message").agg(F.count(F.lit(1)).alias("n"))


def capped(counts: DataFrame, key: str, n: str, most: int) -> DataFrame:
    """An optional cap on keys, the same at every run: the ``most`` largest keys, the rest as ``(other)``."""
    top = counts.orderBy(F.desc(n), key).limit(most)
    rest = counts.join(top.select(key), key, "left_anti").agg(F.sum(n).alias(n)).filter(F.col(n).isNotNull())
    return top.unionByName(rest.withColumn(key, F.lit("(other)")))


def top_errors(rows: DataFrame, n: int = 5) -> DataFrame:
    return error_messages(rows).orderBy(F.desc("n"), "message").limit(max(1, n))


def error_routes(routes: DataFrame, n: int = 5) -> DataFrame:
    return routes.filter("errors > 0").orderBy(F.desc("errors"), "route").limit(max(1, n))
