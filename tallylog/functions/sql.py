"""The parsers and keys as functions of SQL: ``register`` makes temporary functions of a session, written in SQL throughout.

Scalar: ``parse_clf(text)``, ``parse_iso(text)`` (a struct of ms and used), ``route(path)``, ``message_key(message)``, ``level_rank(word)``,
``level_name(rank)``, ``minute_label(minute)``. Table: ``access_line(line)``, a row of the line's fields or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parsers
from . import times, words

SCALARS = {
    "parse_clf": ("text STRING", times.clf_ms),
    "parse_iso": ("text STRING", times.iso_prefix),
    "route": ("path STRING", words.route),
    "message_key": ("message STRING", words.message_key),
    "level_rank": ("word STRING", words.level_rank),
    "level_name": ("rank INT", words.level_name),
    "minute_label": ("minute BIGINT", times.minute_label),
}
ACCESS = "ts_ms BIGINT, method STRING, path STRING, status INT, bytes DECIMAL(20, 0), latency_s DOUBLE"


def text_of(df: DataFrame, column: Column) -> str:
    """SQL of a column over ``df``, as Spark resolves it."""
    return df.select(column.alias("x"))._jdf.queryExecution().analyzed().expressions().head().child().sql()


def register(spark: SparkSession) -> SparkSession:
    for name, (argument, function) in SCALARS.items():
        own = spark.createDataFrame([], argument)
        column = function(F.col(own.columns[0]))
        kind = own.select(column.alias("x")).schema["x"].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({argument}) RETURNS {kind} RETURN {text_of(own, column)}")
    line = spark.createDataFrame([], "line STRING")
    first, second, record = parsers.access_steps(F.col("line"), 1.0, parsers.ACCESS_FIELDS)
    listed = lambda df, step: ", ".join(f"{text_of(df, c)} AS {name}" for name, c in step.items())
    taken, timed = line.withColumns(first), line.withColumns(first).withColumns(second)
    inner = f"SELECT *, {listed(taken, second)} FROM (SELECT {listed(line, first)})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION access_line(line STRING) RETURNS TABLE({ACCESS}) RETURN SELECT x.* FROM (SELECT explode(array({text_of(timed, record)})) AS x FROM ({inner})) WHERE x IS NOT NULL")
    return spark
