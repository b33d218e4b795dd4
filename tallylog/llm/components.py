"""Connected components over a table of links, by alternating large and small stars.

Each round is two joins and two aggregations, and nothing but a count comes to the
driver. Aggregations combine the links of a node before the shuffle; the joins bring
them to one partition, which adaptive execution splits where a node has very many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_path, scratch_path


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) as (node, root), root the smallest node reachable; isolated nodes don't appear."""
    spark = links.sparkSession
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct()
    path = scratch_path(spark, "links")
    edges.write.parquet(path)
    while True:
        edges = spark.read.schema(edges.schema).parquet(path)
        top = edges.groupBy("hi").agg(F.min("lo").alias("top"), F.count(F.lit(1)).alias("n"))
        inner = edges.join(edges.select(F.col("hi").alias("lo")), "lo", "left_semi").limit(1)
        if top.filter("n > 1").limit(1).isEmpty() and inner.isEmpty():
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        parent = top.select(F.col("hi").alias("of"), "top")
        large = edges.join(parent, edges.lo == parent.of, "left").select("hi", F.coalesce("top", "lo").alias("lo")).distinct()
        parent = large.groupBy("hi").agg(F.min("lo").alias("top"))
        moved = large.join(parent, "hi").filter("lo <> top").select(F.col("lo").alias("hi"), F.col("top").alias("lo"))
        after = scratch_path(spark, "links")
        moved.unionByName(parent.select("hi", F.col("top").alias("lo"))).distinct().write.parquet(after)
        drop_path(spark, path)
        path = after
