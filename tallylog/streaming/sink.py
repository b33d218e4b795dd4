"""Results of streams as tables in the shared folder; a batch that is run again replaces what it wrote.

``appended`` keeps a folder for each batch: rows that are final. ``upserted`` keeps the latest row of each key:
batch N writes a version of its own from the last version before N and its rows. So neither depends on how
often a batch is tried, and the driver holds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import dropped


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Batches that have written all of their rows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch-*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().removeprefix("batch-")) for f in found or [])


def appended(folder: str) -> Callable[[DataFrame, int], None]:
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch-{batch}")

    return write


def upserted(folder: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        old = [v for v in versions(spark, folder) if v < batch]
        both = rows
        if old:
            before = spark.read.schema(rows.schema).parquet(f"{folder}/batch-{old[-1]}")
            both = before.join(rows.select(*keys), list(keys), "left_anti").select(*rows.columns).unionByName(rows)
        both.write.mode("overwrite").parquet(f"{folder}/batch-{batch}")
        for v in old[:-1]:  # the last one serves a batch that is run again
            dropped(spark, f"{folder}/batch-{v}")

    return write


def table(spark: SparkSession, folder: str, schema: str, latest: bool = False) -> DataFrame:
    """What a stream has written: all batches, or the latest version."""
    there = versions(spark, folder)
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/batch-{v}" for v in (there[-1:] if latest else there)])


def run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> None:
    """Runs a stream until it has read what is there now; the next call goes on from there."""
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def forget_commit(spark: SparkSession, checkpoint: str) -> None:
    """Has the last batch run again, as after a driver that was lost before it could note the end of it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max((int(f.getPath().getName()) for f in files.listStatus(path) if f.getPath().getName().isdigit()))
    files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/{last}"), False)

