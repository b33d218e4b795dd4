"""What the operators of this subpackage share: word patterns, table reading and the shared scratch folder."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Letters, digits and everything beyond ASCII.
WORD_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The Python side of ``lower_ascii``.
PY_LOWER = str.maketrans(UPPER, LOWER)
PY_WORD = re.compile(WORD)

#: Text bytes that a Python worker handles at once, and that it is sent at once.
SLICE, BATCH = 2 << 20, 8 << 20


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Sets the session to send rows to Python workers in batches of BATCH bytes, so that long texts don't add up in executors' memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is empty (tests, a single machine) a folder below /tmp is
    used and removed at exit; on a cluster an empty setting is an error.
    """
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"/tmp/checkpoints/{context.applicationId}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(f"file://{path}")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder; the JVM deletes it when it ends."""
    path = f"{shared_dir(spark)}/tallylog/{name}-{uuid.uuid4().hex}"
    on_path(spark, path, lambda fs, p: fs.deleteOnExit(p))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    on_path(spark, path, lambda fs, p: fs.delete(p, True))


def on_path(spark: SparkSession, path: str, act):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return act(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that its lineage is cut and its size is known to the planner."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.scratch = path
    return found


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` from which nothing will be computed any more."""
    for table in tables:
        drop_path(table.sparkSession, table.scratch)


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE bytes."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).cumsum()
    begin = 0
    while begin < len(texts):
        base = sizes[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(sizes, base + SLICE, side="right")))
        yield begin, stop
        begin = stop


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker gives back the memory that it has freed; Spark keeps idle workers beside those of later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only the GNU library has it
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def file_system(uri: str):
    """(file system, path) of a URI, for executors; local paths as they are."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that are done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
