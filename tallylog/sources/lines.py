"""Lines with their place: (value, file, block, pos).

A block is an input split, ``pos`` ascends within it by one a line. Line numbers over
the whole input follow from the number of lines in each block.
"""

from __future__ import annotations

from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.words import is_blank
from ..operators.folding import before
from .scratch import kept, opened


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of a file, directory or glob, split at line feeds only; trailing carriage returns go, bad UTF-8 becomes U+FFFD.

    Compressed files are read too, as one block each.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.rtrim("value", F.lit("\r")).alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
    )


def head_of(spark: SparkSession, path: str | list[str], most: int = 50, n_bytes: int = 64 << 10) -> DataFrame | None:
    """The first lines of the first file that aren't blank, without a scan of the log; None if there is no file that isn't empty."""
    found = spark.read.format("binaryFile").load(path).filter("length > 0").select("path").orderBy("path").first()
    if found is None:
        return None
    first = read_lines(spark, found.path).filter(~is_blank(F.col("value"))).select(F.substring("value", 1, n_bytes).alias("value"), "file", "block", "pos")
    kind = "value string, file string, block long, pos long"
    return spark.createDataFrame([tuple(r) for r in first.take(most)], kind)  # reads on until there are so many


def lines_from(df: DataFrame, value: str | Column, order: str, block_rows: int = 10_000) -> DataFrame:
    """Rows of a table as lines, in the order of a whole number; blocks are ranges of it, and lie in order where they are read."""
    placed = df.withColumns({"_block": F.floor(F.col(order) / block_rows).cast("long"), "_o": F.col(order)})
    numbered = placed.withColumn("_pos", F.row_number().over(Window.partitionBy("_block").orderBy("_o")).cast("long"))
    line = F.col(value) if isinstance(value, str) else value
    return numbered.select(line.alias("value"), F.lit("").alias("file"), F.col("_block").alias("block"), F.col("_pos").alias("pos"))


def spooled(stream: BinaryIO, folder: str, block_bytes: int) -> str:
    """Writes a stream to files of whole lines and about ``block_bytes`` in a shared folder, which all executors can read; returns the folder."""
    disk, local = opened(folder)
    disk.create_dir(local, recursive=True)
    block = 0
    while part := stream.read(min(block_bytes, 1 << 20)):
        with disk.open_output_stream(f"{local}/block-{block:010}.log") as out:
            n = 0
            while part:
                out.write(part)
                n += len(part)
                if n >= block_bytes:
                    out.write(stream.readline())
                    break
                part = stream.read(min(block_bytes - n, 1 << 20))
        block += 1
    return folder


def numbered(lines: DataFrame) -> DataFrame:
    """Adds ``line_no``, 1 for the first line of the first file: lines before its range of blocks, its block and itself.

    Lines are read twice: once to count those of each block, of which a table is kept, and once to be numbered.
    """
    blocks = kept(lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("lines"), F.min("pos").alias("first_pos")), "blocks")
    offsets = before(blocks, {"offset": ("sum", "lines")}).select("file", "block", (F.col("offset") - F.col("first_pos") + 1).alias("offset"))
    return lines.join(offsets, ["file", "block"]).withColumn("line_no", F.col("offset") + F.col("pos")).drop("offset")
