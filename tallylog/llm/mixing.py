"""Mixing sources to target weights by hash-threshold histograms.

A source's budget is its weighted share of all sizes, at most ``max_repeats``
times its own size. Its documents are taken whole as often as the budget allows;
what remains of the budget goes to the documents whose 60-bit hash lies below a
threshold. The threshold is found without sorting documents: sizes are summed by
source and hash bucket, and only the bucket in which the budget ends is split
further, twelve bits at a time.

Defined results: null text has size 0; null sources are one source, the last in
order; a source of size 0 has target 0; rows alike in id and text share a hash and
are taken or left together; an empty table gives an empty result. Only the named
columns are read, others are carried along as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, written

HASH_BITS, STEP_BITS = 60, 12


def document_size(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of a digest of id and text, the same at every run."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """``sizes`` (src, size) as one row per source with its total and its target.

    With r = cap / weight ascending, the level at which capped sources drop out is
    the largest (all - caps before) / (weights - weights before). The windows here
    run over one row per source, not over documents.
    """
    by_source = sizes.groupBy("src").agg(F.sum("size").alias("total"))
    place = F.row_number().over(Window.orderBy(F.col("src").isNull(), "src"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn("cap", F.col("total") * F.lit(max_repeats))
    everything, before = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "weight").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("total").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        ranked.withColumn("level", level)
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(everything)))
        .select("src", "total", "target")
    )


def hash_thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole ``copies`` of every document, and ``cut``, below which a hash gets one copy more."""
    copies = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(F.lit(0)).cast("long")
    budgets = written(targets.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("total")), "mix-budgets")
    at = budgets.filter("rest > 0").select("src", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for done in range(0, HASH_BITS, STEP_BITS):
        above = F.shiftrightunsigned(F.col("hash"), HASH_BITS - done) if done else F.lit(0).cast("long")
        bucket = F.shiftrightunsigned(F.col("hash"), HASH_BITS - done - STEP_BITS)
        here = at.withColumnRenamed("src", "of")
        inside = sizes.join(here, sizes.src.eqNullSafe(here.of) & (above == here.prefix))
        sums = inside.groupBy("src", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("src").orderBy("bucket"))
        at = written(
            sums.withColumn("upto", upto)
            .filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
            .select("src", "rest", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("words")).alias("before"), "words"),
            "mix-boundary",
        )
    nearer = F.col("before") + F.col("words") - F.col("rest") < F.col("rest") - F.col("before")
    cuts = at.select(F.col("src").alias("of"), (F.col("prefix") + nearer.cast("long")).alias("cut"))
    return written(budgets.join(cuts, budgets.src.eqNullSafe(cuts.of), "left").select("src", "total", "target", "copies", "cut"), "mix-thresholds")


def mix(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One struct column ``mix`` (size, source_size, target, times) beside the columns of ``docs``, kept as a struct ``doc``."""
    row = F.struct(*[docs[c] for c in docs.columns])
    size, key = document_size(docs[text_col]), document_hash(docs[id_col], docs[text_col])
    sizes = written(docs.select(docs[source_col].alias("src"), size.alias("size"), key.alias("hash")), "mix-sizes")
    cuts = hash_thresholds(sizes, source_targets(sizes, weights, max_repeats))
    packed = docs.select(row.alias("doc"), docs[source_col].alias("of"), size.alias("size"), key.alias("hash"))
    return decided(packed, cuts).select("doc", F.struct("size", F.col("total").alias("source_size"), "target", "times").alias("mix"))


def decided(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (of, size, hash) with how many times each is taken; the joined side has one row per source, and Spark checks its size."""
    extra = F.coalesce(F.col("hash") < F.col("cut"), F.lit(False)).cast("long")
    return rows.join(cuts, rows.of.eqNullSafe(cuts.src)).withColumn("times", F.col("copies") + extra)


def mix_report(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row; the texts are scanned once."""
    sizes = written(
        docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("src"), document_size(docs[text_col]).alias("size"), document_hash(docs[id_col], docs[text_col]).alias("hash")),
        "mix-sizes",
    )
    cuts = hash_thresholds(sizes.drop("doc_id"), source_targets(sizes, weights, max_repeats))
    return decided(sizes.withColumnRenamed("src", "of"), cuts).select(
        "doc_id", "size", F.col("total").alias("source_size"), "target", (F.col("size") * F.col("times")).alias("taken")
    )


def mixed_documents(docs: DataFrame, **kwargs) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of ``docs``."""
    taken = mix(docs, **kwargs).filter("mix.times > 0")
    return taken.select("doc", F.explode(F.expr("sequence(1L, mix.times)")).alias("copy")).select("doc.*")
