"""The queries of this subpackage, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, lexical_search, line_dedup, mixing, ngram_lm, quality, simhash, spelling, token_codec, topk_search, toxicity, warc
from .oracles import ORACLES
from .shared import bounded_batches, read_table, scratch_path


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents"))


def op2_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return quality.quality_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return html_text.page_report(read_table(spark, sf_dir, "pages"))


def op4_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return warc.page_records(read_table(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=4, radius=4)


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), lambda doc_id: id_fold(doc_id, 3) == 1)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read_table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    return ngram_lm.scores(docs, id_fold(docs.doc_id, 7) == 2)


def op9_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    import public_tokenizers

    path = scratch_path(spark, "rans")
    token_codec.write_tokens(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), vocabulary=49_408, end_id=2)
    return token_codec.read_tokens(spark, path, digest=True)


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk_search.top_scores(vectors, vectors.vec_id % 20 == 0)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return lexical_search.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
