"""A pipeline from raw documents to token files: quality, near copies, benchmark passages, source mix, tokens.

Each stage takes what the one before kept, as a table in the shared folder. Columns
may have any names beside those of documents and are kept but by the last stage. Null
and empty texts fail the quality rules; a later stage that meets them takes null for
no words and keeps one of them as a group of copies. Null ids and sources count as a
value of their own. Of repeated rows one stays; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallylog.llm import decontaminate, mixing, quality, simhash, token_codec
from tallylog.llm.shared import bounded_batches, dropped, read_table, scratch_path, written

VOCABULARY, END_ID = 49_408, 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the isolation forest."""
    bounded_batches(spark)
    return quality.good_documents(docs, read_table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8."""
    bounded_batches(spark)
    return simhash.without_near_copies(docs, words=5, similarity=0.8)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row from a benchmark item."""
    return decontaminate.uncontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the coded files, read back from them."""
    bounded_batches(spark)
    path = scratch_path(spark, "pipeline-tokens")
    token_codec.write_tokens(docs, path, tokenizer_path(), VOCABULARY, END_ID)
    return token_codec.read_tokens(spark, path, digest=True)


STAGES = [("quality rules", good), ("SimHash near-dedup", distinct), ("benchmark decontamination", clean), ("source mix", mixed), ("token ids", tokens)]

#: SQL can express neither the forest nor the tokenizer; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k + 1}")
        if k:  # the last stage has written its files, and the others' results stand in tables
            dropped(before)
    return docs
