"""Benchmark decontamination by winnowing.

Texts become words (A-Z lowered). Of every ``guard`` = 10 consecutive words the
smallest of the five 6-gram hashes is kept, so any span of ten shared words keeps
the same 6-gram on both sides. Fingerprints of training rows are tested against a
bitmap made of the benchmark's, then joined with them; each match fixes a diagonal,
along which the words themselves are compared and all windows that really occur are
marked. A window whose smallest 6-gram passes the bitmap is also tested by the hash
of all its words, so that few chance matches reach the join. Benchmark texts below ten words are one window each
and are looked up by the hash of all their words.

Work is done once per distinct text: copies share a digest. Defined results: null
or wordless texts have no words and no hits; null item ids count as one item with
an empty name; repeated item rows count once; an empty benchmark hits nothing.
Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD_ALNUM, lower_ascii, written

GUARD, GRAM = 10, 6
#: Bits of the bitmap for each fingerprint, and longs that it has at least and at most (16 MB). False positives only cost a later comparison.
BITMAP_BITS, LEAST_LONGS, MOST_LONGS = 32, 1 << 12, 1 << 21


def words_of(text: Column) -> Column:
    """Words as an array; texts without letters beyond ASCII take the faster of two equal ways to lower case."""
    lowered = F.when(text.rlike(r"[^\x00-\x7F]"), lower_ascii(text)).otherwise(F.lower(text))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD_ALNUM), F.lit(0)), F.array().cast("array<string>"))


def gram_hash(size: int, at: str = "i") -> str:
    return f"xxhash64({size}, " + ", ".join(f"get(wh, {at} + {j})" for j in range(size)) + ")"


def with_grams(df: DataFrame) -> DataFrame:
    """Adds to ``words``: word hashes ``wh``, 6-gram hashes ``kg`` and the smallest of each window, ``mins``."""
    least = "least(" + ", ".join(f"get(kg, i + {j})" for j in range(GUARD - GRAM + 1)) + ")"
    return (
        df.withColumn("n", F.size("words"))
        .withColumn("wh", F.expr("transform(words, w -> xxhash64(w))"))
        .withColumn("kg", F.expr(f"CASE WHEN n >= {GUARD} THEN transform(sequence(0, n - {GRAM}), i -> {gram_hash(GRAM)}) ELSE array() END"))
        .withColumn("mins", F.expr(f"CASE WHEN n >= {GUARD} THEN transform(sequence(0, n - {GUARD}), i -> {least}) ELSE array() END"))
    )


def bitmap_longs(fingerprints: int) -> int:
    """How many longs the bitmap has, a power of two."""
    longs = LEAST_LONGS
    while longs < min(MOST_LONGS, fingerprints * BITMAP_BITS // 64):
        longs *= 2
    return longs


def marked(h: str) -> str:
    return f"getbit(get(bitmap, cast(shiftrightunsigned({h}, 6) & (size(bitmap) - 1) AS INT)), cast({h} & 63 AS INT)) = 1"


def anchor(at: str = "i") -> str:
    """Where in the window that starts at ``at`` its smallest 6-gram stands, and its hash."""
    return f"named_struct('at', {at} + cast(array_position(slice(kg, {at} + 1, {GUARD - GRAM + 1}), get(mins, {at})) AS INT) - 1, 'hash', get(mins, {at}))"


def benchmark_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    return items.select(F.coalesce(items[id_col].cast("string"), F.lit("")).alias("item"), words_of(items[text_col]).alias("words")).filter("size(words) > 0")


def item_fingerprints(contents: DataFrame) -> DataFrame:
    """(content, words) as (content, at, hash, span): the anchor's place and hash, and the hash of its whole window."""
    grams = with_grams(contents)
    windows = f"transform(sequence(0, n - {GUARD}), i -> struct({anchor()} AS anchor, {gram_hash(GUARD)} AS span))"
    short = " ".join(f"WHEN n = {k} THEN array(struct(named_struct('at', 0, 'hash', {gram_hash(k, '0')}) AS anchor, {gram_hash(k, '0')} AS span))" for k in range(1, GUARD))
    return grams.select("content", F.explode(F.expr(f"CASE WHEN n >= {GUARD} THEN {windows} {short} END")).alias("w")).select("content", "w.anchor.at", "w.anchor.hash", "w.span").distinct()


def bitmap_of(fingerprints: DataFrame) -> DataFrame:
    """One row with one array of longs."""
    longs = bitmap_longs(fingerprints.count())
    hashes = fingerprints.select(F.explode(F.array("hash", "span")).alias("h"))
    cells = hashes.select(F.expr(f"shiftrightunsigned(h, 6) & {longs - 1}").alias("cell"), F.expr("shiftleft(1L, cast(h & 63 AS INT))").alias("bit"))
    every = fingerprints.sparkSession.range(0, longs, 1, 8).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("bit"))
    filled = every.unionByName(cells).groupBy("cell").agg(F.bit_or("bit").alias("bits"))
    return filled.agg(F.expr("transform(array_sort(collect_list(struct(cell, bits))), x -> x.bits)").alias("bitmap"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    named = written(benchmark_items(items, item_col, item_text_col).withColumn("content", F.md5(F.array_join("words", " "))), "bench-items")
    contents = named.groupBy("content").agg(F.first("words").alias("words"))
    prints = written(item_fingerprints(contents), "bench-prints")
    short = sorted(r.n for r in contents.filter(F.size("words") < GUARD).select(F.size("words").alias("n")).distinct().collect())

    found = [f"transform(filter(sequence(0, n - {GUARD}), i -> {marked('get(mins, i)')} AND {marked(gram_hash(GUARD))}), i -> {anchor()})"]
    arrays = [f"CASE WHEN n >= {GUARD} THEN {found[0]} ELSE array() END"]
    for k in short:  # at most nine lengths
        arrays.append(
            f"CASE WHEN n >= {k} THEN transform(filter(sequence(0, n - {k}), i -> {marked(gram_hash(k))}), i -> named_struct('at', i, 'hash', {gram_hash(k)})) ELSE array() END"
        )
    grams = with_grams(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), words_of(docs[text_col]).alias("words")))
    anchors = grams.withColumn("bitmap", bitmap_of(prints).scalar()).withColumn("anchors", F.expr(f"array_distinct(concat({', '.join(arrays)}))"))
    hit = F.size("anchors") > 0
    tested = written(
        anchors.select("doc_id", F.col("n").cast("long").alias("n_words"), F.when(hit, F.md5("text")).alias("content"), F.when(hit, F.col("words")).alias("words"), F.when(hit, F.col("anchors")).alias("anchors")),
        "bench-tested",
    )
    texts = tested.filter("content IS NOT NULL").groupBy("content").agg(F.first("words").alias("words"), F.first("anchors").alias("anchors"))
    hits = written(extended(texts, prints, contents), "bench-hits")
    covered = hits.select("content", F.explode("places").alias("place")).distinct().groupBy("content").agg(F.count(F.lit(1)).alias("n_hit"))
    ids = hits.select("content", "item_content").distinct().join(named.select(F.col("content").alias("item_content"), "item"), "item_content").select("content", "item").distinct()
    listed = ids.groupBy("content").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    return (
        tested.select("doc_id", "n_words", "content")
        .join(written(covered.join(listed, "content"), "bench-found"), "content", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def extended(texts: DataFrame, prints: DataFrame, contents: DataFrame) -> DataFrame:
    """(content, item_content, places): the word places that windows of the item cover, by comparing words along each diagonal."""
    item = contents.select(F.col("content").alias("item_content"), F.col("words").alias("item_words"))
    anchors = texts.select("content", F.explode("anchors").alias("a")).select("content", F.col("a.at").alias("doc_at"), F.col("a.hash").alias("hash"))
    pairs = anchors.join(prints.select(F.col("content").alias("item_content"), "at", "hash"), "hash")
    diagonals = pairs.select("content", "item_content", (F.col("doc_at") - F.col("at")).alias("shift")).distinct()
    rows = diagonals.join(item, "item_content").join(texts.select("content", "words"), "content").withColumn("span", F.expr(f"least({GUARD}, size(item_words))"))
    same = "transform(item_words, (w, j) -> j + shift >= 0 AND coalesce(get(words, j + shift) = w, false))"
    starts = "filter(sequence(0, size(item_words) - span), j -> forall(slice(same, j + 1, span), x -> x))"
    placed = rows.withColumn("same", F.expr(same)).withColumn("starts", F.expr(starts)).filter("size(starts) > 0")
    return placed.select("content", "item_content", F.expr("array_distinct(flatten(transform(starts, j -> sequence(j + shift, j + shift + span - 1))))").alias("places"))


def uncontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **kwargs) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with all their columns."""
    found = contamination(docs.select(F.md5(docs[text_col]).alias("key"), docs[text_col].alias("text")), items, id_col="key", **kwargs)
    bad = written(found.filter("contaminated").select("doc_id").distinct(), "bench-bad").withColumnRenamed("doc_id", "bad_text")
    return docs.join(bad, F.md5(docs[text_col]) == bad.bad_text, "left_anti")
