"""Removing lines that nearly repeat an earlier line, by an exact set-similarity join.

A line is the set of its words, lowered. Lines match if the Jaccard similarity of
their sets is 0.8 or more; a line goes if any line before it, by document id and
place, matches. Lines without a word stay, as do those of fewer than ``min_words``
different words, by default none.

Equal sets are one class, represented by its first line. Words are ordered by how
often they occur in all texts, the rarest first. Of n words that a line has, matching
lines share one of the first n - ceil(0.8 n) + 1. If they share a rare word, one that
occurs FEW times at most, it is among these, and each is a key. Words that occur once
can't be shared and are no keys. Otherwise all r rare words of the line are missing in
the other, and the more frequent ones are keys only as pairs of neighbours in the order:
a and b words without a partner lie in a + b gaps between shared words at most, so that
two of the a + b + 2 rarest shared words are neighbours in both lines. As 2 a + b is at
most 0.4 n, these are among the first 0.4 n + 2 - r words. So a word is never a key
because it is frequent; lines meet in keys that few unrelated lines have.

Classes have numbers in the order of their first lines. Of those that have a key, each
meets the HOT before it at once, or the LAST ones if there are more. This settles most
of a large group of variants in a number of pairs that grows with the group; only those
without a match then meet all classes before them that have the key. Candidates pass the
length filter, the positional filter and a bound from parity bitmaps of the sets before
the sets themselves are compared.

How often words occur is kept in CELLS counters by word hash, each as a logarithm in
a byte, so that every task can hold the table (16 MB at most). Words that meet in a
counter count as more frequent than they are, which costs time, but no match, as any
order that all lines share keeps the join exact.

Defined results: null text has no lines; ids are expected to be unique, and lines
that share id and place count as one place, so that repeated rows lose the same
lines; null ids come first; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, tidy, written

#: Similarity as a fraction, and the least number of different words in a line.
NUM, DEN, MIN_WORDS = 4, 5, 1
#: Counters of words: ROWS times ROW.
ROWS, ROW = 1 << 12, 1 << 12
CELLS = ROWS * ROW
#: Times that a word occurs up to which it is a key by itself, as a logarithm in a counter too.
FEW = 12
FEW_STEP = int(3 * math.log2(FEW)) + 1
#: Stands for a word that occurs once.
ALONE = -1
#: Classes before a class with the same key, up to which it is compared with all of them at once, and how many of them it is if there are more.
HOT, LAST = 12, 2
#: What identifies a set: a hash of its words, parities of their hash bits, and its size.
KEYS = ("h", "bits", "n")
#: The index is built in so many parts, one after the other, to bound the disk that its shuffle takes.
PARTS = 3
#: Longs of the filter that picks documents to read again, at most; 8 MB.
FILTER_LONGS = 1 << 20

SPLIT = r"CASE WHEN instr(line, '\t') + instr(line, '\r') + instr(line, '\u000B') + instr(line, '\u000C') = 0 THEN split(line, ' ') ELSE split(line, '[\\x20\\t\\x0B-\\x0D]+') END"
#: An empty word at the beginning or end of a line hashes to itself and is left out.
HASHES = f"array_distinct(array_remove(transform({SPLIT}, w -> xxhash64(w)), xxhash64('')))"
#: Words as numbers, those that occur least first: the counter's logarithm, then 56 bits of a hash. Never negative.
RANK = f"coalesce(shiftleft(cast(get(ranks, hash(w) & {CELLS - 1}) AS BIGINT), 56) | shiftrightunsigned(xxhash64(w), 8), 0L)"
#: ``ranks`` may be named once only, as Spark would else copy the table for each row.
RANKED = f"sort_array(array_distinct(transform(array_remove({SPLIT}, ''), w -> {RANK})))"



def text_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, place, line): all lines, lowered."""
    return docs.select(docs[id_col].alias("doc_id"), F.posexplode(F.split(F.lower(docs[text_col]), "\n")).alias("place", "line"))


def dense(entries: str) -> str:
    """Sorted numbers at * 128 + v as an array of ROW bytes in which v stands at place ``at``, and 0 elsewhere."""
    gap = f"(shiftright(x, 7) - coalesce(shiftright(get({entries}, i - 1), 7), -1) - 1)"
    filled = f"flatten(transform({entries}, (x, i) -> concat(array_repeat(0Y, {gap}), array(cast(x % 128 AS TINYINT)))))"
    return f"concat({filled}, array_repeat(0Y, {ROW} - 1 - shiftright(element_at({entries}, -1), 7)))"


def word_ranks(docs: DataFrame, text_col: str) -> DataFrame:
    """One row: for each counter 1 if its words occur once in all texts, more the more often they do, as an array of CELLS bytes."""
    lines = docs.select(F.explode(F.split(F.lower(docs[text_col]), "\n")).alias("line"))
    words = lines.select(F.explode(F.expr(SPLIT)).alias("w")).filter("w <> ''")
    counts = words.select(F.expr(f"hash(w) & {CELLS - 1}").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("times"))
    steps = counts.select(F.expr(f"cast(cell div {ROW} AS INT)").alias("row"), F.expr(f"cast(cell % {ROW} * 128 + least(127, floor(3 * log2(times)) + 1) AS INT)").alias("e"))
    rows = steps.groupBy("row").agg(F.sort_array(F.collect_list("e")).alias("es")).select("row", F.expr(dense("es")).alias("cells"))
    every = docs.sparkSession.range(0, ROWS, 1, 1).select(F.col("id").cast("int").alias("row"))
    filled = every.join(rows, "row", "left").select("row", F.coalesce("cells", F.expr(f"array_repeat(0Y, {ROW})")).alias("cells"))
    return filled.agg(F.expr("flatten(transform(array_sort(collect_list(struct(row, cells))), x -> x.cells))").alias("ranks"))


def line_sets(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(doc_id, place, h, bits, n, skipped, singles, keys) of all lines with enough words: ``skipped`` words that occur once, ``singles`` keys of one word, then keys of two."""
    ranked = text_lines(docs, id_col, text_col).withColumn("ranks", written(word_ranks(docs, text_col), "line-ranks").scalar())
    ranked = ranked.select("doc_id", "place", F.expr(RANKED).alias("ws")).withColumn("n", F.size("ws"))
    head = f"slice(ws, 1, {indexed('n')})"
    below = lambda step: F.expr(f"size(filter({head}, k -> k < {step << 56}L))")
    counted = ranked.withColumn("skipped", below(2)).withColumn("rare", below(FEW_STEP + 1))
    able, twos = f"{DEN} * n >= {NUM} * (n + 1)", f"IF(rare = {indexed('n')}, 0, greatest(0, {reach('n')} - 2 * rare - 1))"
    singles = "slice(ws, skipped + 1, rare - skipped)"
    doubles = f"zip_with(slice(ws, rare + 1, {twos}), slice(ws, rare + 2, {twos}), (a, b) -> xxhash64(a, b))"
    return counted.select(
        "doc_id",
        "place",
        F.expr("xxhash64(ws)").alias("h"),
        F.expr("aggregate(ws, 0L, (a, k) -> a ^ shiftleft(1L, cast(k & 63L AS INT)))").alias("bits"),
        "n",
        "skipped",
        F.expr("rare - skipped").alias("singles"),
        F.expr(f"CASE WHEN {able} THEN concat({singles}, {doubles}) ELSE slice(ws, 1, 0) END").alias("keys"),
        F.expr(f"transform(slice(ws, 1, {indexed('n')} + 1), k -> IF(k < {2 << 56}L, cast({ALONE} AS BIGINT), k))").alias("prefix"),
    ).filter(f"n >= {min_words}" if min_words else "true")


def indexed(n: str) -> str:
    """How many words of a set of ``n`` hold one, at least, of each set that matches."""
    return f"({n} - ({NUM} * {n} + {DEN - 1}) div {DEN} + 1)"


def reach(n: str) -> str:
    """How many words of a set of ``n`` hold two neighbours, at least, that are neighbours in a matching set too."""
    return f"(2 * {DEN - NUM} * {n} div {DEN} + 2)"


def may_match(x: str, y: str) -> str:
    """Length, positional and bitmap filters on the postings ``x`` and ``y``."""
    least = f"(({NUM} * ({x}.n + {y}.n) + {NUM + DEN - 1}) div {NUM + DEN})"  # words that must be shared
    return (
        f"{DEN} * least({x}.n, {y}.n) >= {NUM} * greatest({x}.n, {y}.n)"
        f" AND least({x}.n - {x}.at, {y}.n - {y}.at) >= {least}"
        f" AND bit_count({x}.bits ^ {y}.bits) <= {x}.n + {y}.n - 2 * {least}"
    )


def keyed(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """(o, n, bits, skipped, singles, keys) of each class that has keys, from its first line."""
    first = classes.select("o", F.col("doc_id").alias("first_id"), F.col("place").alias("first_place"))
    same = lines.doc_id.eqNullSafe(first.first_id) & (lines.place == first.first_place)
    return lines.filter("size(keys) > 0").join(first, same).select("o", "n", "bits", "skipped", "singles", "keys")


def postings(keyed: DataFrame, part: int) -> DataFrame:
    """(key, c): each key of this part of each class."""
    each = keyed.select("o", "n", "bits", "skipped", "singles", F.posexplode("keys").alias("i", "key")).filter(f"pmod(key, {PARTS}) = {part}")
    # What comes before the two words of a key is not known, so only keys of one word have a place.
    return each.select("key", F.struct("o", "n", F.expr("IF(i < singles, skipped + i, 0)").alias("at"), "bits").alias("c"))


def placed(posted: DataFrame) -> DataFrame:
    """(key, c, nth, many, ys): classes in order under each key, with the numbers of those before that may match, of those that are met at once."""
    key, whole = Window.partitionBy("key").orderBy("c.o"), Window.partitionBy("key")
    before = F.collect_list("c").over(key.rowsBetween(-HOT, -1))
    every = posted.select("key", "c", F.row_number().over(key).alias("nth"), before.alias("cs"), F.count(F.lit(1)).over(whole).alias("many"))
    near = F.expr(f"filter(IF(nth <= {HOT + 1}, cs, slice(cs, -{LAST}, {LAST})), y -> y.o < c.o AND {may_match('c', 'y')})")
    found = every.filter("many > 1").select("key", "c", "nth", "many", near.alias("ys"))
    return found.select("key", "c", "nth", "many", F.col("ys.o").alias("ys")).filter(f"size(ys) > 0 OR many > {HOT + 1}")


def matching(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The numbers ``o`` of the later classes of those pairs (x, y: class numbers) whose sets really match; only documents that hold one of them are read again."""
    needed = pairs.select(F.explode(F.array("x", "y")).alias("o")).distinct().join(classes.select("o", "doc_id", "place"), "o")
    needed = written(needed, "line-needed")
    lines = text_lines(holding(docs, needed, id_col, text_col), "doc_id", "text")
    found = needed.join(lines, needed.doc_id.eqNullSafe(lines.doc_id) & (needed.place == lines.place))
    sets = written(found.select("o", F.expr(HASHES).alias("hs")).dropDuplicates(["o"]), "line-sets")
    side = lambda k: sets.select(F.col("o").alias(k), F.col("hs").alias(f"h{k}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    alike = both.filter(F.size(F.array_intersect("hx", "hy")) * (NUM + DEN) >= NUM * (F.size("hx") + F.size("hy")))
    late = written(alike.select(F.col("x").alias("o")).distinct(), "line-found")
    dropped(needed, sets)
    return late


def holding(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of the documents named in ``needed`` and, as a filter of hash bits decides, a few more; texts aren't shuffled."""
    longs = 1 << 10
    while longs < min(FILTER_LONGS, needed.count() // 4):
        longs *= 2
    at, bit = (lambda c: f"shiftrightunsigned(xxhash64({c}), 6) & {longs - 1}L"), (lambda c: f"cast(xxhash64({c}) & 63L AS INT)")
    cell = needed.select(F.expr(at("doc_id")).alias("cell"), F.expr(f"shiftleft(1L, {bit('doc_id')})").alias("v"))
    every = docs.sparkSession.range(0, longs, 1, 4).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("v"))
    filled = every.unionByName(cell).groupBy("cell").agg(F.bit_or("v").alias("v")).agg(F.expr("transform(array_sort(collect_list(struct(cell, v))), x -> x.v)").alias("a"))
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).withColumn("bitmap", filled.scalar())
    return own.filter(f"getbit(get(bitmap, cast({at('doc_id')} AS INT)), {bit('doc_id')}) = 1").select("doc_id", "text")


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, place) of every line that matches a line before it."""
    spark, place = docs.sparkSession, F.struct("doc_id", "place")
    # The filter comes after, as Spark would make the sets twice to have it first.
    sets = written(line_sets(docs, id_col, text_col, 0).drop("prefix"), "lines")
    lines = sets.filter(F.col("n") >= min_words)
    # The first line of equal sets stands for its class; the later ones go, as do classes that match an earlier one.
    firsts = lines.groupBy(*KEYS).agg(F.min(place).alias("first")).select("first.*", "h").repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place", "h")
    # Numbers of rows ascend within and between the range partitions, and stay as they are in the table.
    classes = written(firsts.select(F.monotonically_increasing_id().alias("o"), "doc_id", "place"), "line-classes")
    tidy(spark)

    keys, every = written(keyed(lines, classes), "line-keys"), written(lines.select("doc_id", "place"), "line-places")
    dropped(sets)
    tidy(spark)
    mets = []
    for part in range(PARTS):
        mets.append(written(placed(postings(keys, part)), "line-met"))
        tidy(spark)
    dropped(keys)
    met = reduce(DataFrame.unionByName, mets)
    pairs = written(met.select(F.col("c.o").alias("x"), F.explode("ys").alias("y")).distinct(), "line-pairs")
    once = matching(pairs, classes, docs, id_col, text_col)
    dropped(pairs)
    tidy(spark)
    # Who has no match so far meets all that come before with a key that many have.
    x = met.filter(f"nth > {HOT + 1}").select("key", F.col("c").alias("x"), "nth").join(once, F.col("x.o") == once.o, "left_anti")
    y = met.filter(f"many > {HOT + 1}").select("key", F.col("c").alias("y"), F.col("nth").alias("place"))
    left = x.join(y, "key").filter(f"place < nth - {LAST} AND y.o < x.o AND {may_match('x', 'y')}")
    more = written(left.select(F.col("x.o").alias("x"), F.col("y.o").alias("y")).distinct(), "line-pairs")
    dropped(*mets)
    tidy(spark)
    then = matching(more, classes, docs, id_col, text_col)
    dropped(more)
    kept = classes.join(once.unionByName(then), "o", "left_anti").select(F.col("doc_id").alias("kept_id"), F.col("place").alias("kept_place"))
    return every.join(kept, every.doc_id.eqNullSafe(kept.kept_id) & (every.place == kept.kept_place), "left_anti")


def line_report(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed and removed_lines (places from 0, comma-joined) for every row."""
    gone = removed_lines(docs, min_words, id_col, text_col).groupBy(F.col("doc_id").alias("of")).agg(F.array_sort(F.collect_set("place")).alias("places"))
    n_lines = F.when(docs[text_col].isNull(), 0).otherwise(F.length(docs[text_col]) - F.length(F.replace(docs[text_col], F.lit("\n"))) + 1)
    counted = docs.select(docs[id_col].alias("doc_id"), n_lines.cast("long").alias("n_lines"))
    return counted.join(gone, counted.doc_id.eqNullSafe(gone.of), "left").select(
        "doc_id",
        "n_lines",
        F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("places").cast("array<string>"), ","), F.lit("")).alias("removed_lines"),
    )


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with shortened texts and all other columns, whatever their names."""
    gone = removed_lines(docs, min_words, id_col, text_col).groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("place").alias("places"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    joined = rows.join(gone, F.col(f"row.{id_col}").eqNullSafe(gone.of), "left")
    text = F.col(f"row.{text_col}")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, k: ~F.array_contains("places", k)), "\n")
    shorter = F.when(F.col("places").isNull(), text).otherwise(kept)
    return joined.select(*[shorter.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
