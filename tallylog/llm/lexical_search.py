"""Ranked lexical search over a bit-sliced impact index.

Documents become tiles of at most DOCS documents. A term's impacts in a tile are bitmaps,
one for each binary digit, over the words of 64 documents in which it occurs. An item's
scores are the sum of its terms' impacts: bitmaps are added by carries, digit by digit,
for all documents of the tile at once. The best are found from the highest digit down:
documents with the digit set displace those without it, until ``k`` are left.

The first pass reads each text once and keeps counts of the items' terms only, a row for
each tile; numbers of documents and words and document frequencies follow from these
rows. The second pass scores tile by tile, and only the best of each tile are shuffled.
Items are a stated query set and go to the tasks in blocks of about TERMS terms; more
blocks mean more passes, not larger ones.

Null texts and texts without terms are no documents of the index, so never ranked; an
item without terms, or whose terms occur nowhere, has no rows. Null doc_ids come last
among equal scores. Repeated documents are ranked one by one, repeated items each bring
their own rows. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, dropped, lower_ascii, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same over UTF-8, where all bytes of other letters are above ASCII, and lower-casing of A-Z.
BYTES_TERM, BYTES_LOWER = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Documents to a tile, a multiple of 64 and at most 65,536; different terms to a block of items, about; words of term counts that a tile holds.
DOCS, TERMS, POSTINGS = 32_768, 1 << 20, 8_000_000
TILE = pa.schema([("docs", pa.int64()), ("words", pa.int64()), ("ids", pa.binary()), ("unnamed", pa.binary()), ("sizes", pa.binary()), ("terms", pa.list_(pa.int32())), ("found", pa.list_(pa.int64())), ("places", pa.binary()), ("counts", pa.binary())])
TILE_ROW = "docs long, words long, ids binary, unnamed binary, sizes binary, terms array<int>, found array<long>, places binary, counts binary"


class Tile:
    """Documents as they are read: ids, numbers of words, and how often the items' terms occur in each."""

    def __init__(self):
        self.ids, self.sizes, self.terms, self.counts, self.each = [], [], [], [], []

    def add(self, doc_id: int | None, text: bytes, number: dict[bytes, int]) -> None:
        words = BYTES_TERM.findall(text.translate(BYTES_LOWER))
        if not words:
            return
        counts = Counter(words)
        own = counts.keys() & number.keys()
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.terms.extend(map(number.__getitem__, own))
        self.counts.extend(map(counts.__getitem__, own))
        self.each.append(len(own))

    def full(self) -> bool:
        return len(self.ids) == DOCS or len(self.terms) >= POSTINGS

    def row(self) -> pa.RecordBatch:
        terms = np.array(self.terms, np.int32)
        order = np.argsort(terms, kind="stable")
        names, found = np.unique(terms, return_counts=True)
        ids = pa.array(self.ids, pa.int64())
        values = {
            "docs": len(self.ids),
            "words": sum(self.sizes),
            "ids": ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes(),
            "unnamed": ids.is_null().to_numpy(zero_copy_only=False).tobytes(),
            "sizes": np.array(self.sizes, np.int64).tobytes(),
            "terms": names.tolist(),
            "found": found.tolist(),
            "places": np.repeat(np.arange(len(self.ids)), self.each)[order].astype(np.uint16).tobytes(),
            "counts": np.array(self.counts, np.int64)[order].astype(np.uint32).tobytes(),
        }
        return pa.RecordBatch.from_pylist([values], TILE)


def tiles(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """TILE_ROW: the documents with their counts of the terms in ``number``."""
    shared = docs.sparkSession.sparkContext.broadcast(number)  # the terms of a block of items
    narrow = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("binary").alias("text")).filter("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = Tile()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tile.add(doc_id, text.as_py(), shared.value)
                if tile.full():
                    yield tile.row()
                    tile = Tile()
        if tile.ids:
            yield tile.row()

    return narrow.mapInArrow(run, TILE_ROW)


class Impacts:
    """The impacts of one term in a tile: ``digits`` (binary digits, words) over the words of 64 documents in ``at``."""

    def __init__(self, places: np.ndarray, values: np.ndarray):
        self.most = int(values.max(initial=0))
        self.at, start = np.unique(places >> 6, return_inverse=True)
        dense = np.zeros(64 * len(self.at), np.int64)
        dense[start * 64 + (places & 63)] = values
        bits = np.unpackbits(dense.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=self.most.bit_length())
        self.digits = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def add(total: np.ndarray, term: Impacts, shift: int) -> None:
    """Adds a term's impacts, ``shift`` digits up, to the digits of all scores."""
    sums = total[:, term.at]
    carry = np.zeros(len(term.at), np.uint64)
    for k in range(shift, len(sums)):
        old = sums[k]
        if k - shift < len(term.digits):
            more = term.digits[k - shift]
            either = old ^ more
            sums[k], carry = either ^ carry, (old & more) | (either & carry)
        elif carry.any():
            sums[k], carry = old ^ carry, old & carry
        else:
            break
    total[:, term.at] = sums


def members(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def best(total: np.ndarray, k: int, ids: np.ndarray, unnamed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``k`` documents of highest score above 0, equal ones by id."""
    left = np.bitwise_or.reduce(total, axis=0)
    sure, n = np.zeros_like(left), 0
    for digit in total[::-1]:
        ahead = left & digit
        more = int(np.bitwise_count(ahead).sum())
        if n + more > k:
            left = ahead
        else:
            sure, left, n = sure | ahead, left & ~digit, n + more
    ties = members(left)
    ties = ties[np.lexsort((ids[ties], unnamed[ties]))][: k - n]
    places = np.concatenate((members(sure), ties))
    digits = total[:, places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)
    return places, (digits.astype(np.int64) << np.arange(len(total))[:, None]).sum(axis=0)


def weight(docs: int, found: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * found + 1)))


def lengths(sizes: np.ndarray, docs: int, words: int) -> np.ndarray:
    """The part of a document's length in its impacts; whole numbers of any size."""
    most = 25 * int(sizes.max(initial=0)) * docs
    return 75 + (25 * sizes * docs // words if most < 1 << 62 else np.array([25 * int(n) * docs // words for n in sizes], np.int64))


def impacts_of(row: dict, weights: dict[int, int], docs: int, words: int) -> dict[int, Impacts]:
    """The index of one tile."""
    length = lengths(np.frombuffer(row["sizes"], np.int64), docs, words)
    places, counts = np.frombuffer(row["places"], np.uint16).astype(np.int64), np.frombuffer(row["counts"], np.uint32).astype(np.int64)
    one = 1_000_000_000 * counts // (1000 * counts + 12 * length[places])
    index, end = {}, 0
    for term, n in zip(row["terms"], row["found"], strict=True):
        begin, end = end, end + n
        if weights[term]:
            index[term] = Impacts(places[begin:end], weights[term] * one[begin:end])
    return index


def scored(row: dict, items: list[tuple], weights: dict[int, int], docs: int, words: int, k: int) -> pa.RecordBatch:
    """The best of one tile for each item."""
    ids, unnamed = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["unnamed"], np.bool_)
    size = -(-len(ids) // 64)
    ids, unnamed = np.pad(ids, (0, 64 * size - len(ids))), np.pad(unnamed, (0, 64 * size - len(unnamed)))
    index = impacts_of(row, weights, docs, words)
    found = []
    for place, (_, terms) in enumerate(items):
        own = [(index[t], n) for t, n in terms if t in index]
        if not own:
            continue
        total = np.zeros((sum(x.most * n for x, n in own).bit_length(), size), np.uint64)
        for term, n in own:
            for shift in range(n.bit_length()):
                if n >> shift & 1:
                    add(total, term, shift)
        at, score = best(total, k, ids, unnamed)
        found.append((np.full(len(at), place), ids[at], unnamed[at], score))
    item, doc, no_id, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
    return pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=no_id.astype(bool)), pa.array(score)], names=["item", "doc_id", "score"])


def ranked_block(docs: DataFrame, asked: list[tuple[object, list[str]]], k: int, id_col: str, text_col: str) -> DataFrame | None:
    """item (place in ``asked``), rank, doc_id, score for one block of items."""
    number = {t: n for n, t in enumerate(dict.fromkeys(w.encode() for _, words in asked for w in words))}
    items = [(item_id, [(number[w.encode()], n) for w, n in Counter(words).items()]) for item_id, words in asked]
    stored = written(tiles(docs, number, id_col, text_col), "lexical-tiles")
    n, words = stored.agg(F.sum("docs"), F.sum("words")).first()
    if not n:
        return None
    found = stored.select(F.explode(F.arrays_zip("terms", "found")).alias("t")).groupBy("t.terms").agg(F.sum("t.found").alias("n")).collect()  # the items' terms at most
    shared = docs.sparkSession.sparkContext.broadcast((items, {r.terms: weight(n, r.n) for r in found}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield scored(row, *shared.value, n, words, k)

    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    result = written(stored.mapInArrow(run, "item long, doc_id long, score long").withColumn("rank", rank).filter(F.col("rank") <= k), "lexical-ranks")
    dropped(stored)
    return result


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` documents of highest score above 0 for each item."""
    spark = docs.sparkSession
    terms = items.select(items[item_col].alias("item_id"), F.regexp_extract_all(lower_ascii(items[item_text]), F.lit(TERM), F.lit(0)).alias("words")).filter("size(words) > 0")
    asked = written(terms, "lexical-items")
    blocks = -(-(asked.agg(F.sum(F.size(F.array_distinct("words")))).first()[0] or 0) // TERMS)
    kind = asked.schema["item_id"].dataType
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    for b in range(blocks):
        own = [tuple(r) for r in asked.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == b).collect()]
        if own and (found := ranked_block(docs, own, k, id_col, text_col)) is not None:
            names = spark.createDataFrame([(n, item_id) for n, (item_id, _) in enumerate(own)], f"item long, item_id {kind.simpleString()}")
            out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # as many rows as the block has items
    dropped(asked)
    return out
