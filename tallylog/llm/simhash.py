"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: the majority of each bit over the XXH64 hashes of all word shingles
of a text. Distinct fingerprints are dealt to tiles by the population counts of
their four 16-bit quarters. Two fingerprints within the radius differ by at most
the radius in the sum of these counts' differences, so only such tile pairs are
compared, exhaustively, by exclusive-or and bit counts. Tiles hold about
``TILE`` fingerprints; larger groups are split by hash. What a tile pair finds
leaves as a spanning forest, and components are joined from these links.

The comparison is exact, so its work grows with the square of the number of
distinct fingerprints, divided by about ten by the skipped pairs.

Defined results: null or wordless texts have fingerprint zero and link like any
other; copies share a fingerprint and cost nothing more; null ids don't name a
component unless it has no other; an empty table gives an empty result. Only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import WORD, dropped, lower_ascii, tidy, trimmed, written

SEED, PART_BITS, PARTS = 42, 16, 4
TILE = 1024
#: Hashes whose bits are unpacked at once.
CHUNK = 1 << 16


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, A-Z lowered; of the whole sequence if it is shorter, none without words."""
    split = (text or b"").lower().split()
    joined = b" ".join(split)
    if len(split) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if split else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(each: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed number; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(each), CHUNK):
        # Eight bits are added at a time, each in a byte of a long, which holds the sum of 255.
        bits = np.unpackbits(each[at : at + CHUNK].view(np.uint8)).view(np.uint64).reshape(-1, 8)
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(each)).view(np.int64)[0])


def fingerprint(text: bytes | None, words: int) -> int:
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row."""
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return narrow.mapInArrow(trimmed(run), f"doc_id {kind}, fp long")


def part_counts(fp: str = "fp") -> list[Column]:
    mask = (1 << PART_BITS) - 1
    return [F.expr(f"bit_count(shiftrightunsigned({fp}, {PART_BITS * k}) & {mask}L)") for k in range(PARTS)]


def offsets(radius: int) -> list[list[int]]:
    """One of each pair of opposite count differences within the radius, and no difference."""
    found = [[]]
    for _ in range(PARTS):
        found = [[*x, d] for x in found for d in range(-radius, radius + 1) if sum(map(abs, x)) + abs(d) <= radius]
    return [x for x in found if x >= [0] * PARTS]


def forest(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what ``near`` (a by b) connects, fewer than rows and columns together."""
    left = near.any(axis=1)
    while left.any():
        rows = np.zeros(len(a), bool)
        rows[left.argmax()] = True
        cols = np.zeros(len(b), bool)
        while True:
            grown = near[rows].any(axis=0)
            more = near[:, grown].any(axis=1)
            if (more == rows).all() and (grown == cols).all():
                break
            rows, cols = more | rows, grown
        left &= ~rows
        first = a[rows][0]
        others = np.concatenate((a[rows][1:], b[cols]))
        yield np.full(len(others), first), others


def compared(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        us, vs = [], []
        side = {k: (batch.column(k).offsets.to_numpy(), batch.column(k).values.to_numpy(zero_copy_only=False).view(np.uint64)) for k in ("a", "b")}
        for k, same in enumerate(batch.column("same").to_pylist()):
            a, b = (values[at[k] : at[k + 1]] for at, values in side.values())
            near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
            if same:
                np.fill_diagonal(near, False)
            if not (n := np.count_nonzero(near)):
                continue
            if n > len(a) + len(b):
                for u, v in forest(near, a, b):
                    us.append(u)
                    vs.append(v)
            else:
                i, j = np.nonzero(near)
                us.append(a[i])
                vs.append(b[j])
        if us:
            both = np.unique(np.stack((np.concatenate(us), np.concatenate(vs)), axis=1), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])


def near_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) that connect all of ``distinct`` (fp) that lie within the radius of each other."""
    side = PART_BITS + 1
    parts = distinct.select("fp", F.array(*part_counts()).alias("p"))
    number = lambda p: sum(p[k] * side ** (PARTS - 1 - k) for k in range(PARTS))
    grouped = parts.select("fp", "p", number(F.col("p")).cast("int").alias("g"))
    #: At most 17 ** 4 = 83,521 rows of two numbers: below 2 MB for any input.
    sizes = written(grouped.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("cuts")), "tile-sizes")
    dealt = grouped.join(F.broadcast(sizes), "g").withColumn("s", F.expr("pmod(xxhash64(fp), cuts)"))
    tiles = written(dealt.groupBy("g", "s").agg(F.first("p").alias("p"), F.collect_list("fp").alias("fps")), "tiles")
    near = F.explode(F.array(*[F.array(*[F.lit(d) for d in x]) for x in offsets(radius)])).alias("d")
    shifted = tiles.select("g", "s", F.col("fps").alias("a"), "p", near).withColumn("q", F.expr("zip_with(p, d, (x, y) -> x + y)"))
    inside = shifted.filter(f"forall(q, x -> x BETWEEN 0 AND {PART_BITS})").select("g", "s", "a", number(F.col("q")).cast("int").alias("h"))
    # Each pair of tiles is a key of its own, so that the many tiles of one group don't meet in one task.
    there = F.broadcast(sizes.select(F.col("g").alias("h"), "cuts"))
    other = tiles.select(F.col("g").alias("h"), F.col("s").alias("t"), F.col("fps").alias("b"))
    each = F.explode(F.expr("sequence(0L, cast(cuts AS LONG) - 1)")).alias("t")
    pairs = inside.join(there, "h").select("g", "s", "a", "h", each).filter("g <> h OR s <= t").join(other, ["h", "t"])
    return pairs.select("a", "b", F.expr("g = h AND s = t").alias("same")).mapInArrow(trimmed(lambda batches: compared(batches, radius)), "u long, v long")


def near_components(prints: DataFrame, radius: int) -> DataFrame:
    """``prints`` (doc_id, fp) with component_id, the smallest doc_id reachable over links within the radius."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-prints")
    roots = components(near_links(distinct, radius)).withColumnRenamed("node", "fp")
    member = distinct.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    class_of = written(member.join(named, "root").select("fp", "component_id"), "print-classes")
    return prints.join(class_of, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    prints = written(fingerprints(docs, words, id_col, text_col), "prints")
    return near_components(prints, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- dropping near copies -----------------------------------------------------------------------------

#: Orders of all shingles, by mixed hashes. Texts meet in a block for each order under which they have the same smallest shingle.
#: A text that has at most SPARE blocks of more than HOT texts is left out of those. So two texts may fail to meet only if their
#: smallest shingles differ under ORDERS - SPARE orders or more; at Jaccard 0.8 that is so for fewer than 1 of 1,000,000,000 pairs.
ORDERS, SPARE, HOT = 20, 3, 1024
#: Rounds in turn: each text with the nearest center of its blocks, each with the nearest text of its blocks, all that are left.
ROUNDS = ["center", "nearest", "nearest", "all"]
#: Bits by which the four prints of a text and of a center may differ.
NEAR = 48
#: Bits by which the first two of the four prints, and all four, may differ in the other rounds. At Jaccard 0.8 more differ in fewer than 1 of 10,000,000 pairs.
WIDE_TWO, WIDE = 49, 84
#: Texts of a block that are dealt to one key, texts to a tile, and pairs of its rows that are taken at once.
PIECE, WIDE_TILE, MET = 512, 4096, 1 << 17
#: Longs of the filter that picks texts, at least and at most; 8 MB.
CELLS, MOST_CELLS = 1 << 16, 1 << 20
#: Bits of the parity bitmap of a shingle set, as a power of two: at least these, else twice the size of the set or more, so that those of long
#: texts tell them apart too. Each shingle that only one of two sets has changes one bit, so bitmaps rule pairs out without loss.
PARITY_BITS = 8
#: Pairs whose bitmaps are compared at once.
CHECKED = 1 << 14
#: Longs of bitmaps taken together at once.
GATHERED = 1 << 18


def parities(each: np.ndarray) -> bytes:
    """Whether an odd number of the hashes ends with each of the values of their last bits."""
    cells = 1 << max(PARITY_BITS, (2 * len(each) - 1).bit_length())
    return np.packbits((np.bincount((each & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)).tobytes()


def folded(bitmaps: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray, longs: int) -> np.ndarray:
    """The bitmaps of ``rows``, which have one length, as ``longs`` numbers each: parities of fewer last bits are sums of those of more."""
    flat, starts, sizes = bitmaps
    size = int(sizes[rows[0]])
    return np.bitwise_xor.reduce(flat[starts[rows][:, None] + np.arange(size)].reshape(len(rows), size // longs, longs), axis=1)


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def remixed(each: np.ndarray, k: int) -> np.ndarray:
    """Other hashes for the same shingles: the mixing steps of SplitMix64 from the k-th place."""
    return mixed(each + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


#: Places of SplitMix64 beyond those of the prints, and hashes that are mixed for all orders at once.
PLACES, MIXED = np.arange(4, 4 + ORDERS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15), 512


def smallest(each: np.ndarray) -> list[int]:
    """The smallest hash under each of the ORDERS, as signed numbers; sets of none have the same ones."""
    if not len(each):
        return list(range(ORDERS))
    parts = [mixed(each[at : at + MIXED] + PLACES).min(axis=1) for at in range(0, len(each), MIXED)]
    return np.min(parts, axis=0).view(np.int64).tolist()


def four_prints(text: bytes | None, words: int) -> tuple[int, int, int, int, int, bytes, list[int]]:
    """Four fingerprints of the set of shingles, its size, its parity bitmap and its smallest hashes."""
    each = np.unique(shingle_hashes(text, words))
    return majority(each), *(majority(remixed(each, k)) for k in (1, 2, 3)), len(each), parities(each), smallest(each)


def set_prints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, fp, second, third, fourth, n, parity, least) by ``four_prints``; ``node`` is a hash of the text."""
    text = F.coalesce(docs[text_col], F.lit(""))
    narrow = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("node"), text.cast("binary").alias("text"))
    types = {"fp": pa.int64(), "second": pa.int64(), "third": pa.int64(), "fourth": pa.int64(), "n": pa.int64(), "parity": pa.binary(), "least": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [four_prints(t.as_py(), words) for t in batch.column(2)]
            found = zip(*rows, strict=True) if rows else ((),) * len(types)
            arrays = [pa.array(x, t) for x, t in zip(found, types.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["doc_id", "node", *types])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(trimmed(run), f"doc_id {kind}, node long, fp long, second long, third long, fourth long, n long, parity binary, least array<long>")


def sized(keys: DataFrame) -> DataFrame:
    """``keys`` (node, key) that two or more have, with their number as ``size``."""
    return keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "key")


def blocks(nodes: DataFrame) -> DataFrame:
    """(key, node, size, cuts, s), a written table: the texts of each block that has two or more, in pieces ``s`` of large ones."""
    every = written(sized(nodes.select("node", F.explode(F.array_distinct("least")).alias("key"))), "near-keys")
    hot = every.filter(F.col("size") > HOT).select("node", "key")
    spared = hot.groupBy("node").agg(F.count(F.lit(1)).alias("hot")).filter(F.col("hot") <= SPARE)
    found = every.filter(F.col("size") <= HOT).unionByName(sized(hot.join(spared, "node", "left_anti")))
    found = written(found.withColumn("cuts", F.expr(f"ceil(size / {PIECE})")).withColumn("s", F.expr("pmod(xxhash64(node), cuts)")), "near-blocks")
    dropped(every)
    return found


def values(column: pa.Array) -> np.ndarray | tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers; of bitmaps all longs, and where each begins and how many it has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    if pa.types.is_binary(column.type):
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 8
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64), np.cumsum(sizes) - sizes, sizes
    return column.to_numpy(zero_copy_only=False)


def together(x: np.ndarray, y: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All places (i, j) of equal numbers in ``x`` and ``y``, both sorted, about MET at once; with ``same``, where ``y`` is ``x``, those of i < j."""
    first = np.arange(1, len(x) + 1) if same else np.searchsorted(y, x, "left")
    times = np.searchsorted(y, x, "right") - first
    ends, at = np.cumsum(times), 0
    while at < len(x):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + MET, "right")))
        n = times[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        yield i, np.arange(done, ends[stop - 1]) - np.repeat(ends[at:stop] - n - first[at:stop], n)
        at = stop


def met(batches: Iterator[pa.RecordBatch], nearest: bool, similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v, far) of nodes that meet in a block under different labels and may be similar, of tiles ``a`` and ``b`` (null: ``a`` itself).

    With ``nearest`` only the nearest u of each v of the two tiles.
    """
    for batch in batches:
        for k in range(len(batch)):
            same = not batch.column("b")[k].is_valid
            a = tile_of(batch.column("a")[k].values)
            b = a if same else tile_of(batch.column("b")[k].values)
            found = np.zeros((0, 3), np.int64)
            for i, j in together(a["key"], b["key"], same):
                ok = a["label"][i] != b["label"][j]
                i, j = i[ok], j[ok]
                ok = np.minimum(a["n"][i], b["n"][j]) >= similarity * np.maximum(a["n"][i], b["n"][j])
                i, j = i[ok], j[ok]
                ok = distance(a["fp"][i], b["fp"][j]) + distance(a["second"][i], b["second"][j]) <= WIDE_TWO
                i, j = i[ok], j[ok]
                ok = np.concatenate([np.zeros(0, bool), *(possible(a, b, i[at : at + CHECKED], j[at : at + CHECKED], similarity) for at in range(0, len(i), CHECKED))])
                if not ok.any():
                    continue
                i, j = i[ok], j[ok]
                u, v = a["node"][i], b["node"][j]
                far = sum(distance(a[f][i], b[f][j]).astype(np.int64) for f in PRINTS)
                if nearest:
                    found = np.concatenate((found, np.stack((u, v, far), axis=1), np.stack((v, u, far), axis=1)))
                    found = found[np.lexsort((found[:, 0], found[:, 2], found[:, 1]))]
                    found = found[np.concatenate(([True], found[1:, 1] != found[:-1, 1]))]
                else:
                    found = np.unique(np.concatenate((found, np.stack((np.minimum(u, v), np.maximum(u, v), far), axis=1))), axis=0)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.T], names=["u", "v", "far"])


def tile_of(rows: pa.StructArray) -> dict[str, np.ndarray]:
    """The columns of ``rows``, sorted by key."""
    table = pa.RecordBatch.from_struct_array(rows)
    table = table.take(pc.sort_indices(table.column("key")))
    return {f: values(table.column(f)) for f in table.schema.names}


def possible(a: dict[str, np.ndarray], b: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether all four prints of rows ``i`` of ``a`` and ``j`` of ``b`` are near and their bitmaps leave room for the similarity."""
    ok = sum(distance(a[f][i], b[f][j]).astype(np.int64) for f in ("fp", "second", "third", "fourth")) <= WIDE
    i, j = i[ok], j[ok]
    sizes, unshared = np.stack((a["parity"][2][i], b["parity"][2][j])), np.zeros(len(i), np.int64)
    for x, y in np.unique(sizes, axis=1).T if len(i) else ():
        alike = np.flatnonzero((sizes[0] == x) & (sizes[1] == y))
        step = max(1, GATHERED // int(max(x, y)))
        for k in range(0, len(alike), step):
            here = alike[k : k + step]
            bits = folded(a["parity"], i[here], min(x, y)) ^ folded(b["parity"], j[here], min(x, y))
            unshared[here] = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    ok[ok] = unshared * (1 + similarity) <= (a["n"][i] + b["n"][j]) * (1 - similarity) + 1e-6
    return ok


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of signed numbers."""
    return np.bitwise_count((x ^ y).view(np.uint64))


PRINTS = ["fp", "second", "third", "fourth"]


def starred(rows: DataFrame, k: int, similarity: float) -> DataFrame:
    """Pairs (u, v): each text and the nearest of the centers of its blocks that have another label, if the four prints are near.

    ``rows`` is ``blocks`` with prints and label. A center is any text of its block, another one each round ``k``. So a block costs
    as much as it has texts, and a large group of copies is not expanded into pairs.
    """
    center = F.min_by(F.struct("node", "n", "label", *PRINTS), F.xxhash64("node", F.lit(k))).alias("c")
    centers = rows.groupBy("key", "cuts").agg(center, F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    dealt = centers.select("key", "c", F.explode(F.expr("sequence(0L, cuts - 1)")).alias("s"))
    far = sum(F.bit_count(F.col(f).bitwiseXOR(F.col(f"c.{f}"))) for f in PRINTS)
    alike = F.least("n", "c.n") >= F.lit(similarity) * F.greatest("n", "c.n")
    found = rows.join(dealt, ["key", "s"]).filter(F.col("label") != F.col("c.label")).filter(alike).select("node", F.col("c.node").alias("u"), far.alias("far"))
    near = found.filter(F.col("far") <= NEAR).groupBy("node").agg(F.min_by("u", F.struct("far", "u")).alias("u"))
    return near.select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")).distinct()


def unconnected(rows: DataFrame, labelled: DataFrame, nearest: bool, similarity: float) -> DataFrame:
    """All pairs (u, v) that meet in a block of ``rows`` (key, node, size) under different labels and that prints and bitmaps leave,
    a written table; with ``nearest`` each text and the nearest one only.

    Small blocks share a tile, large ones are cut into tiles of their own, each two of which are compared by a task.
    """
    own = rows.join(labelled.select("node", "label"), "node").select("key", "node", "size", "label")
    live = own.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    left = written(own.drop("label").join(live, "key", "left_semi"), "near-left")
    n, most = left.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0))).first()
    tiles, large = -(-n // WIDE_TILE) + 1, F.col("size") > WIDE_TILE
    cuts = F.when(large, F.expr(f"ceil(size / {WIDE_TILE})")).otherwise(F.lit(1))
    dealt = left.withColumns({"large": large, "cuts": cuts, "g": F.when(large, F.col("key")).otherwise(F.expr(f"pmod(xxhash64(key), {tiles}L)"))})
    dealt = dealt.withColumn("s", F.expr("pmod(xxhash64(node), cuts)")).join(labelled, "node")
    # Tiles of short texts have few bytes, but as many pairs.
    dealt = dealt.repartition(max(4 * rows.sparkSession.sparkContext.defaultParallelism, tiles // 8), "g", "s")
    fields = F.struct("key", "node", "label", "n", *PRINTS, "parity")
    held = dealt.groupBy("large", "g", "cuts", "s").agg(F.collect_list(fields).alias("a"))
    none = F.lit(None).cast(held.schema["a"].dataType).alias("b")
    pairs = held.select("a", none)
    if most > WIDE_TILE:
        held = written(held.filter("large"), "near-tiles")
        pairs = dealt.filter("NOT large").groupBy("g", "s").agg(F.collect_list(fields).alias("a")).select("a", none)
        # Each pair of tiles is a key of its own, so that the tiles of one block don't meet in one task.
        each = held.select("g", "s", "a", F.explode(F.expr("sequence(s, cuts - 1)")).alias("t"))
        other = held.select("g", F.col("s").alias("t"), F.col("a").alias("b"))
        pairs = pairs.unionByName(each.join(other, ["g", "t"]).select("a", F.when(F.col("s") != F.col("t"), F.col("b")).alias("b")))
    found = pairs.mapInArrow(trimmed(lambda batches: met(batches, nearest, similarity)), "u long, v long, far long")
    if nearest:
        found = found.groupBy("v").agg(F.min_by("u", F.struct("far", "u")).alias("u"))
    found = written(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near-pairs")
    dropped(left, *([held] if most > WIDE_TILE else []))
    return found


def among(nodes: DataFrame, node: Column) -> Column:
    """Whether ``node`` is one of ``nodes`` (node), or, as a bitmap of at most MOST_CELLS longs decides, by chance."""
    cells = CELLS
    while cells < min(MOST_CELLS, nodes.count() // 4):
        cells *= 2
    cell = nodes.select(F.expr(f"shiftrightunsigned(node, 6) & {cells - 1}").alias("cell"), F.expr("shiftleft(1L, cast(node & 63 AS INT))").alias("bit"))
    every = nodes.sparkSession.range(0, cells, 1, 4).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("bit"))
    bits = every.unionByName(cell).groupBy("cell").agg(F.bit_or("bit").alias("bits")).agg(F.expr("transform(array_sort(collect_list(struct(cell, bits))), x -> x.bits)").alias("bitmap"))
    at = F.shiftrightunsigned(node, 6).bitwiseAND(F.lit(cells - 1).cast("long")).cast("int")
    return F.getbit(F.get(bits.scalar(), at), node.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1


def similar(pairs: DataFrame, places: DataFrame, docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Those ``pairs`` (u, v), a written table, whose texts have the Jaccard similarity, as one; only texts that occur in pairs are read again."""
    needed = written(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "near-needed")
    text = F.coalesce(docs[text_col], F.lit(""))
    own = docs.select(F.xxhash64(text).alias("node"), docs[id_col].alias("doc_id"), text.alias("text"))
    own = own.filter(among(needed, F.col("node")))
    first = places.join(needed, "node", "left_semi").select(F.col("node").alias("of"), "first_id")
    own = own.join(first, (own.node == first.of) & own.doc_id.eqNullSafe(first.first_id)).select("node", "text").dropDuplicates(["node"])
    hashed = own.select("node", F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), F.lit(0)).alias("w")).select("node", "w", F.expr("transform(w, x -> xxhash64(x))").alias("wh"))
    gram = ", ".join(f"get(wh, i + {k})" for k in range(words))
    sets = written(hashed.select("node", F.expr(f"CASE WHEN size(w) > {words} THEN array_distinct(transform(sequence(0, size(w) - {words}), i -> xxhash64({gram}))) ELSE array(xxhash64(wh)) END").alias("set")), "near-sets")
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("su")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("sv")), "v")
    shared = F.size(F.array_intersect("su", "sv"))
    found = written(both.filter(shared >= F.lit(similarity) * (F.size("su") + F.size("sv") - shared)).select("u", "v"), "near-links")
    dropped(needed, sets)
    return found


def without_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each group of near copies, that with the smallest id, with all columns.

    Texts link if their sets of word shingles have the Jaccard similarity. Only texts that meet in a block are compared,
    so that work grows with the texts and the sizes of blocks, not with all pairs. At first each text is compared with the
    nearest of the centers of its blocks, then in a few rounds with the nearest text that it isn't connected to yet, so that
    a group of copies is not expanded into all pairs. After them, all pairs of blocks that are still unconnected and within
    WIDE bits of the four prints are compared, unless their bitmaps prove that they are not similar.
    """
    prints = written(set_prints(docs, words, id_col, text_col), "prints")
    firsts = [F.first(c).alias(c) for c in (*PRINTS, "n", "parity", "least")]
    nodes = written(prints.groupBy("node").agg(F.min("doc_id").alias("first_id"), *firsts), "print-nodes")
    places = nodes.select("node", "first_id")
    rows = blocks(nodes)
    links, label, stuck = None, nodes.select("node", F.col("node").alias("root")), False
    for k, step in enumerate(ROUNDS):
        if step == "nearest" and stuck:
            continue
        labelled = nodes.join(label, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root", "first_id", "least")
        if step == "center":
            used = written(rows.join(labelled.drop("parity"), "node"), "near-labelled")
            pairs = written(starred(used, k, similarity), "near-pairs")
            dropped(used)
        else:
            pairs = unconnected(rows, labelled, step == "nearest", similarity)
            if pairs.isEmpty():  # then nothing is left for later rounds
                dropped(pairs)
                break
        more = similar(pairs, places, docs, words, similarity, id_col, text_col)
        dropped(pairs)
        stuck = step == "nearest" and more.isEmpty()
        tidy(docs.sparkSession)
        links = more if links is None else links.unionByName(more)
        label = written(components(links), "near-labels")
    dropped(rows)
    roots = label
    member = nodes.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    kept = member.groupBy("root").agg(F.min_by(F.struct("node", "first_id"), F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("k")).select("k.*")
    kept = kept.withColumnRenamed("first_id", "kept_id").withColumnRenamed("node", "kept_node")
    rows = prints.select("doc_id", "node").groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("times"))
    judged = rows.join(kept, (rows.node == kept.kept_node) & rows.doc_id.eqNullSafe(kept.kept_id), "left")
    odd = written(judged.filter("kept_node IS NULL OR times > 1").select(F.col("doc_id").alias("odd_id"), F.col("node").alias("odd_node"), F.col("kept_node").isNotNull().alias("repeated")), "near-odd")
    node = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    is_odd = docs[id_col].eqNullSafe(odd.odd_id) & (node == odd.odd_node)
    # Most texts are not odd and needn't be shuffled to find that out.
    maybe = among(odd.select(F.col("odd_node").alias("node")), node)
    some = docs.filter(maybe)
    out = docs.filter(~maybe).union(some.join(odd, is_odd, "left_anti"))
    repeated = odd.filter("repeated")
    if repeated.isEmpty():
        return out
    again = some.join(repeated, docs[id_col].eqNullSafe(repeated.odd_id) & (node == repeated.odd_node)).dropDuplicates(["odd_id", "odd_node"])
    return out.unionByName(again.select(*[docs[c] for c in docs.columns]))
