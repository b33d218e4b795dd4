"""Exact top-k search by inner product: branch and bound over vectors in vertical layout.

Vectors become tiles, dimension by dimension, longest vectors first. A task takes one
tile of queries through all tiles of candidates: it adds up inner products one block of
dimensions after another and drops each candidate whose score so far, plus the product
of the lengths that remain, stays below the k-th score found yet. Tiles are files in
the shared folder, so neither side is broadcast or shuffled for each other, and what a
task holds does not grow with the table. A file of vectors too short for any query of
the tile ends the search, as all later ones are shorter still.

Vectors that are null, or hold null or components that aren't finite, take no part. Of
vectors of different lengths the shorter counts as padded with zeros; empty ones score
0. Candidates with the query's id are its own rows and are left out. Null ids are never
queries; as candidates they come after all others of their score. Each repeated query
row brings its result again, repeated candidates are ranked one by one. Scores are
exact; beyond the range of a long they count as its ends. An empty table gives no rows.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, file_system, scratch_path, written

#: Vectors to a tile of candidates and of queries, dimensions to a block, and bytes of a row group of tiles.
TILE, QUERIES, BLOCK, GROUP = 4096, 256, 16, 4 << 20
#: Below this share of candidates that are still open, they are followed one by one instead of as a matrix.
SPARSE = 1 / 16
#: Widens the bound by more than rounding can take from it.
SLACK = 1 + 1e-5
TILE_ROW = "norm double, n long, width long, kind string, ids binary, unnamed binary, cells binary"
FOUND = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
LONG = (-(1 << 63), (1 << 63) - 1)


class Tile:
    """Vectors by dimension: ``cells`` is (width, n); ids of null are flagged in ``unnamed``."""

    def __init__(self, ids: np.ndarray, unnamed: np.ndarray, cells: np.ndarray):
        self.ids, self.unnamed, self.cells = ids, unnamed, cells
        self.norm = float(np.sqrt(np.max(np.einsum("dn,dn->n", cells, cells, dtype=np.float64), initial=0)))

    def row(self) -> dict:
        most = np.max(np.abs(self.cells), initial=0)
        kind = next((k for k in ("int8", "int16", "int32") if most <= np.iinfo(k).max), "float64")
        return {"norm": self.norm, "n": len(self.ids), "width": len(self.cells), "kind": kind, "ids": self.ids.tobytes(), "unnamed": self.unnamed.tobytes(), "cells": self.cells.astype(kind).tobytes()}

    @classmethod
    def read(cls, row: dict) -> Tile:
        cells = np.frombuffer(row["cells"], row["kind"]).reshape(row["width"], row["n"]).astype(np.float64)
        return cls(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["unnamed"], np.bool_), cells)


def tile_of(vectors: pa.ListArray, ids: pa.Array, scale: float) -> Tile:
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    cells = np.zeros((int(sizes.max(initial=0)), len(sizes)))
    of = np.repeat(np.arange(len(sizes)), sizes)
    cells[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), of] = flat
    return Tile(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False), cells)


def tiles(vectors: DataFrame, size: int, scale: float) -> DataFrame:
    """TILE_ROW for each ``size`` rows of (id, v) that follow each other in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = size - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == size:
                    yield packed(held, scale)
                    held = []
        if held:
            yield packed(held, scale)

    return vectors.mapInArrow(run, TILE_ROW)


def packed(held: list[pa.RecordBatch], scale: float) -> pa.RecordBatch:
    both = pa.Table.from_batches(held).combine_chunks()
    ids, v = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in (both["id"], both["v"]))
    return pa.RecordBatch.from_pylist([tile_of(v, ids, scale).row()])


def files_of(path: str) -> tuple[object, list[str]]:
    """The table's files in the order of its partitions."""
    from pyarrow import fs

    disk, local = file_system(path)
    return disk, sorted(f.path for f in disk.get_file_info(fs.FileSelector(local)) if f.base_name.startswith("part-"))


class Best:
    """The ``k`` best candidates yet of each query of a tile."""

    def __init__(self, queries: Tile, k: int):
        self.queries, self.k = queries, k
        self.row, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.unnamed = np.zeros(0, bool)
        #: The score that a candidate needs to be among them.
        self.floor = np.full(len(queries.ids), -np.inf)

    def add(self, i: np.ndarray, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        row, score = np.concatenate((self.row, i)), np.concatenate((self.score, scores))
        ids, unnamed = np.concatenate((self.ids, ids)), np.concatenate((self.unnamed, unnamed))
        order = np.lexsort((ids, unnamed, ~score, row))  # ~score falls as the score rises, and can't overflow
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        order, last = order[rank < self.k], rank == self.k - 1
        self.floor[row[last]] = score[np.lexsort((ids, unnamed, ~score, np.concatenate((self.row, i))))][last]
        self.row, self.score, self.ids, self.unnamed = row[rank < self.k], score[order], ids[order], unnamed[order]

    def result(self) -> pa.RecordBatch:
        rank = np.arange(len(self.row)) - np.searchsorted(self.row, self.row) + 1
        found = pa.array(self.ids, mask=self.unnamed)
        return pa.RecordBatch.from_arrays([pa.array(self.queries.ids[self.row]), pa.array(rank.astype(np.int32)), found, pa.array(self.score)], schema=FOUND)


def lengths_left(cells: np.ndarray, blocks: list[slice]) -> list[np.ndarray]:
    """For each block, the lengths of the vectors in the blocks after it."""
    own = [np.einsum("dn,dn->n", cells[b], cells[b]) for b in blocks]
    return [np.sqrt(sum(own[k + 1 :], np.zeros(cells.shape[1]))) * SLACK for k in range(len(blocks))]


def offer(best: Best, c: Tile) -> None:
    """Adds those candidates of ``c`` that belong among the best."""
    q, width = best.queries, min(len(best.queries.cells), len(c.cells))
    if q.norm * c.norm >= 1 << 53:
        return offer_whole(best, c, width)
    exact = np.float32 if q.norm * c.norm < 1 << 24 else np.float64
    a, b = q.cells[:width], c.cells[:width]
    blocks = sorted((slice(k, min(k + BLOCK, width)) for k in range(0, width, BLOCK)), key=lambda s: -float(np.square(a[s]).sum())) or [slice(0, 0)]
    left_a, left_b = lengths_left(a, blocks), lengths_left(b, blocks)
    a, b = a.astype(exact), b.astype(exact)
    open_, floor = np.arange(len(c.ids)), best.floor
    score = np.zeros((len(q.ids), len(open_)), exact)
    pairs = None
    for k, block in enumerate(blocks):
        if pairs is None:
            score += a[block].T @ b[block][:, open_]
            if k == len(blocks) - 1:
                break
            may = score + left_a[k].astype(np.float32)[:, None] * left_b[k][open_].astype(np.float32) >= floor[:, None] - 1
            share = np.count_nonzero(may) / max(may.size, 1)
            if share < SPARSE:
                i, j = np.nonzero(may)
                pairs = i, open_[j], score[i, j]
            elif (keep := may.any(axis=0)).mean() < 0.75:
                open_, score = open_[keep], score[:, keep]
        else:
            i, j, s = pairs
            s = s + np.einsum("dn,dn->n", a[block][:, i], b[block][:, j])
            may = s + left_a[k][i] * left_b[k][j] >= floor[i] - 1
            pairs = i[may], j[may], s[may]
    if pairs is None:
        pairs = above(best, score, c, open_)
    i, j, s = pairs
    own = (c.ids[j] == q.ids[i]) & ~c.unnamed[j]
    good = ~own & (s >= floor[i])
    if good.any():
        best.add(i[good], s[good].astype(np.int64), c.ids[j[good]], c.unnamed[j[good]])


def above(best: Best, score: np.ndarray, c: Tile, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a whole matrix that reach both the k-th score yet and the k-th of the matrix."""
    least = best.floor
    if score.shape[1] > best.k:
        others = np.where((c.ids[open_] == best.queries.ids[:, None]) & ~c.unnamed[open_], -np.inf, score)
        least = np.maximum(least, np.partition(others, -best.k, axis=1)[:, -best.k])
    i, j = np.nonzero(score >= least[:, None])
    return i, open_[j], score[i, j]


def offer_whole(best: Best, c: Tile, width: int) -> None:
    """For components so large that doubles would round: Python's whole numbers, all pairs of the tile."""
    whole = lambda cells: np.array([[int(x) for x in row] for row in cells[:width]], object).reshape(width, cells.shape[1])
    a, b = whole(best.queries.cells), whole(c.cells)
    for i in range(len(best.queries.ids)):
        score = np.array([min(max(int(s), LONG[0]), LONG[1]) for s in a[:, i] @ b], np.int64) if width else np.zeros(len(c.ids), np.int64)
        other = (c.ids != best.queries.ids[i]) | c.unnamed
        best.add(np.full(np.count_nonzero(other), i), score[other], c.ids[other], c.unnamed[other])


def searched(queries: Tile, path: str, k: int) -> pa.RecordBatch:
    """The best of all candidates, whose tiles lie in ``path``, longest vectors first."""
    best = Best(queries, k)
    disk, files = files_of(path)
    for name in files:
        with disk.open_input_file(name) as source:
            found = pq.ParquetFile(source)
            norms = found.read(columns=["norm"])["norm"].to_numpy()
            if len(norms) and (queries.norm * norms.max() * SLACK + 1 < best.floor).all():
                break
            for batch in found.iter_batches(batch_size=1):
                tile = Tile.read(batch.to_pylist()[0])
                if not (queries.norm * tile.norm * SLACK + 1 < best.floor).all():
                    offer(best, tile)
    return best.result()


def top_scores(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` holds for, the ``k`` other rows of largest inner product of floor(scale * x)."""
    v = vectors[vector_col].cast("array<double>")
    finite = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    narrow = vectors.select(vectors[id_col].cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(F.coalesce(finite, F.lit(False)))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    ordered = narrow.withColumn("norm", norm).repartitionByRange(F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")
    path = scratch_path(vectors.sparkSession, "vector-tiles")
    tiles(ordered.select("id", "v"), TILE, scale).write.option("parquet.block.size", GROUP).parquet(path)
    asked = written(tiles(narrow.filter("asks AND id IS NOT NULL").select("id", "v"), QUERIES, scale), "query-tiles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield searched(Tile.read(row), path, k)

    n = asked.count()  # each tile of queries is a task of its own
    found = written(asked.repartition(max(n, 1)).mapInArrow(run, "query_id long, rank int, vec_id long, score long"), "top-scores")
    dropped(asked)
    return found
