"""Quality rules and an isolation forest on their statistics.

Per text: words, code points in words, symbols, repeated lines and words in
repeated three-word windows. Two base rules reject texts that are too short or
repeat themselves too much. For the texts that pass, an isolation forest judges the
ratios of these statistics: trees of random splits, in which an unusual text is set
apart after few of them. The score 2 ** (-mean path / expected path) is compared
with a threshold calibrated on all labelled rows.

Ratios are taken from their median among good texts, in units of what 99 % of those
stay within, and drawn together logarithmically, so that no ratio is cut off. Trees
hold good texts; their splits are drawn from the whole range that the ratios have
among all passing rows, so that what lies beyond the good texts is split off
however rare it is and whichever ratio it shows in.

The trees grow on a bounded sample of labelled rows (the first ``SAMPLE`` good ones
in hash order, ``TREE_ROWS`` for each tree); statistics, ranges, calibration and
verdicts cover all rows. The threshold is the one with the largest difference
between the share of bad rows rejected and ``GOOD_WEIGHT`` times the share of good
ones. Defined results: null text has no words and fails; without labelled rows
of both kinds the threshold is 1 and only the base rules reject; an empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import trimmed, written

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS, SPACES = [bytes([c]) for c in b"#*$%&|<>"], [bytes([c]) for c in b" \t\n\r\x0b\x0c"]
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 3, 50, 50
RATIOS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SAMPLE, TREES, TREE_ROWS, SEED = 25_600, 100, 256, 17
#: The smallest unit of a ratio; a rejected good row costs so many times a kept bad one; bins of the calibration.
LEAST_UNIT, GOOD_WEIGHT, BINS = 0.01, 10, 10_000


def repeated_words(words: list[bytes]) -> int:
    """Words within three-word windows that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, WINDOW):
        key = np.unique(key * len(number) + ids[k : n + k], return_inverse=True)[1]
    again = np.bincount(key)[key] > 1
    covered = np.zeros(len(words), bool)
    for k in range(WINDOW):
        covered[k : n + k] |= again
    return int(covered.sum())


def statistics(text: bytes | None) -> tuple[int, int, int, int, int]:
    """The values of STATS for one UTF-8 text."""
    text = text or b""
    words = text.split()
    points = int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        points - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MAX_REPEAT_PERCENT * stats[:, 0])


def ratios(stats: np.ndarray) -> np.ndarray:
    """RATIOS by word."""
    return stats[:, 1:] / np.maximum(stats[:, :1], 1).astype(float)


@dataclass
class Scale:
    """Where good texts' ratios lie."""

    middle: np.ndarray
    unit: np.ndarray

    @classmethod
    def of(cls, good: np.ndarray) -> Scale:
        middle = np.median(good, axis=0)
        return cls(middle, np.maximum(np.percentile(np.abs(good - middle), 99, axis=0), LEAST_UNIT))

    def points(self, found: np.ndarray) -> np.ndarray:
        far = (found - self.middle) / self.unit
        return np.sign(far) * np.log1p(np.abs(far))


@dataclass
class Forest:
    """Trees as arrays: at each node a feature, a split and the left child (the right one follows); leaves lead to themselves."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    path: np.ndarray
    usual: float
    depth: int

    @staticmethod
    def expected(n: int) -> float:
        """Mean path length of an unsuccessful search among n points."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    @classmethod
    def grown(cls, points: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
        """Trees over ``points``, with splits between ``low`` and ``high``."""
        random, rows = np.random.default_rng(seed), min(rows, len(points))
        depth = int(np.ceil(np.log2(max(rows, 2))))
        built = [cls.tree(points[random.choice(len(points), rows, replace=False)], low, high, depth, random) for _ in range(trees)]
        width = max(map(len, built))
        blank = [0, 0.0, -1, 0.0]
        cells = np.array([[*t, *[blank] * (width - len(t))] for t in built])
        return cls(cells[:, :, 0].astype(int), cells[:, :, 1], cells[:, :, 2].astype(int), cells[:, :, 3], max(cls.expected(rows), 1.0), depth)

    @classmethod
    def tree(cls, points: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, random: np.random.Generator) -> list[list[float]]:
        """Each node splits its cell of the range, whether the points in it vary or not."""
        nodes: list[list[float]] = [[]]
        work = [(0, points, low, high, 0)]
        while work:
            at, mine, a, b, level = work.pop()
            wide = np.flatnonzero(b > a)
            if level == depth or len(mine) < 2 or not len(wide):
                nodes[at] = [0, np.inf, at, level + cls.expected(len(mine))]
                continue
            f = int(random.choice(wide))
            cut = random.uniform(a[f], b[f])
            goes = mine[:, f] < cut
            nodes[at] = [f, cut, len(nodes), 0.0]
            right, left = a.copy(), b.copy()
            right[f] = left[f] = cut
            work += [(len(nodes), mine[goes], a, left, level + 1), (len(nodes) + 1, mine[~goes], right, b, level + 1)]
            nodes += [[], []]
        return nodes

    def score(self, points: np.ndarray) -> np.ndarray:
        """In (0, 1]; higher is stranger."""
        total = np.zeros(len(points))
        every = np.arange(len(points))
        for feature, split, left, path in zip(self.feature, self.split, self.left, self.path, strict=True):
            at = np.zeros(len(points), int)
            for _ in range(self.depth):
                at = left[at] + (points[every, feature[at]] >= split[at])
            total += path[at]
        return 2 ** (-total / len(self.left) / self.usual)


@dataclass
class Model:
    scale: Scale | None = None
    forest: Forest | None = None
    threshold: float = 1.0

    def judged(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """base_failed, score, kept."""
        failed = base_failed(stats)
        score = self.forest.score(self.scale.points(ratios(stats))) if self.forest and len(stats) else np.zeros(len(stats))
        return failed, score, ~failed & (score <= self.threshold)


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATS for every row."""
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = stats_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.T.copy())], names=["doc_id", *STATS])

    return narrow.mapInArrow(trimmed(run), f"doc_id {kind}, " + ", ".join(f"{s} long" for s in STATS))


def stats_of(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in texts], np.int64).reshape(-1, len(STATS))


def fitted(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """A forest over the good rows of ``stats`` and the threshold that all rows of ``labels`` (1 good, 0 bad) ask for."""
    passing = stats.filter(f"n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words")
    marks = labels.select(labels[id_col].alias("marked"), labels[label_col].alias("mark")).filter("mark IN (0, 1)").distinct()
    known = written(passing.join(marks, passing.doc_id == marks.marked).select("doc_id", *STATS, F.col("mark").cast("long")), "quality-known")
    sample = known.filter("mark = 1").orderBy(F.xxhash64("doc_id"), *STATS).limit(SAMPLE).select(*STATS).toPandas().to_numpy(np.int64)
    if not len(sample) or known.filter("mark = 0").isEmpty():
        return Model()
    each = [F.col(c) / F.greatest("n_words", F.lit(1)) for c in RATIOS]
    ends = passing.agg(*[f(x) for f in (F.min, F.max) for x in each]).first()
    good = ratios(sample)
    scale = Scale.of(good)
    low, high = (scale.points(np.array([ends[k : k + len(RATIOS)]], float))[0] for k in (0, len(RATIOS)))
    model = Model(scale, Forest.grown(scale.points(good), low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.ceil(model.judged(table)[1] * BINS).astype(np.int64)), batch.columns[-1]], names=["bin", "mark"])

    counted = known.select(*STATS, "mark").mapInArrow(trimmed(run), "bin long, mark long").groupBy("bin", "mark").count().toPandas()  # at most 2 * BINS rows
    good, bad = (np.bincount(counted.bin[counted["mark"] == k].to_numpy(int), counted["count"][counted["mark"] == k].to_numpy(float), BINS + 1) for k in (1, 0))
    model.threshold = calibrated(good, bad)
    return model


def calibrated(good: np.ndarray, bad: np.ndarray) -> float:
    """The threshold of the largest gain, from counts by score; the middle of the first run of equal ones."""
    good_above, bad_above = (x.sum() - np.cumsum(x) for x in (good, bad))
    gain = bad_above / bad.sum() - GOOD_WEIGHT * good_above / good.sum()
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    run = best[best - best[0] == np.arange(len(best))]
    return float((run[0] + run[-1]) / 2 / BINS)


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, STATS, base_failed, score, kept."""
    stats = written(text_stats(docs, id_col, text_col), "text-stats")
    model = fitted(stats, labels)
    kind = stats.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, model.judged(table))], names=["doc_id", *STATS, "base_failed", "score", "kept"])

    return stats.mapInArrow(trimmed(run), f"doc_id {kind}, " + ", ".join(f"{s} long" for s in STATS) + ", base_failed boolean, score double, kept boolean")


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; texts are read twice instead of copied."""
    model = fitted(written(text_stats(docs, id_col, text_col), "text-stats"), labels)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.judged(stats_of(batch.column(place).cast(pa.binary())))[2]))

    return docs.mapInArrow(trimmed(run), docs.schema)
