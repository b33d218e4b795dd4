"""Language-model scores from a weighted backoff automaton over bigrams.

Training counts words and word pairs of all training texts. Words and pairs are
smoothed by absolute discounting: p(w | u) = (c(uw) - D) / c(u) + b(u) p(w), with
p(w) = (c(w) - D') / N and the mass taken from the words as the probability of the
one unknown word. The automaton has a state for each word with pairs and a root
state; arcs carry log p(w | u), a failure arc carries log b(u) to the root, and
the root's arcs carry log p(w). A text is read once from left to right, all texts of
a slice side by side: the state is the last word, or the root if that has no pairs;
each word follows its arc or the failure arc and the root's arc. Contexts are one
word: counts of all triples alone would take more than the input again on disk.

The model is not held in memory: words, states and arcs are arrays sorted by key
in the shared folder. Workers map and search them; where files can't be mapped, they
keep the parts read last, CACHED bytes at most or one part. All pairs have arcs; with a
larger ``min_pair`` rarer ones are left to the failure arcs, whose weights account for them. Words are told
apart by a 64-bit hash. Everything gathered grows with the input; what comes to
the driver is one row of totals and the list of files.

Defined results: null and empty texts are one end token; null ids train; with no
training text, every token has probability 1 in both models; an empty table gives
an empty result. Only the named columns are read.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import file_system, scratch_path, slices, written

#: No word has a blank in it.
END = np.array([xxhash.xxh64_intdigest(b" ")], np.uint64).view(np.int64)[0]
#: The context at the beginning of a text, beyond all word numbers.
BEGIN = np.uint64((1 << 32) - 1)
UNKNOWN = -1
#: Entries that a counting task holds before it passes them on; pairs that one merging group gets about.
HELD, GROUP_PAIRS = 2_000_000, 500_000
#: Bytes of parts that a worker keeps on file systems that can't be mapped.
CACHED = 128 << 20


# --- texts as numbers -------------------------------------------------------------------------------


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, for each token its place among them, and where each text ends; an end token closes each text."""
    chunks = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = chunks.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words)).view(np.int64)
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = chunks.offsets.to_numpy().astype(np.int64)[1:]
    if b"" in words:  # white space at a text's ends
        real = which != words.index(b"")
        ends = np.concatenate(([0], np.cumsum(real)))[ends]
        which = which[real]
    tokens = np.insert(which, ends, len(hashes))
    return np.append(hashes, END), tokens, ends + np.arange(1, len(ends) + 1)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


@dataclass
class Counter:
    """Counts by key that a task passes on whenever it holds many."""

    keys: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    held: int = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > 2 * HELD:
            self.pack()
        return self.held > HELD

    def pack(self) -> None:
        if self.keys:
            keys, counts = summed(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.held = [keys], [counts], len(keys)

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        self.pack()
        found = (self.keys[0], self.counts[0]) if self.keys else (np.empty(0, np.int64), np.empty(0, np.int64))
        self.keys, self.counts, self.held = [], [], 0
        return found


# --- sorted arrays in the shared folder -------------------------------------------------------------


@dataclass(frozen=True)
class Sorted:
    """A table sorted by an integer key, one file per column and part; opened by workers, never loaded as a whole."""

    path: str
    columns: tuple[tuple[str, str], ...]
    parts: tuple[tuple[str, int, int], ...]  # name, rows, first key

    @classmethod
    def write(cls, df: DataFrame, key: str, columns: dict[str, str], name: str) -> Sorted:
        """``columns``: numpy types by column, the key among them."""
        path = scratch_path(df.sparkSession, name)
        disk, local = file_system(f"{path}/files")
        disk.create_dir(local, recursive=True)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, rows, first, outs = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, 0, {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                if not outs:
                    disk, local = file_system(f"{path}/files")
                    outs = {c: disk.open_output_stream(f"{local}/{part}.{c}") for c in columns}
                    first = batch.column(batch.schema.get_field_index(key))[0].as_py()
                for c, kind in columns.items():
                    outs[c].write(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(kind).tobytes())
                rows += batch.num_rows
            for out in outs.values():
                out.close()
            if rows:
                yield pa.RecordBatch.from_pydict({"name": [part], "rows": [rows], "first": [first]})

        placed = df.repartitionByRange(key).sortWithinPartitions(key).mapInArrow(run, "name string, rows long, first long")
        placed.write.parquet(f"{path}/manifest")
        found = df.sparkSession.read.schema(placed.schema).parquet(f"{path}/manifest").orderBy("first").collect()  # one row per file
        return cls(f"{path}/files", tuple(columns.items()), tuple((r.name, r.rows, r.first) for r in found))

    def array(self, part: int, column: str) -> np.ndarray:
        return opened(self.path, self.parts[part][0], column, dict(self.columns)[column])

    def find(self, keys: np.ndarray, key: str) -> np.ndarray:
        """The row number of each key, or -1; fastest if ``keys`` ascend."""
        rows = np.full(len(keys), -1, np.int64)
        firsts = np.array([p[2] for p in self.parts], np.int64)
        base = np.concatenate(([0], np.cumsum([p[1] for p in self.parts]))).astype(np.int64)
        part = np.searchsorted(firsts, keys, side="right") - 1
        for k in np.unique(part):
            if k >= 0:
                mine = np.flatnonzero(part == k)
                there = self.array(k, key)
                at = np.minimum(np.searchsorted(there, keys[mine]), len(there) - 1)
                rows[mine] = np.where(there[at] == keys[mine], base[k] + at, -1)
        return rows

    def values(self, rows: np.ndarray, column: str) -> np.ndarray:
        """The column's values at row numbers from 0 on."""
        base = np.concatenate(([0], np.cumsum([p[1] for p in self.parts]))).astype(np.int64)
        out = np.zeros(len(rows), dict(self.columns)[column])
        part = np.searchsorted(base, rows, side="right") - 1
        for k in np.unique(part):
            mine = np.flatnonzero(part == k)
            out[mine] = self.array(k, column)[rows[mine] - base[k]]
        return out


PARTS_READ: OrderedDict[str, np.ndarray] = OrderedDict()


def opened(path: str, part: str, column: str, kind: str) -> np.ndarray:
    """One column of one part: mapped, or read and kept while there is room."""
    name = f"{path}/{part}.{column}"
    if name in PARTS_READ:
        PARTS_READ.move_to_end(name)
        return PARTS_READ[name]
    disk, local = file_system(name)
    if path.startswith("file:"):
        found = np.memmap(local, kind, "r")
    else:
        with disk.open_input_file(local) as source:
            found = np.frombuffer(source.read(), kind)
    PARTS_READ[name] = found
    held = lambda: sum(x.nbytes for x in PARTS_READ.values() if not isinstance(x, np.memmap))
    while len(PARTS_READ) > 1 and held() > CACHED:
        PARTS_READ.popitem(last=False)
    return found


# --- training ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Automaton:
    words: Sorted  # hash, n; a word's number is its row
    states: Sorted  # word, back: log10 of the failure arc
    arcs: Sorted  # key (word << 32 | next word), weight: log10 p
    tokens: int
    types: int
    discount: float

    @property
    def unknown(self) -> float:
        """Probability of the unknown word at the root."""
        return self.discount * self.types / self.tokens if self.tokens else 1.0

    def root(self, counts: np.ndarray) -> np.ndarray:
        """p(w) of words by their counts, 0 for the unknown word."""
        return np.where(counts > 0, (counts - self.discount) / max(self.tokens, 1), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.types + 1))

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n_tokens, n_known, base_score and score of each text, in one pass over its tokens."""
        hashes, tokens, ends = token_hashes(texts)
        order = np.argsort(hashes)
        number = np.empty(len(hashes), np.int64)
        number[order] = self.words.find(hashes[order], "hash")
        counts = np.zeros(len(hashes), np.int64)
        counts[number >= 0] = self.words.values(number[number >= 0], "n")
        at_root, at_base = np.log10(self.root(counts)), self.base(counts)

        begins = np.concatenate(([0], ends[:-1]))
        word = number[tokens]
        state = np.empty_like(word)  # the last word, BEGIN at first
        state[1:] = word[:-1]
        state[begins] = int(BEGIN)
        weight = at_root[tokens]
        known = np.flatnonzero(state >= 0)
        key = state[known] << 32 | np.maximum(word[known], 0)
        distinct, back = np.unique(key, return_inverse=True)
        arc = self.arcs.find(distinct.view(np.uint64).astype(np.uint64).view(np.int64), "key")
        taken = np.zeros(len(distinct))
        taken[arc >= 0] = self.arcs.values(arc[arc >= 0], "weight")
        has = (arc >= 0)[back] & (word[known] >= 0)
        from_, place = np.unique(state[known], return_inverse=True)
        row = self.states.find(from_, "word")
        failure = np.zeros(len(from_))
        failure[row >= 0] = self.states.values(row[row >= 0], "back")
        weight[known] = np.where(has, taken[back], failure[place] + weight[known])
        total = lambda x: np.add.reduceat(x, begins) if len(begins) else np.zeros(0)
        return ends - begins, total((counts > 0)[tokens].astype(np.int64)), total(at_base[tokens]), total(weight)


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal rank together, so that high zero bytes compress away."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplaned(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def word_counts(texts: DataFrame) -> DataFrame:
    """(hash, n) over all of ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([*map(pa.array, counter.taken())], names=["hash", "n"])
        for batch in batches:
            for begin, stop in slices(batch.column(0)):
                hashes, tokens, _ = token_hashes(batch.column(0).slice(begin, stop - begin))
                if counter.add(hashes, np.bincount(tokens, minlength=len(hashes))):
                    counter.pack()
                    if counter.held > HELD:
                        yield out()
        yield out()

    return texts.mapInArrow(run, "hash long, n long").filter("n > 0").groupBy("hash").agg(F.sum("n").alias("n"))


def pair_counts(texts: DataFrame, words: Sorted, groups: int, min_pair: int) -> DataFrame:
    """(key, n) of pairs seen ``min_pair`` times at least; key -1 has the number of pairs seen once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()

        def out() -> pa.RecordBatch:
            keys, counts = counter.taken()
            group = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % groups
            order = np.argsort(group, kind="stable")
            cuts = np.searchsorted(group[order], np.arange(groups + 1))
            rows = [(g, order[cuts[g] : cuts[g + 1]]) for g in range(groups) if cuts[g] < cuts[g + 1]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([g for g, _ in rows], pa.int64()),
                    pa.array([planes(np.diff(keys[r].view(np.uint64), prepend=np.uint64(0))) for _, r in rows], pa.binary()),
                    pa.array([planes(counts[r].astype("<u8")) for _, r in rows], pa.binary()),
                ],
                names=["group", "keys", "counts"],
            )

        for batch in batches:
            for begin, stop in slices(batch.column(0)):
                hashes, tokens, ends = token_hashes(batch.column(0).slice(begin, stop - begin))
                order = np.argsort(hashes)
                number = np.empty(len(hashes), np.int64)
                number[order] = words.find(hashes[order], "hash")
                word = number[tokens]
                last = np.empty_like(word)
                last[1:] = word[:-1]
                last[np.concatenate(([0], ends[:-1]))] = int(BEGIN)
                both = (last >= 0) & (word >= 0)
                keys = np.sort(last[both] << 32 | word[both])
                if counter.add(*summed(keys, np.ones(len(keys), np.int64))):
                    counter.pack()
                    if counter.held > HELD:
                        yield out()
        yield out()

    def merged(table: pa.Table) -> pa.Table:
        parts = [(np.cumsum(unplaned(k, "<u8"), dtype=np.uint64).view(np.int64), unplaned(c, "<u8").view(np.int64)) for k, c in zip(table["keys"].to_pylist(), table["counts"].to_pylist(), strict=True)]
        keys, counts = summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        often = counts >= min_pair
        return pa.table({"key": np.append(keys[often], -1), "n": np.append(counts[often], np.count_nonzero(counts == 1))})

    return texts.mapInArrow(run, "group long, keys binary, counts binary").groupBy("group").applyInArrow(merged, "key long, n long")


def discount(once: int, twice: int) -> float:
    """The usual estimate n1 / (n1 + 2 n2), kept away from 0 and 1."""
    return float(np.clip(once / (once + 2 * twice) if once else 0.5, 0.1, 0.9))


def trained(texts: DataFrame, min_pair: int = 1) -> Automaton:
    """The automaton of ``texts`` (text)."""
    counted = written(word_counts(texts), "lm-words")
    totals = counted.agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).first()
    tokens, types, texts_n = totals.tokens or 0, totals.types, texts.count()
    if types >= int(BEGIN):
        raise ValueError("a pair of words must fit into 64 bits: there are 2 ** 32 different words or more")
    words = Sorted.write(counted, "hash", {"hash": "<i8", "n": "<i8"}, "lm-word-files")
    pairs = written(pair_counts(texts, words, max(1, tokens // GROUP_PAIRS), min_pair), "lm-pairs")
    once = pairs.filter("key = -1").agg(F.sum("n")).first()[0] or 0
    d, d_root = discount(once, pairs.filter("key <> -1 AND n = 2").count()), discount(totals.once, totals.twice)
    seen = pairs.filter("key <> -1")
    mass = seen.groupBy(F.shiftrightunsigned("key", 32).alias("word")).agg(F.sum(F.col("n") - F.lit(d)).alias("mass"))

    def backs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, kept = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            n = np.full(len(word), max(texts_n, 1), np.int64)
            n[word != int(BEGIN)] = words.values(word[word != int(BEGIN)], "n")
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.log10(np.maximum(1 - kept / n, 1e-12))), pa.array(n)], names=["word", "back", "n"])

    states = Sorted.write(mass.mapInArrow(backs, "word long, back double, n long"), "word", {"word": "<i8", "back": "<f8", "n": "<i8"}, "lm-states")
    root = Automaton(words, states, states, tokens, types, d_root)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            row = states.find(key >> 32 & 0xFFFFFFFF, "word")
            p = (n - d) / states.values(row, "n") + 10 ** states.values(row, "back") * root.root(words.values(key & 0xFFFFFFFF, "n"))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.log10(p))], names=["key", "weight"])

    arcs = Sorted.write(seen.mapInArrow(weights, "key long, weight double"), "key", {"key": "<i8", "weight": "<f4"}, "lm-arcs")
    return Automaton(words, states, arcs, tokens, types, d_root)


def scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; trained on the rows that aren't held out."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    model = trained(rows.filter("NOT held_out").select("text"))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop in slices(batch.column(2)):
                part = batch.slice(begin, stop - begin)
                n, known, base, score = model.score(part.column(2))
                n_train = np.full(len(n), model.tokens, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, (n, known, n_train, base, score))], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
