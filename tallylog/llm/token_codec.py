"""Token ids in files, coded by a static range asymmetric numeral system.

One frequency table, counted over all ids and scaled to 2 ** SCALE, is shared by
all blocks. A block of at most BLOCK ids is coded by interleaved lanes with 64-bit
states that shift out 32-bit words; blocks are independent. A file is a run of
blocks and a footer with the blocks' offsets (the checkpoints), their CRC-32 sums
and the documents' ids and lengths, so that any run of documents can be decoded
alone. Files hold documents in ascending id order, file after file.

Defined results: null text is empty and so holds the end id alone; null ids come
first; documents with equal ids stand in the order of their coded bytes; an empty
table gives no files and an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import drop_path, file_system, scratch_path, slices, trimmed

SCALE, BLOCK, LANES = 18, 1 << 18, 1024
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<IIII")
#: Words whose ids a worker keeps; some 20 MB.
KEPT = 100_000
#: Blocks that one decoding task row covers.
RUN = 16


# --- tokenizing -------------------------------------------------------------------------------------


@cache
def loaded(path: str) -> WordEncoder:
    return WordEncoder(path)


#: Latin letters that are their own NFC form; a run of them is one piece to the tokenizer.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
LETTER_RUN = re.compile(f"[{LETTERS}]+")


def byte_letters() -> dict[int, str]:
    """Byte-level models write a byte as the printable Latin-1 character of its number, other bytes as those from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordEncoder:
    """Ids of whole texts, from the ids of their white-space separated chunks.

    The tokenizer drops white space and never joins across it, so a text's ids are its
    chunks' ids in order. Chunks repeat, so each distinct one is encoded once a slice,
    and the first KEPT ones once a worker. Runs of letters go to the tokenizer's model
    straight away, as its normalizer and splitter would leave them lowered and whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.place: dict[str, int] = {}
        self.flat, self.starts = np.empty(0, np.uint16), np.zeros(1, np.int64)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with ``end`` after it, and where each text ends."""
        lowered = pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts)
        # A letter followed by a mark other than an apostrophe is always a border between pieces.
        apart = pc.replace_substring_regex(lowered, f"([{LETTERS}])([!-&(-/:-@\\[-`{{-~])", r"\1 \2")
        chunks = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, apart))
        coded = chunks.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        at = np.fromiter((self.place.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        fresh = self.chunk_ids([words[k] for k in new.tolist()])
        lens = np.fromiter(map(len, fresh), np.int64, len(fresh))
        known = len(self.starts) - 1
        at[new] = known + np.arange(len(new))
        flat = np.concatenate((self.flat, np.fromiter((i for x in fresh for i in x), np.uint16, int(lens.sum()))))
        starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(lens)))
        if known < KEPT:
            self.flat, self.starts = flat, starts
            self.place.update((words[k], int(at[k])) for k in new.tolist())
        which = at[coded.indices.to_numpy(zero_copy_only=False)]
        first, many = starts[which], starts[which + 1] - starts[which]
        ends = np.cumsum(many)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + many, many)]
        stops = np.concatenate(([0], ends))[chunks.offsets.to_numpy()[1:]]
        return np.insert(ids, stops, end), stops + np.arange(1, len(stops) + 1)

    def chunk_ids(self, words: list[str]) -> list[list[int]]:
        found: list[list[int]] = [[]] * len(words)
        rest = []
        for k, w in enumerate(words):
            if not LETTER_RUN.fullmatch(w):
                rest.append(k)
            elif w.isascii():
                found[k] = [t.id for t in self.model.tokenize(w.lower())]
            else:
                found[k] = [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, w.lower().encode())))]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False), strict=True):
            found[k] = e.ids
        return found


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 16-bit numbers, with the end id."""
    narrow = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            for begin, stop in slices(texts):
                ids, ends = encoder.encode(texts.slice(begin, stop - begin), end_id)
                at = pa.py_buffer(np.concatenate(([0], ends * 2)).astype(np.int32))
                coded = pa.Array.from_buffers(pa.binary(), stop - begin, [None, at, pa.py_buffer(ids.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, stop - begin), coded], names=["doc_id", "ids"])
            pa.default_memory_pool().release_unused()

    return narrow.mapInArrow(trimmed(run), f"doc_id {kind}, ids binary")


# --- coding -----------------------------------------------------------------------------------------


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2 ** scale, at least 1 wherever a count is."""
    total, whole = int(counts.sum()), 1 << scale
    if not total:
        return np.zeros(len(counts), np.uint64)
    freq = np.maximum((counts > 0).astype(np.int64), (counts.astype(np.float64) * (whole / total)).astype(np.int64))
    while over := int(freq.sum()) - whole:
        order = np.argsort(-freq, kind="stable")
        if over < 0:
            freq[order[0]] -= over
        else:
            spare = np.minimum(np.maximum(freq[order] // 8, freq[order] > 1), freq[order] - 1)
            taken = np.minimum(spare, np.maximum(over - (np.cumsum(spare) - spare), 0))
            freq[order] -= np.maximum(taken, 0)
    return freq.astype(np.uint64)


class Table:
    """Frequencies, their running sums, and the symbol of each slot."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.freq, self.scale = freq.astype(np.uint64), scale
        self.below = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.freq, dtype=np.uint64)))[:-1]
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    def encode(self, ids: np.ndarray) -> bytes:
        """A block: head, lane states, words."""
        n = len(ids)
        lanes = min(LANES, -(-n // 64)) or 1
        state = np.full(lanes, LOW, np.uint64)
        bits, word = np.uint64(self.scale), np.uint64(32)
        room = np.uint64(63 - self.scale)
        freq, below = self.freq[ids], self.below[ids]
        out = []
        for at in range((n - 1) // lanes * lanes if n else -1, -1, -lanes):
            f, b = freq[at : at + lanes], below[at : at + lanes]
            x = state[: len(f)]
            full = x >= f << room
            out.append(x[full].astype("<u4"))
            x = np.where(full, x >> word, x)
            q = x // f
            state[: len(f)] = (q << bits) + (x - q * f) + b
        words = np.concatenate(out[::-1]) if out else np.empty(0, "<u4")
        return HEAD.pack(n, lanes, len(words), zlib.crc32(ids.astype("<u4").tobytes())) + state.astype("<u8").tobytes() + words.tobytes()

    def decode(self, block: bytes) -> np.ndarray:
        n, lanes, n_words, crc = HEAD.unpack_from(block)
        state = np.frombuffer(block, "<u8", lanes, HEAD.size).astype(np.uint64)
        words = np.frombuffer(block, "<u4", n_words, HEAD.size + 8 * lanes).astype(np.uint64)
        bits, mask, word = np.uint64(self.scale), np.uint64((1 << self.scale) - 1), np.uint64(32)
        ids, used = np.empty(n, np.uint32), 0
        for at in range(0, n, lanes):
            x = state[: min(lanes, n - at)]
            slot = x & mask
            s = self.symbol[slot]
            ids[at : at + lanes] = s
            x = self.freq[s] * (x >> bits) + slot - self.below[s]
            low = np.flatnonzero(x < LOW)
            x[low] = x[low] << word | words[used : used + len(low)]
            used += len(low)
            state[: len(x)] = x
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum does not match its ids")
        return ids


# --- files ------------------------------------------------------------------------------------------


def write_file(uri: str, table: Table, rows: Iterator[tuple[pa.Array, pa.Array]], kind: pa.DataType) -> tuple[int, int]:
    """Writes (ids of documents, coded bytes) to one file; returns documents and ids."""
    disk, path = file_system(uri)
    blocks: list[tuple[int, int, int]] = []
    names, lengths, waiting, held, n, at = [], [], [], 0, 0, 0
    with disk.open_output_stream(path) as out:

        def put(ids: np.ndarray) -> None:
            nonlocal at
            data = table.encode(ids)
            out.write(data)
            blocks.append((at, len(data), len(ids)))
            at += len(data)

        for docs, coded in rows:
            names.append(docs)
            lengths.append(pc.divide(pc.binary_length(coded), 2).cast(pa.int64()))
            offsets = np.frombuffer(coded.buffers()[1], np.int32)[coded.offset : coded.offset + len(coded) + 1]
            ids = np.frombuffer(coded.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view("<u2")
            waiting.append(ids)
            held += len(ids)
            n += len(ids)
            if held >= BLOCK:
                joined = np.concatenate(waiting)
                cut = held // BLOCK * BLOCK
                for k in range(0, cut, BLOCK):
                    put(joined[k : k + BLOCK])
                waiting, held = [joined[cut:].copy()], held - cut
        if held:
            put(np.concatenate(waiting))
        sink = pa.BufferOutputStream()
        places = pa.table(dict(zip(("at", "bytes", "ids"), [pa.array(x, pa.int64()) for x in zip(*blocks, strict=True)] or [pa.array([], pa.int64())] * 3, strict=True)))
        documents = pa.table({"doc_id": pa.chunked_array(names, kind), "n": pa.chunked_array(lengths, pa.int64())})
        for part in (places, documents):
            with pa.ipc.new_stream(sink, part.schema) as ipc:
                ipc.write_table(part)
        foot = sink.getvalue()
        out.write(foot)
        out.write(struct.pack("<Q", foot.size))
    return len(documents), n


def read_foot(source) -> tuple[pa.Table, pa.Table]:
    end = source.size()
    source.seek(end - 8)
    (size,) = struct.unpack("<Q", source.read(8))
    source.seek(end - 8 - size)
    foot = pa.BufferReader(source.read(size))
    return pa.ipc.open_stream(foot).read_all(), pa.ipc.open_stream(foot).read_all()


def id_counts(coded: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all of ``coded``; as long as the vocabulary, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                if x.is_valid:
                    total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])

    found = coded.select("ids").mapInArrow(trimmed(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def write_tokens(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``docs`` as coded files below ``path``, a folder that driver and executors share."""
    spark = docs.sparkSession
    raw = scratch_path(spark, "ids")
    plan = tokenized(docs, tokenizer, end_id, id_col, text_col)
    plan.write.parquet(raw)
    coded = spark.read.schema(plan.schema).parquet(raw)
    freq = scaled(id_counts(coded, vocabulary))
    kind, files = plan.schema["doc_id"].dataType.simpleString(), f"{path}/files"
    disk, local = file_system(files)
    disk.create_dir(local, recursive=True)
    shared = spark.sparkContext.broadcast(freq.astype("<u4").tobytes())  # 4 bytes for each id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        table = Table(np.frombuffer(shared.value, "<u4"))
        part = TaskContext.get().partitionId()
        # A repeated attempt writes another file; the manifest, which Spark commits, names the one that counts.
        name = f"part-{part:06d}-{uuid.uuid4().hex}.rans"

        def rows() -> Iterator[tuple[pa.Array, pa.Array]]:
            yield first.column(0), first.column(1)
            for batch in batches:
                yield batch.column(0), batch.column(1)

        n_docs, n_ids = write_file(f"{files}/{name}", table, rows(), first.schema.field(0).type)
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "docs": [n_docs], "ids": [n_ids]})

    ordered = coded.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(trimmed(run), "part long, file string, docs long, ids long").write.parquet(f"{path}/manifest")
    spark.createDataFrame([(kind, bytearray(freq.astype("<u4").tobytes()))], "kind string, freq binary").coalesce(1).write.parquet(f"{path}/table")
    drop_path(spark, raw)


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files below ``path``; with ``digest``, ids_crc32 instead of ids.

    ``start`` counts the ids of all documents before. Each row of work is a run of
    documents that begin within RUN blocks.
    """
    head = spark.read.parquet(f"{path}/table").first()
    shared = spark.sparkContext.broadcast(bytes(head.freq))
    files = f"{path}/files"
    manifest = spark.read.schema("part long, file string, docs long, ids long").parquet(f"{path}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    runs = placed.withColumn("run", F.explode(F.expr(f"sequence(0L, greatest(ids - 1, 0L) div {BLOCK * RUN}L)"))).select("file", "base", "run")
    spread = runs.repartition(max(1, 4 * spark.sparkContext.defaultParallelism), "file", "run")
    last = "ids_crc32 long" if digest else "ids array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(np.frombuffer(shared.value, "<u4"))
        for batch in batches:
            for row in batch.to_pylist():
                yield from decoded(f"{files}/{row['file']}", row["base"], row["run"], table, digest)

    return spread.mapInArrow(trimmed(run), f"doc_id {head.kind}, start long, n_tokens long, {last}")


def decoded(uri: str, base: int, run: int, table: Table, digest: bool) -> Iterator[pa.RecordBatch]:
    """The documents of one file whose first id lies in the run's blocks."""
    disk, path = file_system(uri)
    with disk.open_input_file(path) as source:
        blocks, docs = read_foot(source)
        lengths = docs["n"].to_numpy()
        starts = np.cumsum(lengths) - lengths
        begin, stop = np.searchsorted(starts, [run * RUN * BLOCK, (run + 1) * RUN * BLOCK])
        at, size = blocks["at"].to_numpy(), blocks["bytes"].to_numpy()
        buffer, origin, block = np.empty(0, np.uint32), int(starts[begin]) if begin < stop else 0, -1
        out: list[tuple] = []
        held = 0
        for k in range(begin, stop):
            while origin + len(buffer) < starts[k] + lengths[k]:
                block = block + 1 if block >= 0 else int(starts[k]) // BLOCK
                source.seek(int(at[block]))
                ids = table.decode(source.read(int(size[block])))
                lies = block * BLOCK
                keep = int(starts[k])  # what lies before isn't needed any more
                joined = np.concatenate((buffer, ids)) if len(buffer) else ids
                from_ = origin if len(buffer) else lies
                buffer, origin = joined[max(0, keep - from_) :], max(from_, keep)
            ids = buffer[int(starts[k]) - origin :][: int(lengths[k])]
            out.append((int(starts[k]) + base, len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.tolist()))
            held += 1 if digest else len(ids)
            if held >= 1 << 17 or k == stop - 1:
                cols = list(zip(*out, strict=True))
                last = pa.array(cols[2], pa.int64() if digest else pa.list_(pa.int64()))
                names = docs["doc_id"].slice(k + 1 - len(out), len(out)).combine_chunks()
                yield pa.RecordBatch.from_arrays([names, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
                out, held = [], 0
