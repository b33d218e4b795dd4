"""WARC archives: writing pages, and normalizing whole-file gzip streams.

``write_archives`` stores each page as a record; of equal payloads of
``REVISIT_BYTES`` or more, the record with the largest page id is the response and
the others revisit it. A file is one gzip stream over all its records, as simple
writers leave it, which can't be entered in the middle. ``normalize`` inflates each
such file once, from beginning to end, rewrites every record as a gzip member of
its own, and writes a sidecar table with each member's offset. ``read_records``
then reads any record by its offset.

Streams are inflated and written piece by piece; no file and no payload group is
held in memory, one record is. Defined results: null html is an empty payload;
a page with a null id is a response, as its payload may be nowhere else; ids
of any characters come back as they were;
equal page ids with equal payloads make equal records; an empty table makes no
files and an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from io import BytesIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import file_system, scratch_path, written

REVISIT_BYTES = 1000
PIECE = 1 << 20
#: Terms of the WARC 1.1 format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 16 + zlib.MAX_WBITS
FILE = "file string, records long, bytes long"
INDEX = "file string, at long, size long, number long"


# --- records ----------------------------------------------------------------------------------------


def page_urn(page_id: str | None, digest: str) -> str:
    """The name of a page's record: its id with all but letters, digits and ``_.-~`` as %XX; the payload's digest for a null id."""
    return f"<urn:unnamed:{digest}>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def page_of(urn: str) -> str | None:
    return unquote(urn.removeprefix("<urn:page:").removesuffix(">")) if urn.startswith("<urn:page:") else None


def record(kind: str, page_id: str | None, uri: str | None, payload: bytes, refers_to: str | None, digest: str) -> bytes:
    """One record. A revisit has no payload, but the digest and length of what it repeats."""
    uri = "".join(c for c in uri or "" if c.isprintable() and c != " ") or "about:blank"
    body = payload if kind == "response" else b""
    head = [
        VERSION,
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {page_urn(page_id, digest)}",
        f"WARC-Target-URI: {uri}",
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {page_urn(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class Records:
    """Cuts a stream of bytes into records; holds one record at most."""

    def __init__(self):
        self.held, self.need = bytearray(), 0

    def feed(self, piece: bytes) -> Iterator[bytes]:
        self.held += piece
        while True:
            if not self.need:
                cut = self.held.find(b"\r\n\r\n")
                if cut < 0:
                    return
                self.need = cut + 4 + int(parse_head(bytes(self.held[:cut])).get("content-length", 0)) + 4
            if len(self.held) < self.need:
                return
            yield bytes(self.held[: self.need])
            del self.held[: self.need]
            self.need = 0

    def end(self) -> None:
        if self.held:
            raise ValueError("the archive ends within a record")


def inflated(source) -> Iterator[bytes]:
    """The content of a gzip file of one member or several, in pieces of bounded size; zero bytes behind a member are padding, a cut member is an error."""
    stream, waiting, begun = zlib.decompressobj(GZIP), b"", False
    while True:
        piece = waiting or source.read(PIECE)
        if not piece:
            break
        if not begun and not (piece := piece.lstrip(b"\0")):
            waiting = b""
            continue
        begun = True
        yield stream.decompress(piece, PIECE)
        waiting = stream.unconsumed_tail or stream.unused_data
        if stream.eof:
            stream, begun = zlib.decompressobj(GZIP), False
    if begun:
        raise ValueError("the gzip stream is cut off")


# --- writing, normalizing, reading ------------------------------------------------------------------


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, kind, refers_to): which record each page becomes."""
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col], F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    large = rows.filter(F.col("size") >= REVISIT_BYTES)
    again = large.groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = written(again, "warc-repeats")  # one row per repeated payload, so that the planner knows its size
    joined = rows.join(again, rows.digest == again.of, "left")
    revisit = F.coalesce((F.col("size") >= REVISIT_BYTES) & (F.col("page_id") < F.col("original")), F.lit(False))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("original")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, **columns) -> DataFrame:
    """Writes ``pages`` as archives below ``path``, each one gzip stream; returns (file, records, bytes)."""
    plan = planned(pages, **columns)
    make_folder(f"{path}/whole")
    manifest = plan.select(F.col("page_id").cast("string"), "url", "payload", "digest", "kind", F.col("refers_to").cast("string")).mapInArrow(lambda b: archived(b, f"{path}/whole"), FILE)
    return committed(manifest, f"{path}/whole-manifest")


def make_folder(uri: str) -> None:
    disk, local = file_system(uri)
    disk.create_dir(local, recursive=True)


def committed(manifest: DataFrame, path: str) -> DataFrame:
    """Runs the writing tasks; the table names the files of those attempts that Spark commits."""
    manifest.write.parquet(path)
    return manifest.sparkSession.read.schema(manifest.schema).parquet(path)


def archived(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    name, n, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
    for batch in batches:
        for row in batch.to_pylist():
            if out is None:
                disk, local = file_system(f"{folder}/{name}")
                out, squeeze = disk.open_output_stream(local, compression=None), zlib.compressobj(6, zlib.DEFLATED, GZIP)
            out.write(squeeze.compress(record(row["kind"], row["page_id"], row["url"], row["payload"], row["refers_to"], row["digest"])))
            n += 1
    if out is not None:
        out.write(squeeze.flush())
        size = out.tell()
        out.close()
        yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "records": [n], "bytes": [size]})


def normalize(archives: DataFrame, path: str) -> DataFrame:
    """Rewrites ``archives`` (file) so that each record is a gzip member; returns the index (file, at, size, number).

    The index is also written beside the files as a table, ``index``.
    """
    spread = archives.select("file").repartition(max(1, archives.count()), "file")
    make_folder(f"{path}/members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                yield from members(file, f"{path}/members")

    return committed(spread.mapInArrow(run, INDEX), f"{path}/index")


def members(file: str, folder: str) -> Iterator[pa.RecordBatch]:
    target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
    disk, local = file_system(file)
    to, place = file_system(target)
    records, at, number, rows = Records(), 0, 0, []
    with disk.open_input_file(local) as source, to.open_output_stream(place, compression=None) as out:
        for piece in inflated(source):
            for whole in records.feed(piece):
                squeeze = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                data = squeeze.compress(whole) + squeeze.flush()
                out.write(data)
                rows.append({"file": target, "at": at, "size": len(data), "number": number})
                at, number = at + len(data), number + 1
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_pylist(rows)
                    rows = []
        records.end()
    if rows:
        yield pa.RecordBatch.from_pylist(rows)


RECORD = "page_id string, record_type string, refers_to string, payload_bytes long, payload_digest string"


def read_records(index: DataFrame, tasks: int | None = None, payload: bool = False) -> DataFrame:
    """Records by the ``index``: page_id, record_type, refers_to, payload_bytes, payload_digest and, if asked for, payload.

    The payload of a response is measured, a revisit's is taken from its head. Neighbours in a file are read together.
    """
    n = tasks or 4 * index.sparkSession.sparkContext.defaultParallelism
    spread = index.repartitionByRange(max(1, n), "file", "at").sortWithinPartitions("file", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        schema = SCHEMA.append(pa.field("payload", pa.binary())) if payload else SCHEMA
        for batch in batches:
            rows, held = [], 0
            for entry in batch.to_pylist():
                if entry["file"] != name:
                    if source:
                        source.close()
                    name = entry["file"]
                    disk, local = file_system(name)
                    source = disk.open_input_file(local)
                source.seek(entry["at"])
                rows.append(described(b"".join(inflated(BytesIO(source.read(entry["size"])))), payload))
                held += len(rows[-1].get("payload") or b"")
                if held > PIECE << 3:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if source:
            source.close()

    return spread.mapInArrow(run, RECORD + (", payload binary" if payload else ""))


SCHEMA = pa.schema([("page_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def described(whole: bytes, payload: bool) -> dict:
    cut = whole.index(b"\r\n\r\n")
    head = parse_head(whole[:cut])
    body = whole[cut + 4 : cut + 4 + int(head["content-length"])]
    response = head["warc-type"] == "response"
    digest = hashlib.sha1(body).hexdigest()
    stated = head["warc-payload-digest"].removeprefix("sha1:")
    if response and digest != stated:
        raise ValueError(f"record {head['warc-record-id']}: the payload does not match its digest")
    page, refers = page_of(head["warc-record-id"]), page_of(head["warc-refers-to"]) if "warc-refers-to" in head else None
    found = {"page_id": page, "record_type": head["warc-type"], "refers_to": refers}
    found |= {"payload_bytes": len(body) if response else int(head["x-payload-length"]), "payload_digest": stated}
    return found | ({"payload": body} if payload else {})


def page_records(pages: DataFrame, id_col: str = "page_id", **columns) -> DataFrame:
    """Writes the pages as archives, normalizes them and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    kind = pages.schema[id_col].dataType
    path = scratch_path(pages.sparkSession, "warc")
    index = normalize(write_archives(pages, path, id_col=id_col, **columns), path)
    found = read_records(index)
    return found.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


def whole_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file) of the archives below ``path``, wherever they come from."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select(F.col("path").alias("file"))
