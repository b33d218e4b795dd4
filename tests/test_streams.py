"""Streams that start anew, batches that run twice, silences that go on; the data source and the store of facts."""

import pytest
from pyspark.sql import functions as F

from tallylog.operators.parsers import LogFormat
from tallylog.plans import store
from tallylog.plans.report import summarize_path
from tallylog.sources import generator, reader
from tallylog.sources.lines import numbered, read_lines
from tallylog.streaming import minutes, order, sink


def said(minute: int, second: int, text: str = "info x") -> str:
    return f"2029-05-03T06:{minute:02}:{second:02}Z {text}\n"


@pytest.fixture()
def log(spark, tmp_path):
    reader.register(spark)
    order.with_rocksdb(spark)
    (tmp_path / "log").mkdir()
    return tmp_path / "log"


def stream(spark, log):
    return spark.readStream.format("tallylog").option("path", str(log)).option("blockBytes", 40).load()


def test_order_of_a_growing_log(spark, log, tmp_path):
    out, at = str(tmp_path / "out"), str(tmp_path / "cp")
    step = lambda: sink.run(order.stream_order(stream(spark, log), LogFormat.APP, 60_000), sink.upserted(out, ["source"]), at, "update")
    (log / "a.log").write_text(said(0, 0) + said(0, 9) + said(0, 5) + "2029-05-03T06:0")
    step()
    with (log / "a.log").open("a") as f:  # the last line was not whole
        f.write("3:00Z info y\njunk\n")
    step()
    (log / "b.log").write_text(said(2, 0) + said(9, 0))
    step()
    sink.forget_commit(spark, at)  # the last batch again
    step()
    r = sink.table(spark, out, order.ORDER, latest=True).collect()
    assert [(x.source, x.lines, x.parsed, x.out_of_order, x.gaps, x.longest_ms) for x in r] == [("", 7, 6, 2, 2, 420_000)]


def test_silence_that_goes_on(spark, log, tmp_path):
    out, at = str(tmp_path / "out"), str(tmp_path / "cp")
    kind = F.regexp_extract("file", "/([a-z])[0-9]*[.]log$", 1)
    step = lambda: sink.run(order.stream_order(stream(spark, log), LogFormat.APP, 60_000, kind, timers=True), sink.upserted(out, ["source"]), at, "update")
    found = lambda: {r.source: (r.silent_since, r.gaps) for r in sink.table(spark, out, order.ORDER, latest=True).collect()}
    zero = 1_872_482_400_000
    (log / "a1.log").write_text(said(0, 0) + said(0, 30))
    (log / "b1.log").write_text(said(0, 10))
    step()
    (log / "b2.log").write_text(said(0, 20) + said(4, 0))
    step()
    assert found() == {"a": (None, 0), "b": (None, 1)}
    (log / "b3.log").write_text(said(4, 1))
    step()
    assert found() == {"a": (zero + 30_000, 0), "b": (None, 1)}
    (log / "a2.log").write_text(said(5, 0) + said(3, 0))  # late for the watermark, but counted
    step()
    assert found() == {"a": (None, 1), "b": (None, 1)} and sink.table(spark, out, order.ORDER, latest=True).agg(F.sum("lines")).first()[0] == 8


def test_minutes_and_sketch_of_streams(spark, log, tmp_path):
    lines = [r.value for r in generator.access_lines(spark, 3000, partitions=3).orderBy("id").collect()]
    for k in range(3):
        (log / f"{k}.log").write_text("\n".join(lines[k * 1000 : k * 1000 + 1000]) + "\n")
        sink.run(minutes.stream_minute_counts(stream(spark, log), LogFormat.ACCESS), sink.upserted(str(tmp_path / "m"), ["minute"]), str(tmp_path / "cm"), "update")
        sink.run(minutes.stream_sketch(stream(spark, log)), sink.upserted(str(tmp_path / "s"), ["bucket"]), str(tmp_path / "cs"), "update")
    for folder, schema in (("m", minutes.MINUTES), ("s", minutes.BUCKETS)):
        assert sink.table(spark, str(tmp_path / folder), schema, latest=True).agg(F.sum("n")).first()[0] == 3000


HARD = ["a\r\n".encode(), b"\n", b"\r\r\n", b"x\ry\n", b"\xff\xfe(\xe2\x28\n", "é😀\u2028z\r\n".encode(), b"long" * 300 + b"\n", b" no end"]


@pytest.mark.parametrize("block", [1, 7, 300, 1 << 20])
@pytest.mark.parametrize("piece", [16, 4 << 20])
def test_lines_of_any_blocks(tmp_path, monkeypatch, block, piece):
    monkeypatch.setattr(reader, "PIECE", piece)
    path = tmp_path / "hard.log"
    path.write_bytes(b"".join(HARD))
    size = path.stat().st_size
    got = [v for part in reader.ranges(f"file://{path}", 0, size, block) for batch in reader.lines_of(part) for v in batch.column(0).to_pylist()]
    assert got == ["a", "", "", "x\ry", "\ufffd\ufffd(\ufffd(", "é😀\u2028z", "long" * 300, " no end"]
    assert reader.whole_lines(f"file://{path}", 0, size) == size - len(b" no end") and reader.whole_lines(f"file://{path}", size - 3, size) == size - 3


def test_source_equals_text_reader(spark, log):
    (log / "b.log").write_bytes(b"".join(HARD) * 20)
    (log / "a.log").write_bytes(b"first\n")
    (log / ".hidden").write_text("no\n")
    rows = lambda df: [(r.line_no, r.value) for r in numbered(df).orderBy("line_no").collect()]
    own = rows(spark.read.format("tallylog").option("path", str(log)).option("blockBytes", 1000).load())
    assert own == rows(read_lines(spark, str(log))) and own[0] == (1, "first")
    assert spark.read.format("tallylog").option("path", str(log / "a*.log")).load().count() == 1
    with pytest.raises(Exception, match="gone"):
        spark.read.format("tallylog").option("path", str(log / "gone")).load().count()


def test_small_blocks_share_partitions(log, monkeypatch):
    (log / "a.log").write_bytes(b"".join(HARD) * 20)
    (log / "b.log").write_bytes(b"x\n" * 900)
    monkeypatch.setattr(reader, "TASK", 2000)
    source = reader.LogReader({"path": str(log), "blockBytes": "100"})
    parts = source.partitions()
    size = sum(f.stat().st_size for f in log.iterdir())
    assert len(parts) <= size // 1900 + 2 and all(sum(r.stop - r.start for r in p.ranges) <= 2000 for p in parts)
    got = [(b.column(2)[0].as_py(), v) for p in parts for b in source.read(p) for v in b.column(0).to_pylist()]
    assert [v for _, v in got] == ["a", "", "", "x\ry", "\ufffd\ufffd(\ufffd(", "é😀\u2028z", "long" * 300, " no enda"] + (["", "", "x\ry", "\ufffd\ufffd(\ufffd(", "é😀\u2028z", "long" * 300, " no enda"] * 19)[:-1] + [" no end"] + ["x"] * 900
    assert len({b for b, _ in got}) > 20 and all(b % 100 == 0 for b, _ in got)
    assert len(source.__class__({"path": str(log)}).partitions()) > 1  # large blocks are partitions of their own


def test_numbered_reads_lines_twice(spark, log):
    (log / "a.log").write_bytes(b"x\n" * 50)
    found = numbered(spark.read.format("tallylog").option("path", str(log)).option("blockBytes", 10).load())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("tallylog") == 1  # the other reading has been written as a table
    assert sorted(r.line_no for r in found.collect()) == list(range(1, 51))


def test_store(spark, log, tmp_path):
    kept, text = str(tmp_path / "store"), [r.value for r in generator.access_lines(spark, 4000, partitions=2).orderBy("id").collect()]
    with pytest.raises(ValueError, match="empty"):
        store.report(spark, kept)
    (log / "a.log").write_text("\n".join(text[:1000]) + "\n")
    (log / "b.log").write_text("\n".join(text[1000:2500]) + "\n")
    assert store.add(spark, kept, str(log), block_bytes=20_000) == sum(f.stat().st_size for f in log.iterdir())
    with (log / "b.log").open("a") as f:
        f.write("\n".join(text[2500:]) + "\n")
    assert store.add(spark, kept, str(log)) > 0
    assert store.add(spark, kept, str(log)) == store.add(spark, kept, str(log / "a.log")) == 0
    (tmp_path / "store" / "facts" / "part-9").mkdir()  # of a run that broke off
    whole = summarize_path(spark, str(log))
    assert store.report(spark, kept) == whole
    store.compact(spark, kept)
    assert store.report(spark, kept) == whole and [p.name for p in (tmp_path / "store" / "ledger").iterdir() if p.name[0] == "p"] == ["part-2"]
    with pytest.raises(ValueError, match="gap"):
        (log / "c.log").write_text(text[0] + "\n")
        store.add(spark, kept, str(log), gap_seconds=5)
    with pytest.raises(ValueError, match="shorter"):
        (log / "a.log").write_text("x\n")
        store.add(spark, kept, str(log))
