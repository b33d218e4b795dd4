"""Heavy hitters, SQL functions, formats file by file, standard input in blocks, reports that go on."""

import io
import json
import random
import sys
from collections import Counter
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from tallylog import cli, oracles, queries
from tallylog.functions import sql, times, words
from tallylog.operators import heavy, parsers
from tallylog.operators.parsers import LogFormat
from tallylog.plans.report import summarize_path
from tallylog.sources.lines import read_lines, spooled


def most(keys, n):
    return sorted(Counter(k for k in keys if k is not None).items(), key=lambda x: (-x[1], x[0]))[:n]


@pytest.mark.parametrize("slots", [3, 20, 5000])
@pytest.mark.parametrize("kind", ["skewed", "flat", "few"])
def test_most_frequent(spark, slots, kind):
    draw = random.Random(2)
    keys = {"skewed": [f"k{int(draw.paretovariate(0.8))}" for _ in range(3000)], "flat": [f"k{k % 400}" for k in range(1200)] + ["k7"], "few": ["a", None, "b", "a"]}[kind]
    rows = spark.createDataFrame([(k,) for k in keys], "word string").repartition(3)
    assert [(r.word, r.n) for r in heavy.most_frequent(rows, "word", 5, slots).collect()] == most(keys, 5)
    assert heavy.most_frequent(rows.limit(0), "word", 5, slots).count() == 0


def test_summaries_keep_their_bound():
    draw, own, plain = random.Random(4), heavy.Summary(10), Counter()
    for _ in range(200):
        keys = [f"k{int(draw.paretovariate(0.7))}" for _ in range(50)]
        found = Counter(keys)
        own.add(list(found), list(found.values()))
        plain.update(keys)
        assert len(own.counts) <= 10 and all(own.counts.get(k, 0) <= n <= own.counts.get(k, 0) + own.off for k, n in plain.items())


def test_functions_of_sql(spark):
    sql.register(spark)
    texts = ["07/Mar/2031:04:05:06 -0330", "2031-03-07T04:05:06.25Z x", "/a/77/b?c=1", "it's \"7\" 12", "warning", "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    own = {"parse_clf": times.clf_ms, "parse_iso": times.iso_prefix, "route": words.route, "message_key": words.message_key, "level_rank": words.level_rank}
    for name, f in own.items():
        both = rows.select("k", F.expr(f"{name}(t)").alias("a"), f(F.col("t")).alias("b")).collect()
        assert all(r.a == r.b for r in both), name
    line = 'h - - [07/Mar/2031:04:05:06 +0000] "PUT /a/b HTTP/1.1" 201 18446744073709551615 "-" "ua" 0.75'
    spark.createDataFrame([(line,), ("no",)], "value string").createOrReplaceTempView("some_lines")
    found = spark.sql("SELECT x.* FROM some_lines, LATERAL access_line(value) x").collect()
    assert [tuple(r) for r in found] == [(1930622706000, "PUT", "/a/b", 201, (1 << 64) - 1, 0.75)]


def test_formats_of_files(spark, tmp_path):
    access, app = 'h [07/Mar/2031:04:05:06] "GET / X" 200 1\n', "2031-03-07T04:05:06Z info x\n"
    files = {"a.log": "\n" * 3000 + access, "b.log": "junk\n" * 49 + app + access, "c.log": "junk\n" * 50 + app, "d.log": " \n", "e.log": access + app}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    lines = read_lines(spark, str(tmp_path))
    got = {r.file.rpartition("/")[2]: r.format for r in parsers.formats(lines).collect()}
    assert got == {"a.log": "access", "b.log": "app", "c.log": None, "e.log": "access"}
    parts = parsers.by_format(lines)
    assert {fmt: df.filter("value <> ''").count() for fmt, df in parts.items()} == {LogFormat.ACCESS: 3, LogFormat.APP: 51}
    assert summarize_path(spark, str(tmp_path / "a.log"))["format"] == "access"


def test_lines_of_a_format_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.log").write_text('h [07/Mar/2031:04:05:06] "GET / X" 200 1\n' * 9)
    (tmp_path / "b.log").write_text("junk\n")
    with parsers.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):  # as if the lines were many
        parts = parsers.by_format(read_lines(spark, str(tmp_path)))
        plan = parts[LogFormat.ACCESS]._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        assert {fmt: df.count() for fmt, df in parts.items()} == {LogFormat.ACCESS: 9, LogFormat.APP: 0}


def test_files_grow_in_number_not_in_size(spark, tmp_path):
    rows = spark.range(1000).select("id", F.encode(F.format_string("%d\n", "id"), "UTF-8").alias("line"))
    written = lambda name, **more: sorted(queries.written_files(rows, "id", str(tmp_path / name), 2, **more) and (tmp_path / name).iterdir())
    few, many = written("few"), written("many", most=100)
    assert len(few) == 2 and 8 <= len(many) <= 10
    assert "".join(f.read_text() for f in few) == "".join(f.read_text() for f in many) == "".join(f"{k}\n" for k in range(1000))


def test_generated_log_is_made_once(spark, tmp_path, monkeypatch):
    keys = [*range(490, 520), 505, 2499, 2500, 2500, 14_999, 15_000, 15_001, 60_000]  # doubles, borders of blocks and cycles
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(queries, "ORDERS_OF_A_TASK", 7)
    found = queries.generated_log(spark, str(tmp_path))
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
        assert [tuple(r) for r in found.collect()] == c.execute(oracles.ORACLES["generated_log"]).fetchall()


class Dribble(io.BytesIO):
    def read(self, n=-1):
        return super().read(min(n, 7))


def test_standard_input_in_blocks(tmp_path):
    text = b"".join(b"line %d\n" % k for k in range(300)) + b"end"
    folder = spooled(Dribble(text), str(tmp_path / "in"), 100)
    files = sorted((tmp_path / "in").iterdir())
    assert folder == str(tmp_path / "in") and len(files) > 20 and b"".join(f.read_bytes() for f in files) == text
    assert all(f.read_bytes().endswith(b"\n") for f in files[:-1])


def test_command_line_with_a_store(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda args: spark)
    line = "2031-03-07T04:05:{:02}Z error disk {} full\n"
    (tmp_path / "a.log").write_text(line.format(1, 1) + line.format(2, 2))
    args = [str(tmp_path / "a.log"), "--json", "--store", str(tmp_path / "kept")]
    assert cli.main(args) == 0 and json.loads(capsys.readouterr().out)["lines"] == 2
    with (tmp_path / "a.log").open("a") as f:
        f.write(line.format(1, 3))
    assert cli.main(args) == 0
    r = json.loads(capsys.readouterr().out)
    assert (r["lines"], r["out_of_order"], r["top_errors"]) == (3, 1, [["disk # full", 3]])
    monkeypatch.setattr(sys, "stdin", SimpleNamespace(buffer=io.BytesIO(b"")))
    assert cli.main(["-"]) == 2
