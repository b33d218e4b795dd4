"""Reports on files: planted findings, hard bytes, split sizes, command line."""

import io
import json
import sys
from types import SimpleNamespace

import pytest

from tallylog import cli
from tallylog.plans.render import duration, milliseconds, to_json, to_text
from tallylog.plans.report import summarize_path
from tallylog.sources import generator

BLANK = " \t "


def hit(minute, second, method, path, status, size, took):
    return f'198.51.100.9 - ann [03/May/2029:{6 + minute // 60:02}:{minute % 60:02}:{second:02} +0000] "{method} {path} HTTP/2" {status} {size} "-" "t" {took}'


@pytest.fixture(scope="module")
def shop(tmp_path_factory):
    """Every other minute is empty; one minute is crowded, one has failures, one comes late, then nothing for long."""
    out = []
    for minute in range(0, 80, 2):
        for k in range(900 if minute == 24 else 40):
            out.append(hit(minute, k % 60 if minute != 24 else k // 15, "GET", f"/tea/{k + 7}?x", 200, 10, f"0.{k % 7 + 1}"))
        if minute == 50:
            out += [hit(minute, 59, "POST", "/till", 503, "-", 2.5)] * 25
        if minute == 60:
            out += ["<<< rotated >>>", BLANK, hit(58, 1, "GET", "/late", 404, 1, "-")]
    out.append(hit(130, 0, "GET", "/end", 302, 5, 0.1))
    path = tmp_path_factory.mktemp("shop") / "shop.log"
    path.write_bytes("\r\n".join(out).encode())
    return str(path), out


def test_findings(spark, shop):
    path, out = shop
    r = summarize_path(spark, path)
    assert (r["format"], r["lines"], r["parsed"], r["unparseable"], r["continuation_lines"]) == ("access", len(out), len(out) - 2, 1, 0)
    assert (r["first_utc"], r["last_utc"]) == ("2029-05-03 06:00", "2029-05-03 08:10")
    assert (r["peak_per_minute"], r["peak_minute_utc"]) == (900, "2029-05-03 06:24")
    assert [s["minute_utc"] for s in r["traffic_spikes"]][0] == "2029-05-03 06:24"
    assert [(s["minute_utc"], s["count"], s["times_median"]) for s in r["error_spikes"]] == [("2029-05-03 06:50", 25, 0.0)]
    assert [(x["route"], x["requests"], x["errors"]) for x in r["error_routes"]] == [("POST /till", 25, 25)]
    assert [x["route"] for x in r["slow_routes"]] == ["POST /till", "GET /tea/:id"]
    assert r["slow_routes"][0]["p95_ms"] == pytest.approx(2500, rel=0.01)
    assert r["status_classes"] == {"2xx": 40 * 39 + 900, "3xx": 1, "4xx": 1, "5xx": 25}
    assert r["bytes"] == 10 * (40 * 39 + 900) + 6 and r["latency"]["samples"] == 40 * 39 + 900 + 26
    assert r["out_of_order"] >= 1 and r["gaps"] == 1 and r["longest_gap_seconds"] == 130 * 60 - (78 * 60 + 39)
    assert r["gap_examples"] == [{"line": len(out), "at_utc": "2029-05-03 08:10:00", "previous_utc": "2029-05-03 07:18:39"}]
    at = out.index("<<< rotated >>>") + 1
    assert r["unparseable_examples"] == [[at, "<<< rotated >>>"]]
    assert {"line": at + 2, "at_utc": "2029-05-03 06:58:01", "previous_utc": "2029-05-03 07:00:39"} in r["out_of_order_examples"]
    text = to_text(r)
    assert "POST /till" in text and "pauses over 5m 0s: 1, up to" in text and f"{at}> <<< rotated >>>" in text
    assert json.loads(to_json(r)) == r


@pytest.mark.parametrize("size", ["300", "5000", "77777"])
def test_split_sizes(spark, shop, size):
    whole = summarize_path(spark, shop[0])
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert summarize_path(spark, shop[0]) == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.fixture(scope="module")
def app(tmp_path_factory):
    lines = ["=== start ===", "", "2029-05-03T06:00:00Z info up", "  at a.b", "2029-05-03T06:00:01Z ERROR job 17 failed", "Caused by: job 18", "2029-05-03T06:00:02Z error job 19 failed", "2029-05-03T06:00:03Z PANIC out of jobs after 90s", "2029-05-03T06:00:02Z dbg x"]
    path = tmp_path_factory.mktemp("app") / "app.log"
    path.write_bytes("\n".join(lines).encode() + b"\n\xff\xfe stray\rcr\n")
    return str(path)


@pytest.mark.parametrize("size", ["134217728", "64"])
def test_application_log(spark, app, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        r = summarize_path(spark, app, top=1)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert (r["format"], r["lines"], r["parsed"], r["unparseable"], r["continuation_lines"]) == ("app", 10, 5, 1, 3)
    assert r["levels"] == {"DEBUG": 1, "ERROR": 2, "FATAL": 1, "INFO": 1} and r["top_errors"] == [["job # failed", 2]]
    assert r["unparseable_examples"] == [[1, "=== start ==="]] and r["out_of_order_examples"][0]["line"] == 9
    assert r["latency"]["samples"] == 1 and r["status_classes"] == {} and r["bytes"] == 0


def test_bad_bytes_are_replaced(spark, app):
    r = summarize_path(spark, app, fmt="access")
    assert r["parsed"] == 0 and r["unparseable_examples"][0] == [1, "=== start ==="] and r["first_utc"] is None and r["latency"] is None
    from tallylog.sources.lines import read_lines

    assert [x.value for x in read_lines(spark, app).orderBy("pos").collect()][-1] == "�� stray\rcr"


def test_files_in_order_of_their_names(spark, tmp_path):
    (tmp_path / "b.log").write_text("2029-05-03T06:00:09Z info b\n")
    (tmp_path / "a.log").write_text("2029-05-03T06:00:10Z info a\nand more")
    (tmp_path / "0.log").write_text("")
    r = summarize_path(spark, str(tmp_path))
    assert (r["lines"], r["continuation_lines"]) == (3, 1) and r["out_of_order_examples"] == [{"line": 3, "at_utc": "2029-05-03 06:00:09", "previous_utc": "2029-05-03 06:00:10"}]


def test_generated_lines_do_not_depend_on_partitions(spark):
    few, many = (sorted(map(tuple, f(spark, 500, partitions=n).collect())) for n in (1, 7) for f in (generator.access_lines,))
    assert few == many and sorted(map(tuple, generator.app_lines(spark, 50, partitions=3).collect()))[9][1].startswith("    from")


@pytest.mark.parametrize("argv", [["/no/such.log"], ["x", "--gap", "0"], ["x", "--gap", "inf"]])
def test_errors_end_with_status_2(argv, capsys):
    assert cli.main(argv) == 2 and "tallylog: " in capsys.readouterr().err


def test_command_line(spark, shop, app, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda args: spark)
    assert cli.main([shop[0], "--json", "--top", "0", "--gap", "60"]) == 0
    r = json.loads(capsys.readouterr().out)
    assert len(r["slow_routes"]) == 1 and r["gaps"] > 1
    monkeypatch.setattr(sys, "stdin", SimpleNamespace(buffer=io.BytesIO(open(app, "rb").read())))
    assert cli.main(["-", "-f", "app", "--latency-unit", "ms", "-j", "2", "--block-mib", "1"]) == 0
    assert "=== app log, 10 lines ===" in capsys.readouterr().out
    empty, prose = tmp_path / "empty.log", tmp_path / "prose.log"
    empty.write_text("")
    prose.write_text("nothing here\nis a log\n")
    assert cli.main([str(empty), "-f", "app"]) == 2 and "input is empty" in capsys.readouterr().err
    assert cli.main([str(prose)]) == 2 and "known format" in capsys.readouterr().err
    with pytest.raises(SystemExit) as stop:
        cli.main(["--version"])
    assert stop.value.code == 0


def test_numbers_as_text():
    assert [duration(s) for s in (0.4, 61, 7322)] == ["0s", "1m 1s", "2h 2m"]
    assert [milliseconds(v) for v in (0.04, 999.96, 61_000, None)] == ["0.0ms", "1000.0ms", "61.00s", "-"]
