"""Times, keys, levels and durations, and the line parsers, on vectors of their own."""

import calendar

import pytest
from pyspark.sql import functions as F

from tallylog.functions import times, words
from tallylog.operators import parsers
from tallylog.operators.parsers import LogFormat

BASE = calendar.timegm((2031, 3, 7, 4, 5, 6)) * 1000


def applied(spark, f, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in rows.select(f(F.col("v")).alias("x"), "k").orderBy("k").collect()]


TAILS = [("", 0), (" +0000", 0), (" Z", 0), (" +0545", -345), (" -09:30", 570), (" +14", -840), ("+0545", 0), (".25 +0100", 0), (" +0100 and more", -60)]


def test_bracketed_times(spark):
    assert applied(spark, times.clf_ms, ["07/MAR/2031:04:05:06" + tail for tail, _ in TAILS]) == [BASE + minutes * 60_000 for _, minutes in TAILS]


def test_bracketed_times_that_are_none(spark):
    wrong = ["07/Mrz/2031:04:05:06", "30/Feb/2031:04:05:06", "07/Mar/2031:24:05:06", "07/Mar/2031:04:60:06", "07/Mar/2031:04:05:61", "07/Mar/2031:04:05:06 +1500", "07/Mar/2031:04:05:06 CET", "7/Mar/2031:04:05:06", "", None]
    assert applied(spark, times.clf_ms, wrong) == [None] * len(wrong)


ISO = [
        ("2031-03-07T04:05:06", 0, 19),
        ("2031-03-07 04:05:06Z tail", 0, 20),
        ("2031-03-07t04:05:06.7", 700, 21),
        ("2031-03-07T04:05:06,04567-0130", 45 + 90 * 60_000, 30),
        ("2031-03-07T04:05:06+0260", 0, 19),
        ("2031-03-07T04:05:06+02:60", 0, 19),
        ("2031-03-07T04:05:06 +02:00", 0, 19),
        ("2031-03-07T04:05:60Z", 54_000, 20),
        ("2031-03-07T04:05:06.Z", None, None),
        ("2031-13-07T04:05:06", None, None),
        ("on 2031-03-07T04:05:06", None, None),
]


def test_iso_prefixes(spark):
    found = applied(spark, times.iso_prefix, [text for text, _, _ in ISO])
    assert [(x.ms, x.used) for x in found] == [(None if ms is None else BASE + ms, used) for _, ms, used in ISO]


def test_labels_before_the_epoch(spark):
    row = spark.range(1).select(times.utc_text(F.lit(-1)).alias("t"), times.minute_of(F.lit(-1)).alias("m"), times.minute_label(F.lit(-1)).alias("l")).first()
    assert tuple(row) == ("1969-12-31 23:59:59", -1, "1969-12-31 23:59")


def test_labels_of_years_beyond_four_digits(spark):
    found = [(253_402_300_799_000, "9999-12-31 23:59:59"), (253_402_300_800_000, "10000-01-01 00:00:00"), (777_000_000_000_000, "26592-02-24 13:20:00"), (-62_167_219_201_000, "-001-12-31 23:59:59"), (None, None)]
    rows = spark.createDataFrame([(ms,) for ms, _ in found], "ms long").select(times.utc_text(F.col("ms")), times.minute_label(times.minute_of(F.col("ms")))).collect()
    assert [tuple(r) for r in rows] == [(text, text and text[:-3]) for _, text in found]


ROUTES = [
        ("/wiki/Tea", "/wiki/Tea"),
        ("/wiki/7/rev/0099", "/wiki/:id/rev/:id"),
        ("/blob/c0ffee00-aa/raw#L5", "/blob/:id/raw"),
        ("/c0ffee/x", "/c0ffee/x"),
        ("/--------/", "/:id/"),
        ("?only=query", "(none)"),
        ("//5//6", "//:id//:id"),
        ("5x/x5", "5x/x5"),
]


def test_routes(spark):
    assert applied(spark, words.route, [path for path, _ in ROUTES]) == [key for _, key in ROUTES]


def test_message_keys(spark):
    long = "é" * 158 + "12345"
    assert applied(spark, words.message_key, ["disk 0 at 97.5%", long, ""]) == ["disk # at #.#%", "é" * 158 + "#", ""]


DURATIONS = [
        ("flushed 9 pages in 41 ms", 0.041),
        ("slept 1.5s, then 20ms", 1.5),
        ("v2ms is no time, 3s is", 3.0),
        ("from 192.0.2.7 in 8ms", None),
        ("8 sheep", None),
        ("7msx 6 s", 6.0),
        (".5ms", None),
        ("done", None),
]


def test_durations(spark):
    found = applied(spark, words.message_seconds, [message for message, _ in DURATIONS])
    assert found == [pytest.approx(seconds) if seconds else None for _, seconds in DURATIONS]


def access(spark, lines, scale=1.0):
    rows = spark.createDataFrame(list(enumerate(lines)), "k int, value string")
    return [r.rec for r in parsers.access_fields(rows, scale=scale).orderBy("k").collect()]


ACCESS = [
        ('"PUT /a/b HTTP/1.1" 201 17 "-" "ua" 0.75', ("PUT", "/a/b", 201, 17, 0.75)),
        ('   "HEAD * HTTP/1.0" +304 -', ("HEAD", "*", 304, 0, None)),
        ('"GET  /two-blanks" 200 1', ("GET", "", 200, 1, None)),
        ('"" 400 0', ("", "", 400, 0, None)),
        ('"GET / X" 200 1 "http://h/?start=9" "ua" 0.5', ("GET", "/", 200, 1, 9.0)),
        ('"GET / X" 200 1 "-" "ua" rt=1.2.3 0.5', ("GET", "/", 200, 1, None)),
        ('"GET / X" 200 1 "-" "ua" rt=2 request_time=3', ("GET", "/", 200, 1, 3.0)),
        ('"GET / X" 200 1 "-" "ua" 0.5 ', ("GET", "/", 200, 1, None)),
        ('"GET / X" 200 77', ("GET", "/", 200, 77, None)),
        ('"GET / X" 200 18446744073709551615', ("GET", "/", 200, (1 << 64) - 1, None)),
        ('"GET / X" +00200 +0007\t"a b"', ("GET", "/", 200, 7, None)),
        ('"GET" 200 0', ("GET", "", 200, 0, None)),
]


def test_access_lines(spark):
    found = access(spark, [f"host - - [07/Mar/2031:04:05:06 +0000] {rest}" for rest, _ in ACCESS])
    assert {r.ts_ms for r in found} == {BASE} and [(r.method, r.path, r.status, r.bytes, r.latency_s) for r in found] == [x for _, x in ACCESS]


NO_ACCESS = ["", "no brackets", '[::7] - - [07/Mar/2031:04:05:06] "GET / X" 200 1', 'h [07/Mar/2031:04:05:06] GET 200 1', 'h [07/Mar/2031:04:05:06] "GET /" 99 1', 'h [07/Mar/2031:04:05:06] "GET /" 600 1', 'h [07/Mar/2031:04:05:06] "GET /" 200 x', 'h [07/Mar/2031:04:05:06] "GET /" 200 18446744073709551616', 'h [07/Mar/2031:04:05:06] "GET /" 200 100000000000000000000']


def test_lines_that_are_no_access_lines(spark):
    assert access(spark, NO_ACCESS) == [None] * len(NO_ACCESS)


def test_latency_units(spark):
    line = 'h [07/Mar/2031:04:05:06] "GET /" 200 1 "-" 250'
    for unit, seconds in (("s", 250.0), ("ms", 0.25), ("us", 0.00025)):
        assert access(spark, [line], parsers.LATENCY_UNITS[unit])[0].latency_s == pytest.approx(seconds)


APP = [
        ("Z notice: pump on", ("INFO", "pump on", None)),
        (" [io-3] <SEVERE> valve stuck for 12s", ("ERROR", "valve stuck for 12s", 12.0)),
        (" a b verbose c", ("TRACE", "c", None)),
        (" a b c warn d", None),
        (" -0500 x crit late", ("FATAL", "late", None)),
        (" information only", None),
]


def test_application_lines(spark):
    rows = spark.createDataFrame([(k, "2031-03-07T04:05:06" + rest) for k, (rest, _) in enumerate(APP)], "k int, value string")
    found = parsers.app_fields(rows).withColumn("level", words.level_name(F.col("rec.level_rank"))).orderBy("k").collect()
    assert [r.rec and (r.level, r.rec.message, r.rec.latency_s) for r in found] == [x for _, x in APP]


def test_only_fields_asked_for_are_computed(spark):
    lines = spark.createDataFrame([('h [07/Mar/2031:04:05:06] "GET /" 200 1', "", 0, 0)], "value string, file string, block long, pos long")
    plan = lambda *c: parsers.parsed(lines, LogFormat.ACCESS, 1.0, c)._jdf.queryExecution().optimizedPlan().toString()
    assert "request_time" in plan("latency_s") and "request_time" not in plan("status") and ":id" not in plan("status")
