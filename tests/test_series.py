"""Series, sketch, caps and streams."""

import random

import pytest

from tallylog.operators import counting, folding, series, sketch


def stats(spark, rows):
    return series.traffic(spark.createDataFrame(rows, "minute long, n long"), "n").first()


def test_series(spark):
    r = stats(spark, [(100, 4), (101, 9), (104, 4)])  # 0, 0, 4, 4, 9
    assert (r.median, r.mad, r.peak, r.peak_minute, r.minutes) == (4.0, 4.0, 9, 101, 5)
    r = stats(spark, [(5, 0), (9, 0)])
    assert (r.peak, r.peak_minute) == (0, None)
    assert stats(spark, []).minutes == 0


@pytest.mark.parametrize("span, fits", [(5_000_000, True), (5_000_001, False)])
def test_longest_span(spark, span, fits):
    r = stats(spark, [(7, 3), (7 + span, 8)])
    assert (r.peak, r.minutes) == ((8, span + 1) if fits else (0, 0))
    found = series.spikes(spark.createDataFrame([(7, 3), (7 + span, 8)], "minute long, n long"), "n").collect()
    assert [x.minute for x in found] == ([7 + span] if fits else [])


def test_spikes_are_ordered(spark):
    rows = [(k, 10) for k in range(50)] + [(60, 90), (55, 90), (70, 200), (80, 21)]
    found = series.spikes(spark.createDataFrame(rows, "minute long, n long"), "n", n=3).collect()
    assert [(x.minute, x["count"], x.times_median) for x in found] == [(70, 200, 20.0), (55, 90, 9.0), (60, 90, 9.0)]


def test_sketch_is_within_two_percent(spark):
    draw = random.Random(4)
    values = [draw.paretovariate(1.1) / 1000 for _ in range(50_000)]
    odd = [None, -1.0, float("nan"), float("inf")]
    rows = spark.createDataFrame([(k % 2, v) for k, v in enumerate(values + odd)], "part int, v double")
    qs = {"p50": 0.5, "p95": 0.95, "p999": 0.999}
    whole = sketch.quantiles(sketch.sketch(rows, "v"), qs).first()
    parts = sketch.quantiles(sketch.merged(sketch.sketch(rows, "v", ["part"])), qs).first()
    assert whole == parts and whole.samples == len(values) and whole.top == max(values)
    for name, q in qs.items():
        assert whole[name] == pytest.approx(sorted(values)[int(q * len(values)) - 1], rel=0.02)


def test_sketch_of_zeros_and_routes_without_times(spark):
    rows = spark.createDataFrame([("a", False, 0.0)] * 25 + [("b", True, None)] * 30, "route string, is_error boolean, latency_s double")
    routes = sketch.route_sketch(rows)
    assert [(r.route, r.requests, r.errors, r.p95) for r in sketch.slow_routes(routes).collect()] == [("a", 25, 0, 0.0)]
    assert routes.filter("bucket IS NULL").first().n == 30


def test_capped_keys(spark):
    counts = spark.createDataFrame([("x", 5), ("y", 5), ("w", 1), ("v", 2)], "message string, n long")
    got = {r.message: r.n for r in counting.capped(counts, "message", "n", 2).collect()}
    assert got == {"x": 5, "y": 5, "(other)": 3}
    assert counting.capped(counts, "message", "n", 9).count() == 4


@pytest.mark.parametrize("parts", [2, 4096])
def test_values_at_ranks(spark, monkeypatch, parts):
    monkeypatch.setattr(series, "PARTS", parts)
    draw = random.Random(6)
    own = {"a": [draw.randrange(1 << draw.randrange(1, 62)) for _ in range(301)], "b": [7] * 50 + [0], "c": [(1 << 62) + k for k in range(40)]}
    rows = [(name, v, 1) for name, vs in own.items() for v in vs] + [("b", 9, 30)]
    own["b"] += [9] * 30
    ranks = {name: sorted({0, len(vs) // 3, len(vs) // 2, len(vs) - 1}) for name, vs in own.items()}
    got = series.ranked(spark.createDataFrame(rows, "series string, v long, w long"), ranks)
    assert got == {name: [sorted(vs)[k] for k in ranks[name]] for name, vs in own.items()}


def test_what_stands_before_blocks(spark):
    rows = [(f, b, 1 + b % 7, None if b % 3 else b, b == 40) for f in ("a", "b", "c") for b in range(0, 100, 10)]
    df = spark.createDataFrame(rows, "file string, block long, lines long, tail long, some boolean").repartition(5)
    got = {(r.file, r.block): (r.offset or 0, bool(r.seen), r.prev) for r in folding.before(df, {"offset": ("sum", "lines"), "seen": ("any", "some"), "prev": ("last", "tail")}, 35).collect()}
    lines, seen, prev = 0, False, None
    for f, b, n, tail, some in rows:
        assert got[f, b] == (lines, seen, prev)
        lines, seen, prev = lines + n, seen or some, prev if tail is None else tail
