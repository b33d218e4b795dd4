"""The operators against brute force, and their methods on inputs that are hard for them."""

import gzip
import math
import random
import time
from collections import Counter
from io import BytesIO
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallylog.llm import html_text, line_dedup, mixing, ngram_lm, quality, simhash, toxicity, warc

CLASH = "doc_id long, text string, o long, h long, place int, word string, places string, row string, of long"


def prose(draw, n, words=400):
    return " ".join(f"w{int(words * draw.random() ** 2)}" for _ in range(n))


# --- 1: mixing ----------------------------------------------------------------------------------


def test_targets_by_resharing_step_by_step(spark):
    """The excess over three times a source's size goes to the others by weight until none is above."""
    draw = random.Random(2)
    sizes = {"a": 900, "b": 3, "c": 40, "d": 600, None: 7}
    rows = [(k, prose(draw, n), s) for k, (s, n) in enumerate(x for s, m in sizes.items() for x in [(s, m - m // 2), (s, m // 2)])]
    got = {r.source: r.target for r in mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).join(spark.createDataFrame([(k, s) for k, _, s in rows], "doc_id long, source string"), "doc_id").collect()}
    weight = {s: k % 3 + 1 for k, s in enumerate(["a", "b", "c", "d", None])}
    target, free = dict.fromkeys(sizes, 0.0), set(sizes)
    rest = float(sum(sizes.values()))
    for _ in range(50):
        whole = sum(weight[s] for s in free)
        share = {s: rest * weight[s] / whole for s in free}
        over = {s for s in free if target[s] + share[s] > 3 * sizes[s]}
        rest = 0.0
        for s in list(free):
            new = min(target[s] + share[s], 3.0 * sizes[s])
            rest += target[s] + share[s] - new
            target[s] = new
        free -= over
        if rest < 1e-9 or not free:
            break
    assert got == pytest.approx(target)


# --- 2: quality ---------------------------------------------------------------------------------


def test_forest_paths_by_plain_descent():
    draw = np.random.default_rng(1)
    points = draw.normal(size=(300, 4))
    forest = quality.Forest.grown(points, points.min(axis=0) - 1, points.max(axis=0) + 3, trees=20, rows=64)

    def path(tree, x, at=0):
        nxt = int(forest.left[tree][at])
        return forest.path[tree][at] if nxt == at else path(tree, x, nxt + int(x[int(forest.feature[tree][at])] >= forest.split[tree][at]))

    tried = np.concatenate((points[:20], points.max(axis=0, keepdims=True) + 2))
    plain = [2 ** (-np.mean([path(t, x) for t in range(20)]) / forest.usual) for x in tried]
    assert forest.score(tried) == pytest.approx(plain) and plain[-1] > max(plain[:-1])


def test_forest_rejects_what_the_rules_pass(spark):
    """Also kinds of odd texts that no labelled row shows, in ratios that good texts never vary in; ties and a long text stay."""
    draw = random.Random(3)
    good = [prose(draw, draw.randint(60, 200), 5000) for _ in range(150)] + [prose(draw, 200_000, 10**6)] + ["same words " + prose(random.Random(9), 90, 5000)] * 5
    bad = [" ".join(w + "###" for w in prose(draw, 80, 5000).split()) for _ in range(12)]
    odd = ["\n".join(["one line of words here now"] * 2 + [prose(draw, 3, 5000) for _ in range(60)] * 1 + [f"{k} |||" for k in range(40)])]
    texts = good + bad + odd + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(100)] + [(len(good) + k, 0) for k in range(6)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_report(docs, labels).collect()}
    judged = [got[k] for k in range(len(texts)) if not got[k].base_failed]
    assert any(r.kept != (not r.base_failed) for r in judged)
    assert all(got[k].kept for k in range(len(good))) and not any(got[len(good) + k].kept for k in range(13))
    assert got[len(texts) - 1].base_failed and got[len(texts) - 2].base_failed


def test_threshold_lets_single_rows_go():
    good, bad = np.zeros(101), np.zeros(101)
    good[[10, 90]] = 60, 1
    bad[[70, 95]] = 8, 2
    assert 10 <= quality.calibrated(good, bad) * quality.BINS < 70


# --- 3: html ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page",
    [
        "<table><tr><td colspan=" + "1" * 5000 + ">x<td>y</table>",
        "<a " * 50_000,
        "<a " * 50_000 + '">"',
        '<a ">x"' * 30_000,
        "<b>" * 30_000 + "</x>" * 30_000,
        "<table>" + "<tr><td rowspan=65534 colspan=1000>x" * 2000 + "</table>",
        "<ul><li>" * 300 + "x<br>" * 20_000,
        "<script>" + "</script " * 50_000,
        "&#" + "9" * 5000 + ";" * 1000,
        ("<p class='x' id=\"y\">Some <b>bold</b> words &amp; more</p>\n" * 90_000),
    ],
    ids=["colspan", "open tags", "end at last", "quotes", "stray ends", "spans", "indents", "script", "number", "5 MB"],
)
def test_hard_pages_take_seconds(page):
    began = time.time()
    assert len(html_text.visible_text(page)) <= 60 * len(page) + 100
    assert time.time() - began < 60


def test_wide_cells_are_not_padded_for():
    page = "<table><tr><td>" + "word " * 4000 + "<td>b" + "<tr><td>a<td>c" * 2000 + "</table>"
    text = html_text.visible_text(page)
    assert len(text) < 2 * len(page) and text.splitlines()[-1] == "a  c"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<span aria-hidden=true>a</span><i hidden>b</i><i style='DISPLAY : none'>c</i>", "a"),
        ("<svg><title>t</title><path d=x /><text>one</text><text>two</text></svg>", "one two"),
        ("<math><mi>x</mi><annotation>tex</annotation></math><span class='katex-mathml'>again</span>", "x"),
        ("<select><option>a<option>b</select> <textarea>c\n d</textarea>", "a b c\n d"),
        ("<details><summary>S</summary>inner</details><details open><summary>T</summary>more</details>", "S\nT\nmore"),
        ("a<!-- b -->c<!doctype d>e", "ace"),
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>", "A  b\n   c\nd  e"),
        ("x &lt; y &#65; &#x42; &unknown;", "x < y A B &unknown;"),
    ],
)
def test_what_is_shown(page, text):
    assert html_text.visible_text(page) == text


def test_pages_in_spark(spark):
    pages = spark.createDataFrame([(1, "<p>a", "x"), (1, "<p>a", "y"), (None, None, "z"), (2, "", None)], "page_id long, html string, text string")
    got = sorted((r.page_id or 0, r.n_chars, r.n_lines, r.text) for r in html_text.page_report(pages).collect())
    assert got == [(0, 0, 0, ""), (1, 1, 1, "a"), (1, 1, 1, "a"), (2, 0, 0, "")] and html_text.page_report(pages.limit(0)).count() == 0


# --- 4: archives --------------------------------------------------------------------------------


def test_padding_and_cut_streams():
    whole = gzip.compress(b"abc") + b"\0" * 600 + gzip.compress(b"def") + b"\0" * 9
    assert b"".join(warc.inflated(BytesIO(whole))) == b"abcdef"
    for cut in (1, 4, 8, 12):
        with pytest.raises(ValueError):
            list(warc.inflated(BytesIO(gzip.compress(b"abc" * 100)[:-cut])))


def test_archives_of_text_ids_and_long_pages(spark):
    rows = [("k1", "u", "é" * 400_000, 1), ("k2", "u", "é" * 400_000, 2), (None, None, "x", 3)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string, size int")
    got = sorted((r.page_id or "", r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_records(pages).collect())
    assert got == [("", 1, "response", None), ("k1", 800_000, "revisit", "k2"), ("k2", 800_000, "response", None)]


# --- 6: toxicity --------------------------------------------------------------------------------


def test_misspelled_stems(spark):
    """Insults that are only learned as stems match with an error, too; alike words of clean texts do not."""
    draw = random.Random(4)
    ends = ["er", "ing", "ish", "ed", "ly", "y", "ful"]
    clean = lambda: " ".join(draw.choice("river table garden yellow window grumpet carry".split()) for _ in range(25))
    rows = [(k, clean() + (f" grumbl{draw.choice(ends)}" if k % 4 == 0 else "")) for k in range(400)]
    extra = {900: clean() + " gruumbling", 901: clean() + " grmbled", 902: clean() + " grumpet", 903: clean() * 3000, 904: None, 905: clean()}
    docs = spark.createDataFrame([(k, t, "en", k) for k, t in [*rows, *extra.items(), (900, extra[900])]], "doc_id long, text string, mark string, held_out long")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id long, toxic int")
    got = [(r.doc_id, r.predicted) for r in toxicity.toxicity(docs, labels, lambda c: c < 0).collect()]
    assert len(got) == 407 and dict(got) == {k: int(k % 4 == 0) for k, _ in rows} | {900: 1, 901: 1, 902: 0, 903: 0, 904: 0, 905: 0}


def test_labels_given_twice_or_both_ways(spark):
    """Repeated labels and documents count once; who is labelled both ways is toxic; null ids and extra columns of labels don't matter."""
    draw = random.Random(6)
    clean = lambda: " ".join(draw.choice("river table garden yellow window carry".split()) for _ in range(25))
    rows = [(k, clean() + " grumbler" * (k % 4 == 0)) for k in range(200)]
    docs = spark.createDataFrame([*rows, *rows[:4] * 50, (None, None)], "doc_id long, text string")
    marks = [(k, int(k % 4 == 0), "t", 1.0) for k, _ in rows]
    labels = spark.createDataFrame([*marks, *marks[:50], *((k, 0, "u", 0.0) for k in range(0, 200, 4)), (None, 1, None, None), (7, None, None, None), (8, 9, None, None)], "doc_id long, toxic int, text string, score double")
    got = toxicity.toxicity(docs, labels, lambda c: c < 0).collect()
    assert len(got) == 401 and {(r.doc_id, r.predicted) for r in got} == {(k, int(k % 4 == 0)) for k, _ in rows} | {(None, 0)}
    again = toxicity.toxicity(docs.repartition(7), spark.createDataFrame(marks, labels.schema), lambda c: c < 0).collect()
    assert {(r.doc_id, round(r.score, 9)) for r in again} == {(r.doc_id, round(r.score, 9)) for r in got}


# --- 7: lines -----------------------------------------------------------------------------------


def brute_lines(texts):
    kept, gone = [], {}
    for i, t in texts.items():
        for k, line in enumerate((t or "").lower().split("\n")):
            s = frozenset(line.split())
            if s and any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in kept):
                gone.setdefault(i, []).append(k)
            if s:
                kept.append(s)
    return gone


@pytest.mark.parametrize("hot, few", [(3, 0), (500, 20)])
def test_lines_of_all_kinds(spark, monkeypatch, hot, few):
    """Variants of few and of many words, hot and rare ones, equal lines, white space of all kinds, one line of a megabyte."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "FEW_STEP", int(3 * math.log2(few)) + 1 if few else 1)
    draw = random.Random(7)
    base = [[f"w{int(80 * draw.random() ** 2)}" for _ in range(draw.randint(1, 25))] for _ in range(30)] + [[f"r{k}{j}" for j in range(12)] for k in range(4)]
    line = lambda: draw.choice([" ", "  ", "\t", " \x0b", "\r"]).join(w if draw.random() < 0.95 else f"w{draw.randint(0, 90)}" for w in draw.choice(base))
    texts = {k: "\n".join(line() for _ in range(5)) for k in range(40)} | {50: None, 51: "", 52: "\n \n"}
    long = " ".join(f"v{k}" for k in range(150_000))
    texts |= {60: long, 61: long + " more\nw1", 62: "x0b only"}
    docs = spark.createDataFrame([(k, t, 1, 2, 3, "a", "b", "c", 4) for k, t in texts.items()], CLASH)
    gone = brute_lines(texts)
    assert 61 in gone and sum(map(len, gone.values())) > 20
    got = {r.doc_id: r.removed_lines for r in line_dedup.line_report(docs).collect()}
    assert got == {i: ",".join(map(str, gone.get(i, []))) for i in texts}
    if few:
        shorter = line_dedup.without_repeated_lines(docs)
        want = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, [])) for i, t in texts.items()}
        assert shorter.columns == docs.columns and {r.doc_id: r.text for r in shorter.collect()} == want


def test_lines_of_repeated_rows_and_null_ids(spark):
    a, b = "one two three four five", "six seven eight nine ten"
    rows = [(None, a), (1, a + "\n" + b), (2, b), (2, b), (3, "other")]
    got = sorted((r.doc_id or 0, r.n_lines, r.removed_lines) for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 1, ""), (1, 2, "0"), (2, 1, "0"), (2, 1, "0"), (3, 1, "")]
    assert line_dedup.line_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- 8: language model --------------------------------------------------------------------------


def brute_scores(train, texts):
    """Absolute discounting with backoff to single words and one unknown word, from dictionaries."""
    lines = [["<s>", *t.lower().split(), "</s>"] for t in train]
    ones, pairs, context = Counter(w for x in lines for w in x[1:]), Counter(p for x in lines for p in zip(x, x[1:])), Counter(w for x in lines for w in x[:-1])
    rate = lambda c: float(np.clip(sum(v == 1 for v in c.values()) / (sum(v == 1 for v in c.values()) + 2 * sum(v == 2 for v in c.values())), 0.1, 0.9))
    d, d1, n = rate(pairs), rate(ones), sum(ones.values())
    kinds = Counter(u for u, _ in pairs)
    root = lambda w: (ones[w] - d1) / n if w in ones else d1 * len(ones) / n
    total = Counter({**ones, "<s>": len(lines)})

    def p(u, w):
        if u not in kinds:
            return root(w)
        back = 1 - sum(pairs[u, x] - d for x in ones if (u, x) in pairs) / total[u]
        return ((pairs[u, w] - d) / total[u] if (u, w) in pairs else 0) + back * root(w)

    scores = []
    for t in texts:
        x = ["<s>", *(t or "").lower().split(), "</s>"]
        scores.append(sum(math.log10(p(u, w)) for u, w in zip(x, x[1:])))
    return scores, p, list(ones), list(kinds)


def test_language_model_by_brute_force(spark):
    draw = random.Random(6)
    train = [prose(draw, draw.randint(1, 60), 60) for _ in range(30)] + ["Solo", "", "w1\tw2\n w3 "]
    other = [prose(draw, 40, 90), None, "unseen words only", "W1 w2 w3", train[0], "w1 " * 5000]
    docs = spark.createDataFrame(list(enumerate(train)) + [(100 + k, t) for k, t in enumerate(other)], "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_lm.scores(docs, F.col("doc_id") >= 100).collect()}
    want, p, words, states = brute_scores(train, train + other)
    ids = [*range(len(train)), *(100 + k for k in range(len(other)))]
    assert [got[k].score for k in ids] == pytest.approx(want, rel=1e-5)
    for u in [*states[:20], "nowhere"]:
        assert sum(p(u, w) for w in [*words, "<unknown>"]) == pytest.approx(1)


# --- 10: fingerprints ---------------------------------------------------------------------------


def brute_prints(texts, words, radius):
    prints = {}
    for k, t in texts.items():
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        grams = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {k: k for k in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if b < a and (prints[a] ^ prints[b]).bit_count() <= radius:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return {k: (f"{prints[k]:016x}", root[k]) for k in texts}


def test_fingerprints_and_components_by_brute_force(spark):
    """Chains of small changes, ties, copies and texts without words; tiles of all population counts."""
    draw = random.Random(8)
    texts, text = {}, [f"w{draw.randrange(10**6)}" for _ in range(120)]
    for k in range(60):  # a chain: the ends are far apart
        texts[k] = " ".join(text)
        text[draw.randrange(len(text))] = f"x{k}"
    texts |= {k: prose(draw, draw.randint(1, 80)) for k in range(100, 180)}
    texts |= {200: None, 201: " \n", 202: texts[100].upper(), 203: "a b c", 204: "A B C", 205: "w " * 20_000, 206: "w " * 30_000}
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in texts.items()] + [(206, texts[206], 1, 2)], "doc_id long, text string, fp long, node long")
    got = simhash.near_duplicates(docs, words=4, radius=4).collect()
    assert len(got) == len(texts) + 1 and {r.doc_id: (r.fingerprint, r.component_id) for r in got} == brute_prints(texts, 4, 4)


# --- pipeline -----------------------------------------------------------------------------------

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the standard tables")
def test_pipeline_stages_by_brute_force(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from test_operators import brute_copies

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(spark.createDataFrame([(10**6, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    stages = [f for _, f in corpus_pipeline.STAGES]
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    before = rows(docs)
    kept = stages[0](spark, docs, SMALL)
    judged = {r.doc_id for r in quality.quality_report(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect() if r.kept}
    assert kept.columns == docs.columns and set(rows(kept)) == judged and len(judged) < len(before)
    distinct = stages[1](spark, kept, SMALL)
    assert distinct.columns == docs.columns and set(rows(distinct)) == brute_copies(rows(kept))
    clean = stages[2](spark, distinct, SMALL)
    words = lambda t: [w for w in "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in (t or "")).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split(" ") if w]
    grams = set()
    for item in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = words(item.text)
        grams |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    lengths = {len(g) for g in grams}
    hit = lambda t: any(tuple(w[i : i + n]) in grams for w in [words(t)] for n in lengths for i in range(len(w) - n + 1))
    assert set(rows(clean)) == {k for k, t in rows(distinct).items() if not hit(t)}
    mixed = stages[3](spark, clean, SMALL)
    taken = {r.doc_id: r.taken // r.size if r.size else 0 for r in mixing.mix_report(clean).collect()}
    got = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and {k: n for k, n in taken.items() if n} == {k: n for k, n in got.items() if taken.get(k)}
    plain = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    found = stages[4](spark, mixed, SMALL).collect()
    lens = Counter((r.doc_id, len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in mixed.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in found) == lens and sorted(r.start for r in found)[0] == 0


# --- pipeline: near copies ----------------------------------------------------------------------


def test_bitmaps_of_long_texts_rule_pairs_out():
    """Sets of any two sizes: no pair that is similar is ruled out, and long ones that share half are."""
    draw = np.random.default_rng(3)
    sets, similar = [], set()
    for n in (0, 1, 5, 90, 700, 2300, 9000):
        base = draw.integers(0, 1 << 64, n, np.uint64)
        fresh = draw.integers(0, 1 << 64, n, np.uint64)
        sets += [np.unique(x) for x in (base, base[: n - n // 5], np.concatenate((base[: n - n // 10], fresh[: n // 10])), np.concatenate((base[: n // 2], fresh[n // 2 :])))]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            both = len(np.intersect1d(x, y))
            if both * 9 >= 4 * (len(x) + len(y)):
                similar.add((i, j))
    side = {f: np.zeros(len(sets), np.int64) for f in ("fp", "second", "third", "fourth")} | {"n": np.array([len(x) for x in sets]), "parity": simhash.values(pa.array([simhash.parities(x) for x in sets]))}
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    ok = simhash.possible(side, side, i, j, 0.8)
    found = {(int(a), int(b)) for a, b in zip(i[ok], j[ok], strict=True)}
    assert similar <= found
    halves = [(k, k + 3) for k in range(12, len(sets), 4)]
    assert all(len(sets[a]) >= 90 for a, _ in halves) and not found & set(halves)


def test_texts_without_near_copies_are_not_shuffled(spark):
    """Only texts that a bitmap picks are joined with those to drop; copies, repeated rows and null ids as with a broadcast."""
    draw = random.Random(9)
    rows = [(k, prose(draw, 30, 5000)) for k in range(300)]
    rows += [(1000, rows[0][1]), (None, rows[1][1]), rows[2], rows[2], (1001, None), (1002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.without_near_copies(docs)
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        got = [r.doc_id for r in kept.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert sorted(got) == [*range(300), 1001]
    assert plan.index("Union") < plan.index("LeftAnti") and "getbit" in plan[plan.index("LeftAnti") :]


def test_texts_that_share_nothing_are_not_compared(spark, monkeypatch):
    """Work grows with texts that have a shingle in common, not with all texts or pairs of them."""
    sizes, written = {}, simhash.written

    def counted(df, name):
        table = written(df, name)
        sizes[name] = max(sizes.get(name, 0), table.count())
        return table

    monkeypatch.setattr(simhash, "written", counted)
    draw = random.Random(12)
    texts = [" ".join(f"w{draw.randrange(10**9)}" for _ in range(60)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate([*texts, *(f"{t} end" for t in texts[:5])])), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.without_near_copies(docs).collect()) == list(range(400))
    assert sizes["prints"] == 405 and sizes["near-labelled"] <= 200  # ten texts in twenty blocks


@pytest.mark.parametrize("spare", [0, 3])
def test_large_blocks_by_brute_force(spark, monkeypatch, spare):
    """A passage in very many texts, texts of little else, a large group of copies and a chain of them, with blocks that are cut."""
    from test_operators import brute_copies

    for name, value in {"HOT": 12, "SPARE": spare, "PIECE": 4, "WIDE_TILE": 16}.items():
        monkeypatch.setattr(simhash, name, value)
    draw = random.Random(13)
    some = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    passage, base, chain = some(40), some(120), some(100)
    texts = [some(20) + passage + some(20) for _ in range(90)] + [passage + some(draw.randint(0, 9)) for _ in range(60)]
    for _ in range(70):
        copy = list(base)
        copy[draw.randrange(len(copy))] = "x"
        texts.append(copy + some(draw.randint(0, 3)))
    for k in range(60):
        texts.append(list(chain))
        chain[draw.randrange(len(chain))] = f"x{k}"
    texts = dict(enumerate([*map(" ".join, texts), "", " \n", "\t", "a b", "A b"]))
    kept = simhash.without_near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == brute_copies(texts)


def test_rows_of_one_key_meet(monkeypatch):
    monkeypatch.setattr(simhash, "MET", 7)
    draw = np.random.default_rng(4)
    for n, m in ((0, 0), (0, 3), (1, 1), (30, 40), (50, 3)):
        x, y = np.sort(draw.integers(0, 6, n)), np.sort(draw.integers(0, 6, m))
        for a, b, same in ((x, y, False), (x, x, True)):
            got = [(int(i), int(j)) for us, vs in simhash.together(a, b, same) for i, j in zip(us, vs, strict=True)]
            assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j] and (i < j or not same)}


def test_similar_texts_differ_in_few_orders():
    """Sets at Jaccard 0.8 of all sizes: the share of orders with the same smallest shingle is 0.8."""
    draw = np.random.default_rng(5)
    for n in (8, 80, 800):
        alike = []
        for _ in range(60):
            each = draw.integers(0, 1 << 64, n + n // 4, np.uint64)
            alike.append(np.mean(np.array(simhash.smallest(each[:n])) == simhash.smallest(each)))
        assert abs(np.mean(alike) - 0.8) < 0.06
    assert simhash.smallest(each[:0]) == simhash.smallest(draw.integers(0, 1 << 64, 0, np.uint64))
