"""Top-k search, lexical search and spelling variants against brute force, on awkward rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallylog.llm import lexical_search, spelling, topk_search

# --- inner products ---------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, norm double"


def vectors(n: int, spread: float, seed: int = 1):
    draw = random.Random(seed)
    rows = [(k, [draw.gauss(0, spread) for _ in range(40)]) for k in range(n)]
    rows += [(n + k, rows[7][1]) for k in range(30)]  # ties of a common vector
    rows += [(None, rows[3][1]), (40, rows[41][1]), (rows[20][0], rows[20][1])]
    rows += [(n + 40, None), (n + 60, [1.0, None]), (n + 80, [float("nan")] * 40), (n + 100, [float("inf")]), (n + 120, []), (n + 140, [2.0] * 5), (n + 160, [0.5] * 45)]
    return [(i, v, 1, 2, "x", 0.5) for i, v in rows]


def best_pairs(rows, k: int):
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q is None or q % 20:
            continue
        found = [(-max(min(sum(x * y for x, y in zip(a, b, strict=False)), (1 << 63) - 1), -(1 << 63)), i is None, i or 0) for i, b in good if i != q]
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(map(str, out))


@pytest.mark.parametrize(("spread", "tile", "asked"), [(0.2, 4096, 256), (0.2, 16, 3), (300.0, 64, 8), (1e7, 64, 8), (1e12, 64, 8)])
def test_top_scores(spark, monkeypatch, spread, tile, asked):
    monkeypatch.setattr(topk_search, "TILE", tile)
    monkeypatch.setattr(topk_search, "QUERIES", asked)
    rows = vectors(150, spread)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = topk_search.top_scores(df, df.vec_id % 20 == 0, 20)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == best_pairs(rows, 20)


def test_top_scores_of_little(spark):
    none = spark.createDataFrame([], VECTORS)
    assert topk_search.top_scores(none, none.vec_id % 20 == 0).count() == 0
    one = spark.createDataFrame(vectors(50, 1.0)[:1], VECTORS)
    assert topk_search.top_scores(one, one.vec_id % 20 == 0).count() == 0


def test_bound_drops_candidates(monkeypatch):
    """With one direction far ahead, most of a tile is dropped after the first block, and nothing that belongs to the best."""
    monkeypatch.setattr(topk_search, "BLOCK", 4)
    draw = np.random.default_rng(5)
    cells = np.floor(draw.normal(0, 3, (40, 3000)))
    cells[:4] *= 40
    whole = topk_search.Tile(np.arange(3000), np.zeros(3000, bool), cells)
    asked = topk_search.Tile(np.arange(5000, 5010), np.zeros(10, bool), cells[:, :10])
    best = topk_search.Best(asked, 20)
    for part in np.split(np.arange(3000), 10):
        topk_search.offer(best, topk_search.Tile(part, np.zeros(len(part), bool), cells[:, part]))
    got = best.result()
    scores = asked.cells.T @ whole.cells
    for q in range(10):
        own = [r for r in got.to_pylist() if r["query_id"] == 5000 + q]
        assert [r["vec_id"] for r in own] == np.lexsort((np.arange(3000), -scores[q]))[:20].tolist()


# --- lexical search ---------------------------------------------------------------------------------

TEXTS = "doc_id long, text string, item_id long, score long, item long, words string, rank int"
ITEMS = "item_id long, text string, docs long, terms string"


def texts():
    draw = random.Random(4)
    word = lambda: draw.choice(["a", "to", "Été", "naïve", "x1", "data", "DATA", "spark", "é", "日本"]) if draw.random() < 0.6 else "w" + str(draw.randint(0, 300))
    rows = [(k, " ".join(word() + draw.choice(["", ",", ".", "_b"]) for _ in range(draw.choice([1, 5, 60, 400])))) for k in range(240)]
    rows += [(500, None), (501, ""), (502, " .,; "), (503, "Data " * 60_000), (None, "data spark"), (None, rows[5][1]), rows[6], rows[7], (504, "data")]
    return rows


def ranked_plainly(docs, items, k: int):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "", flags=0)
    low = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
    counts = [(i, Counter(terms(low(t)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_words = len(counts), sum(c.total() for _, c in counts)
    out = []
    for item_id, text in items:
        found = []
        for i, c in counts:
            m = 100 - 25 + 25 * c.total() * n_docs // n_words
            s = 0
            for t, times in Counter(terms(low(text))).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in d for _, d in counts) + 1)))
                    s += times * w * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item_id, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(map(str, out))


@pytest.mark.parametrize(("docs_each", "terms"), [(32_768, 1 << 20), (64, 40)])
def test_ranked(spark, monkeypatch, docs_each, terms):
    monkeypatch.setattr(lexical_search, "TERMS", terms)
    docs = texts()
    items = [(1, "data spark data"), (2, "É naïve été ÉTÉ w5 w6"), (None, "to to to a"), (1, "data spark data"), (3, None), (4, ""), (5, "unknown"), (6, "w1 w2 w3 w4 日本 é x1")]
    a = spark.createDataFrame([(i, t, 1, 2, 3, "w", 4) for i, t in docs], TEXTS).repartition(3 if docs_each > 64 else 9)
    b = spark.createDataFrame([(i, t, 1, "t") for i, t in items], ITEMS)
    got = lexical_search.ranked(a, b)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == ranked_plainly(docs, items, 20)
    assert lexical_search.ranked(a.limit(0), b).count() == lexical_search.ranked(a, b.limit(0)).count() == 0


def test_digits_add_up():
    draw = np.random.default_rng(2)
    total = np.zeros((40, 20), np.uint64)
    plain = np.zeros(1280, np.int64)
    for _ in range(30):
        places = np.sort(draw.choice(1280, draw.integers(1, 900), replace=False))
        values, shift = draw.integers(0, 1 << 30, len(places)), int(draw.integers(0, 4))
        plain[places] += values << shift
        lexical_search.add(total, lexical_search.Impacts(places, values), shift)
    for k in (1, 20, 1280):
        places, scores = lexical_search.best(total, k, np.arange(1280)[::-1].copy(), np.zeros(1280, bool))
        want = np.lexsort((-np.arange(1280), -plain))[:k]
        assert sorted(places.tolist()) == sorted(p for p in want.tolist() if plain[p]) and (scores == plain[places]).all()


# --- spelling ---------------------------------------------------------------------------------------


def near(u: str, v: str) -> bool:
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def words_of(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            out[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def variants_plainly(docs):
    words, out = words_of(docs), []
    form = {}
    for w, n in words.items():
        others = sorted((-words[v], v) for v in words if near(w, v))
        form[w] = others[0][1] if others and -others[0][0] >= 10 * n else None
        out.append((w, len(others), n))
    root = lambda w: root(form[w]) if form[w] else w
    return sorted(str((w, form[w], root(w), n, k, form[w] and words[form[w]])) for w, k, n in out)


def spelled(n: int = 60):
    draw = random.Random(8)
    base = ["".join(draw.choice("abcdeñé") for _ in range(draw.randint(7, 12))) for _ in range(40)] + ["information", "Informations", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa"]

    def word():
        w = draw.choice(base[:6] if draw.random() < 0.7 else base)
        if draw.random() < 0.12:
            at = draw.randrange(len(w))
            w = draw.choice([w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "y" + w[at + 1 :]])
        return draw.choice([w, w.upper(), w.title()])

    rows = [(k, " ".join(word() for _ in range(200))) for k in range(n)]
    return [*rows, (None, rows[3][1]), rows[4], (900, None), (901, ""), (902, "ß123Àéîõü-÷× 日本語の長い文字"), (903, "averylongword" * 3000 + " " + "averylongword" * 3000)]


@pytest.mark.parametrize("crowd", [50_000, 3])
def test_variants(spark, monkeypatch, crowd):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    docs = spelled()
    df = spark.createDataFrame([(i, t, "w", 1, "r", "h") for i, t in docs], "doc_id long, text string, word string, n long, run string, half string")
    got = spelling.variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = sorted(str((r.word, r.form, r.root, r.n, r.n_near, r.form_n)) for r in got.collect())
    assert rows == variants_plainly(docs)
    assert spelling.variants(df.limit(0)).count() == 0


def test_automaton():
    draw = random.Random(1)
    words = sorted({"".join(draw.choice("abé") for _ in range(draw.randint(1, 8))) for _ in range(900)})
    auto = spelling.Automaton(words)
    # As few states as there are different sets of endings.
    endings = {}
    for w in words:
        for k in range(len(w) + 1):
            endings.setdefault(w[:k], set()).add(w[k:])
    assert len(auto.end) == len({frozenset(x) for x in endings.values()})
    for k, w in enumerate(words):
        state, number = auto.start, 0
        for c in w:
            arc, there = auto.step(np.array([state]), np.array([ord(c)]))
            assert there[0]
            state, number = int(auto.target[arc[0]]), number + int(auto.adds[arc[0]])
        assert auto.end[state] and number == k
    assert not len(spelling.Automaton([]).near(np.zeros((2, 3), np.int64), 3, 1)[0])
