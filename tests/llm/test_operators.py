"""Each operator on awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallylog.llm import decontaminate, html_text, line_dedup, mixing, ngram_lm, quality, simhash, token_codec, toxicity, warc
from tallylog.llm.shared import scratch_path

DOCS = "doc_id long, text string, source string, size long, h long, fp long, words string, n long, label string"
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def rows():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefg") for _ in range(draw.randint(2, 6)))
    prose = [" ".join(word() for _ in range(80)) for _ in range(6)]
    texts = [None, "", " \n\t ", "one", *prose, prose[0], prose[0] + " zzz", f"x {PASSAGE.upper()}! y\n" + prose[1], "long " * 40_000, "Éa ñ 😀 \x00 <|endoftext|>", prose[2]]
    found = [(k, t, None if k % 5 == 0 else f"s{k % 3}", 1, 2, 3, "w", 4, "l") for k, t in enumerate(texts)]
    return [*found, found[5], (None, prose[3], "s1", 1, 2, 3, "w", 4, "l")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 3 > 0), int(k % 4 == 0)) for k in range(12)], "doc_id long, quality int, toxic int")


def test_mix(docs, none):
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows()) and all(0 <= r.taken <= 3 * r.size for r in got)
    by_target = {}
    for r in got:
        by_target.setdefault((r.source_size, r.target), []).append(r)
    assert sum(t for _, t in by_target) == pytest.approx(sum(s for s, _ in by_target))
    for (_, target), mine in by_target.items():
        assert abs(sum(r.taken for r in mine) - target) <= max(r.size for r in mine)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(docs).collect()))
    assert mixing.mix_report(none).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_quality(docs, labels, none):
    got = quality.quality_report(docs, labels).collect()
    assert len(got) == len(rows()) and {r.kept for r in got if r.base_failed} == {False}
    assert quality.quality_report(none, labels).count() == 0
    assert quality.good_documents(docs, labels).columns == docs.columns
    assert quality.statistics(b"a b c a b c\nx y\nx y") == (10, 10, 0, 1, 6)
    assert quality.statistics(None) == (0, 0, 0, 0, 0)


def test_html():
    page = "<head><title>no</title></head><p>One<p>Two &amp; three<ul><li>a<li>b</ul><table><tr><th>Name<th>Q<tr><td>Apple<td>3</table><b hidden>x</b>"
    assert html_text.visible_text(page) == "One\n\nTwo & three\n\n* a\n* b\n\nName   Q\nApple  3"
    assert html_text.visible_text(None) == "" == html_text.visible_text("")
    assert html_text.visible_text("a < b <3") == "a < b <3"
    assert html_text.visible_text("<div>" * 5000 + "deep") == "deep"
    assert html_text.visible_text("<table><tr><td>" * 200 + "in").strip() == "in"


def test_warc(spark):
    big = "x" * 1500
    pages = [(1, "u", big), (2, None, big), (3, "u v", None), (4, "", "small"), (5, "", "small"), (6, "é", "é" * 700), (7, "u", big)]
    got = {r.page_id: r for r in warc.page_records(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 7), 2: ("revisit", 7), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None)}
    assert got[6].payload_bytes == 1400 and got[1].payload_bytes == 1500 and got[3].payload_bytes == 0
    assert warc.page_records(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_null_ids(spark):
    """Unique and repeated large payloads of pages without an id are all stored."""
    pages = [(None, "a" * 1500), (None, "b" * 1500), (None, "b" * 1500), (None, "c" * 1500), (5, "c" * 1500), (4, "c" * 1500)]
    frame = spark.createDataFrame([(k, "u", html) for k, html in pages], "page_id long, url string, html string")
    path = scratch_path(spark, "w")
    got = warc.read_records(warc.normalize(warc.write_archives(frame, path), path), payload=True).collect()
    found = sorted((r.page_id or "", r.record_type, r.refers_to or "", r.payload[:1].decode(), r.payload_bytes) for r in got)
    assert found == [*(("", "response", "", c, 1500) for c in "abbc"), ("4", "revisit", "5", "", 1500), ("5", "response", "", "c", 1500)]


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(7, PASSAGE), (8, "one"), (9, None), (10, ""), (7, PASSAGE)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    hit = {k: (r.n_hit, r.n_items) for k, r in got.items() if r.contaminated}
    assert hit == {3: (1, 1), 12: (12, 1)}
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.uncontaminated(docs, items).count() == len(rows()) - 2


def test_toxicity(spark, none, labels):
    draw = random.Random(1)
    text = lambda k: " ".join(draw.choice("red blue green house tree river".split()) for _ in range(30)) + (" grumbler" if k % 4 == 0 else "")
    many = spark.createDataFrame([(k, text(k)) for k in range(200)] + [(900, "a grumblre here"), (901, None), (902, "")], "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(many, marks, lambda c: F.pmod(c, F.lit(3)) == 1).collect()}
    assert all(got[k].predicted == int(k % 4 == 0) for k in range(200)) and got[900].predicted == 1
    assert got[901].predicted == 0 and got[901].score == got[902].score
    assert toxicity.toxicity(none, marks, lambda c: c < 0).count() == 0
    assert toxicity.context_weight('"bad"', ["he", "said"], []) < toxicity.context_weight("bad", ["a"], ["b"])


def brute_lines(texts):
    kept, gone = [], {}
    for i, t in sorted(texts.items()):
        for k, line in enumerate((t or "").lower().split("\n")):
            s = set(line.split())
            if len(s) >= 5:
                if any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in kept):
                    gone.setdefault(i, []).append(k)
                kept.append(s)
    return gone


def test_lines(spark, none):
    draw = random.Random(5)
    base = [[f"w{draw.randint(0, 60)}" for _ in range(draw.randint(5, 30))] for _ in range(25)]
    line = lambda: " ".join(w if draw.random() < 0.97 else f"w{draw.randint(0, 90)}" for w in draw.choice(base))
    texts = {k: "\n".join(line() for _ in range(4)) for k in range(40)} | {90: None, 91: ""}
    got = {r.doc_id: r.removed_lines for r in line_dedup.line_report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    gone = brute_lines(texts)
    assert got == {i: ",".join(map(str, gone.get(i, []))) for i in texts}


def test_short_lines(spark):
    """Lines of one word or more, copies of each other in any case and order of words, against all lines before them."""
    draw = random.Random(6)
    line = lambda: " ".join(draw.choice("All all Rights rights reserved menu licence to our of".split()) for _ in range(draw.randint(0, 6)))
    texts = {k: "\n".join([line() for _ in range(3)] + ["Subscribe to our newsletter", "Home", " \t "]) for k in range(30)}
    gone, kept = {k: [] for k in texts}, []
    for i, text in texts.items():
        for k, s in enumerate(set(one.lower().split()) for one in text.split("\n")):
            if s and any(5 * len(s & o) >= 4 * len(s | o) for o in kept):
                gone[i].append(k)
            kept += [s] if s else []
    got = {r.doc_id: r.removed_lines for r in line_dedup.line_report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: ",".join(map(str, places)) for i, places in gone.items()} and all({3, 4} <= set(gone[k]) and 5 not in gone[k] for k in range(1, 30))


def test_prefixes_hold_the_rare_words(spark):
    """A word of 2 ** 17 places comes last in the order, so lines that share only that one share no indexed word."""
    texts = ["the\n" * 2**17, "the one two three four", "the five six seven eight", "one two three four five six seven eight nine"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [r for r in line_dedup.line_sets(docs, "doc_id", "text", 5).collect()]
    first, second = (set(r.prefix) for r in sets if r.n == 5)
    assert len(first) == len(second) == 3 and not first & second and line_dedup.ALONE not in first
    assert [r.prefix[0] for r in sets if r.n == 9] == [line_dedup.ALONE]  # nine occurs once


def test_keys_of_matching_lines(spark):
    """Matching lines share a key, whether their words are rare or not; lines that only share a frequent word have none in common."""
    draw = random.Random(8)
    base = [[f"w{int(60 * draw.random() ** 2)}" for _ in range(draw.randint(4, 30))] for _ in range(40)]
    lines = [" ".join(w for w in draw.choice(base) + [f"r{draw.randint(0, 200)}"] if draw.random() < 0.96) for _ in range(400)]
    sets = line_dedup.line_sets(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), "doc_id", "text", 1).collect()
    rows = [(set(lines[r.doc_id].split()), set(r.keys), set(r.prefix[:-1]) - {line_dedup.ALONE}) for r in sets]
    pairs = [(x, y) for i, x in enumerate(rows) for y in rows[:i] if x[0] != y[0]]
    match = [9 * len(x[0] & y[0]) >= 4 * (len(x[0]) + len(y[0])) for x, y in pairs]
    assert sum(match) > 100 and all(x[1] & y[1] for (x, y), m in zip(pairs, match, strict=True) if m)
    assert 2 * sum(bool(x[1] & y[1]) for x, y in pairs) < sum(bool(x[2] & y[2]) for x, y in pairs)


def test_language_model(docs, none):
    got = ngram_lm.scores(docs, F.col("doc_id") % 7 == 2).collect()
    assert len(got) == len(rows()) and all(r.n_tokens >= 1 and r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {1}
    assert ngram_lm.scores(none, F.lit(False)).count() == 0
    alone = ngram_lm.scores(docs, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens, r.score) for r in alone} == {(0, 0, 0.0)}


def test_language_model_has_pairs_seen_once(spark):
    """A held-out copy of a training text scores above the same words in another order, and all pairs seen once are counted."""
    draw = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(draw.sample(words, 200)) for _ in range(8)] + ["a b"]
    other = texts[0].split()
    draw.shuffle(other)
    rows = [(k, t) for k, t in enumerate(texts)] + [(100, texts[0]), (101, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_lm.scores(docs, F.col("doc_id") >= 100).collect()}
    assert got[100].base_score == pytest.approx(got[101].base_score) and got[100].score > got[101].score + 0.3 * 200
    plain = docs.filter("doc_id < 100").select("text")
    index = ngram_lm.Sorted.write(ngram_lm.word_counts(plain), "hash", {"hash": "<i8", "n": "<i8"}, "lm-test")
    pairs = [p for t in texts for p in zip(["<s>", *t.split()], [*t.split(), "</s>"])]
    for least in (1, 2):
        found = ngram_lm.pair_counts(plain, index, 3, least).filter("key = -1").agg(F.sum("n")).first()[0]
        assert found == sum(pairs.count(p) == 1 for p in set(pairs))


def test_rans_round_trip():
    draw = np.random.default_rng(0)
    for ids in (draw.zipf(1.3, 70_000) % 500, np.full(3000, 7), np.array([5]), np.array([], int)):
        ids = ids.astype(np.uint16)
        table = token_codec.Table(token_codec.scaled(np.bincount(np.append(ids, [1, 2]), minlength=600)))
        assert (table.decode(table.encode(ids)) == ids).all()
    block = bytearray(table.encode(np.array([1, 2, 1], np.uint16)))
    block[14] ^= 1
    with pytest.raises(ValueError):
        table.decode(bytes(block))


def test_tokens(spark, docs, none):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    name = public_tokenizers.path("word_bpe_49k.json")
    path = scratch_path(spark, "t")
    token_codec.write_tokens(docs, path, name, 49_408)
    plain, at = Tokenizer.from_file(name), 0
    got = token_codec.read_tokens(spark, path).orderBy("start").collect()
    assert sorted((r.doc_id is not None, r.doc_id) for r in got if r.doc_id is not None) == [(True, r.doc_id) for r in got if r.doc_id is not None]
    want = {}
    for doc_id, text, *_ in rows():
        want.setdefault(doc_id, []).append([*plain.encode(text or "", add_special_tokens=False).ids, 2])
    for r in got:
        assert r.start == at and r.ids in want[r.doc_id]
        at += r.n_tokens
    crc = {r.doc_id: r.ids_crc32 for r in token_codec.read_tokens(spark, path, digest=True).collect()}
    assert crc[3] == zlib.crc32(np.array(want[3][0], "<u4").tobytes())
    empty = scratch_path(spark, "t")
    token_codec.write_tokens(none, empty, name, 49_408)
    assert token_codec.read_tokens(spark, empty).count() == 0


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs, words=4).collect()
    zero = {r.doc_id for r in got if r.fingerprint == "0" * 16}
    assert zero == {0, 1, 2} and {r.component_id for r in got if r.doc_id in zero} == {0}
    assert simhash.near_duplicates(none).count() == 0


def test_near_copies(docs, none):
    kept = simhash.without_near_copies(docs)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids))
    assert 4 in ids and 10 not in ids and 11 not in ids and None not in ids
    assert simhash.without_near_copies(none).count() == 0


def brute_copies(texts, similarity=0.8):
    """The smallest ids of the groups that links of the similarity make."""
    split = {k: t.lower().split() for k, t in texts.items()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in split.items()}
    root = dict.fromkeys(texts)
    for k in sorted(texts):
        root[k] = k
        for o in sorted(texts):
            if o < k and len(sets[k] & sets[o]) >= similarity * len(sets[k] | sets[o]):
                low, high = sorted((root[k], root[o]))
                root = {x: low if r == high else r for x, r in root.items()}
    return set(root.values())


def test_near_copies_at_the_threshold(spark):
    """Pairs at Jaccard 0.80 to 0.85, of which bits of the prints differ most, and sets that repeated phrases leave alike."""
    draw, texts = random.Random(11), {}
    word = lambda: f"w{draw.randrange(10**6)}"
    for k in range(0, 300, 2):
        words, share = [word() for _ in range(draw.randint(40, 300))], draw.uniform(0.8, 0.85)
        texts[k] = " ".join(words)
        texts[k + 1] = " ".join(words + [word() for _ in range(int((len(words) - 4) * (1 / share - 1)))])
    for k in range(300, 320, 2):
        words = [word() for _ in range(1000)]
        texts[k] = " ".join(words)
        texts[k + 1] = " ".join(words + words[:10] * 200)
    kept = simhash.without_near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == brute_copies(texts) == set(range(0, 320, 2))


def test_forest_connects_what_is_near():
    near = np.zeros((4, 3), bool)
    near[0, 0] = near[1, 0] = near[1, 2] = near[3, 1] = True
    links = {(int(u), int(v)) for us, vs in simhash.forest(near, np.arange(4), np.arange(10, 13)) for u, v in zip(us, vs, strict=True)}
    assert links == {(0, 1), (0, 10), (0, 12), (3, 11)}


def test_word_encoder_equals_the_tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    name = public_tokenizers.path("word_bpe_49k.json")
    draw = random.Random(2)
    texts = ["".join(draw.choice("abXYéÉß’'.,!<|>$ \t\n9½ςあ́") for _ in range(draw.randint(0, 30))) for _ in range(2000)]
    ids, ends = token_codec.WordEncoder(name).encode(pa.array(texts), 2)
    plain, begin = Tokenizer.from_file(name), 0
    for text, end in zip(texts, ends, strict=True):
        assert ids[begin:end].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]
        begin = end
