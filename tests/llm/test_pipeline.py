"""The whole pipeline on small tables, and page ids of any characters in archives."""

import random

import pytest

import corpus_pipeline
from tallylog.llm import warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, kept boolean, label string, size int"
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"


def tables(spark, folder, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], int(k % 7 > 0), 0) for k, r in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)] if rows else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_whole_pipeline(spark, tmp_path):
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 8))) for _ in range(3000)]
    prose = [" ".join(draw.choice(words) for _ in range(120)) for _ in range(24)]
    texts = [*prose, prose[3], prose[4] + " end", f"{prose[5][:300]} {PASSAGE} {' '.join(reversed(prose[6].split()))}", None, "", "few words", " ".join(words * 10)]
    rows = [(k, t, "en", None if k % 6 == 0 else f"s{k % 3}", 1, "n", True, "l", 2) for k, t in enumerate(texts)]
    rows += [rows[7], (None, " ".join(reversed(prose[9].split())), "en", "s1", 1, "n", True, "l", 2)]
    got = corpus_pipeline.run(spark, tables(spark, tmp_path, rows)).collect()
    ids = {r.doc_id for r in got}
    assert not ids & {24, 25, 26, 27, 28, 29}  # copies, a benchmark passage, and texts that the rules reject
    assert ids <= {*range(24), 30, None} and len(ids) >= 15
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens > 1
        at += r.n_tokens


def test_pipeline_of_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [])).count() == 0


def test_page_ids_come_back(spark):
    ids = ["None", "a>\r\nb", "é 😀%3E", "", "<urn:page:x>", None, "z"]
    html = "<p>" + "text " * 300
    pages = spark.createDataFrame([(i, "http://h/", html if i in ("é 😀%3E", "z", None) else "short") for i in ids], "page_id string, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.page_records(pages).collect()}
    # The largest id in the order of code points is the response.
    assert got == {i: ("response", None) for i in ids} | {"z": ("revisit", "é 😀%3E")}


@pytest.mark.parametrize("name", [None, "None", "a b"])
def test_names_of_pages(name):
    assert warc.page_of(warc.page_urn(name, "0" * 40)) == name
