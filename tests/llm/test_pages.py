"""Pages: implied tags, visibility, style rules and tables, partly against a plain layout of random pages."""

import random
import time

import pytest

from tallylog.llm.html_text import LINE, visible_text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<table><td>a<td>b<tr><td>c<td>d</table>", "a  b\nc  d"),
        ("<table><caption>Cap<tr><td>a<td>b</table>", "Cap\na  b"),
        ("<table>top<tr><td>a<td>b</tr>mid<tr><td>cc<td>d</table>", "top\na   b\nmid\ncc  d"),
        ("<table><tr><td>a<table><td>x<td>y</table><td>b</table>", "a     b\n\nx  y"),
        ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b><i>c</i></div>d", "b\nd"),
        ("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>", "* b"),
        ("<table style='visibility:hidden'><tr><td>a<td style='visibility:visible'>b</table>", "  b"),
        ("<div hidden><b style='visibility:visible'>a</b></div>b", "b"),
        ("<p style='backface-visibility:hidden'>a", "a"),
        ("<p style='display:none;display:block'>a<p style='display:none!important;display:block'>b", "a"),
        ("<p hidden style='display:block'>a", "a"),
        ("<style>.x{display:none}</style><p class=x>secret<p class='y'>shown", "shown"),
        ("<style>/* .y{display:none} */ #a , q{display:none}</style><p id=a>1<p id=b>2<q>3</q>", "2"),
        ("<style>p.x{display:none} p{display:block}</style><p class='z x'>a<div class=x>b</div>", "b"),
        ("<style>.x{display:none} .x{display:block}</style><p class=x>a", "a"),
        ("<style>.x{display:none!important}</style><p class=x style='display:block'>a", ""),
        ("<style>.x.y{visibility:hidden}</style><p class=x>a<p class='y x'>b<i style='visibility:visible'>c</i>", "a\n\nc"),
        ("<style>@media print{p{display:none}} @media screen{q{display:none}} b{color:red}</style><p>a<q>b</q>", "a"),
        ("<style>@media (max-width:9px){p{display:none}} div p{display:none} p:hover{display:none}</style><p>a", "a"),
        ("<style media=print>p{display:none}</style><template><style>p{display:none}</style></template><p>a", "a"),
        ("<style>p::before{content:'} q{display:none'}</style><q>a</q>", "a"),
        ("<style>div{display:none}</style><table><tr><td>a<td><div>b</div></table>", "a"),
        ("<style>q{display:none", ""),
        ("a<style>q{display:none</style><q>b</q>", "a"),
    ],
)
def test_what_is_shown_where(page, text):
    assert visible_text(page) == text


@pytest.mark.parametrize("depth", [10, 511, 512, 513, 5000])
def test_hidden_text_stays_hidden_at_any_depth(depth):
    page = "<div>" * depth + "<div hidden>no<p>no</div><ul><li>yes<li style='visibility:hidden'>no</ul>" + "</div>" * depth + "after"
    assert visible_text(page) == "* yes\n\nafter"


@pytest.mark.parametrize("rows", [8, 60, 2000])
def test_sparse_tables_keep_their_columns(rows):
    page = "<table><tr><td>" + "<td>".join(f"col{k:02}" for k in range(20)) + "<tr><td>a<td colspan=18><td>z" * rows + "</table>"
    lines = visible_text(page).split("\n")
    assert len(lines) == rows + 1 and {x.index("z") for x in lines[1:]} == {lines[0].index("col19")}


def test_columns_beyond_the_longest_line_are_not_padded_to():
    text = visible_text("<table><tr>" + "<td>" + "<td>".join(["word" * 20] * 10) + "<tr><td>a<td colspan=8>b<td>z" * 50 + "</table>")
    assert all(len(x) <= LINE for x in text.split("\n")[1:]) and text.count("z") == 50


@pytest.mark.parametrize("quotes", range(20))
def test_quotes_are_read_alike_after_any_number_of_bad_tags(quotes):
    assert visible_text("<a \">x</a>" * quotes + "<b title='1 > 2'>y</b>") == "x" * ((quotes + 1) // 2) + "y"
    assert visible_text("<a '>x" + "<p title=\"1 > 2\">y" * quotes).count("2") == 0


@pytest.mark.parametrize(
    "page",
    [
        "<p><div>" + "<span>" * 60_000 + "<hr>" * 60_000,
        "<i><td>" + "<span>" * 60_000 + "</i>" * 60_000,
        "<table><tr><td>" * 20_000,
        "<style>" + '"\\"' * 90_000,
        "<style>" + "@media screen{" * 50_000 + "</style>x",
        "<style>" + ".a.b{display:none}" * 20_000 + "</style>" + "<b class='a c'>x</b>" * 20_000,
        "<div style='visibility:hidden'>" * 50_000 + "<b style='visibility:visible'>x",
    ],
    ids=["blocks", "ends", "tables", "strings", "groups", "rules", "visibility"],
)
def test_hard_pages_end_soon(page):
    began = time.time()
    assert len(visible_text(page)) <= 60 * len(page) + 100
    assert time.time() - began < 30


def plain(blocks):
    """The layout of ("p", words), ("ul", items) and ("table", rows), said plainly."""
    out = []
    for kind, content in blocks:
        if kind == "p":
            out.append(" ".join(content))
        elif kind == "ul":
            out.append("\n".join(f"* {x}" for x in content))
        else:
            sizes = [max(len(r[c]) for r in content if c < len(r)) for c in range(max(map(len, content)))]
            out.append("\n".join("".join(x.ljust(n + 2) for x, n in zip(r, sizes, strict=False)).rstrip() for r in content))
    return "\n\n".join(out)


def marked(blocks, rng):
    """The same as HTML in which tags that may be left out are there or not, with hidden elements strewn in."""
    maybe = lambda tag: tag if rng.random() < 0.5 else ""
    hidden = lambda: rng.choice(["", "", "<b hidden>no</b>", "<i class=none>no</i>", "<!-- no -->", "<s style='visibility:hidden'>no</s>"])
    out = ["<style>.none{display:none}</style>"]
    for kind, content in blocks:
        if kind == "p":
            out.append("<p>" + "\n ".join(content) + hidden() + maybe("</p>"))
        elif kind == "ul":
            out.append("<ul>" + "".join(f"<li>{x}{hidden()}{maybe('</li>')}" for x in content) + "</ul>")
        else:
            rows = []
            for k, r in enumerate(content):
                begin = maybe("<tr>") if k == 0 else "<tr>"
                rows.append((maybe("<tbody>") if k == 0 else "") + begin + "".join(f"<{rng.choice(['td', 'th'])}>{x}{hidden()}" for x in r) + maybe("</tr>"))
            out.append("<table>" + "".join(rows) + maybe("</tbody>") + "</table>")
    return "".join(out)


def test_random_pages_against_a_plain_layout():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 8)))
    some = lambda make, most: [make() for _ in range(rng.randint(1, most))]
    for _ in range(400):
        blocks = [(kind, some(lambda: some(word, 4), 4) if kind == "table" else some(word, 6)) for kind in rng.choices(["p", "ul", "table"], k=rng.randint(1, 5))]
        page = marked(blocks, rng)
        assert visible_text(page) == plain(blocks), page
