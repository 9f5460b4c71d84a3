"""Main text of pages: the reader of blocks, the labeller on the table's own markup, and on layouts it has not seen."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest

import __spark_entry__ as entry
from spreadrank.llm import main_text
from spreadrank.llm.html_blocks import blocks_of, path_slot

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF_DIR}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return main_text.learn(pages)


def texts(html):
    return [b.text for b in blocks_of(html)]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("", []),
        ("plain", ["plain"]),
        ("<p>a<p>b <b>c</b>d<br>e", ["a", "b cd e"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<p>x &amp; y&nbsp;&lt;z&#x41;&copy; \n\t w</p>", ["x & y <zA© w"]),
        ("1 < 2 <3 a<b>c", ["1 < 2 <3 ac"]),
        ("a<script>x</p><p>y</script>b<style>p{}</style><title>t</title>c", ["a", "b", "c"]),
        ("a<script>never closed <p>b", ["a"]),
        ("a<!-- <p>b</p> -->c<!-- open", ["ac"]),
        ("a<svg><g><text>b</text></g></svg>c<noscript>d</noscript>", ["a", "c"]),
        ('<p title="a > b">c</p><p title=\'"\'>d</p>', ["c", "d"]),
        ('<p class="x>a<p>b', ["a", "b"]),
        ("</div></p>a</span>b<unknown>c", ["ab", "c"]),
        ("a<p", ["a"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ],
)
def test_blocks(html, expected):
    assert texts(html) == expected


def test_paths_of_blocks():
    (block,) = blocks_of('<div id="siteFooter"><ul class="a b-c"><li><a href=x>go</a> on</ul></div>')
    names = ["<div", "site", "footer", "<ul", "a", "b", "c", "<li", "leaf li"]
    assert block.path == {path_slot(n) for n in names} and block.link_chars == 2
    after = blocks_of("<nav>a</nav><p>b")[1]
    assert path_slot("<nav") not in after.path


class Article(HTMLParser):
    """The text inside the article element, blocks by their tags."""

    def __init__(self):
        super().__init__()
        self.inside, self.pieces = False, []

    def handle_starttag(self, tag, attributes):
        self.inside = self.inside or tag == "article"
        if tag not in ("b", "i", "a"):
            self.pieces.append(" ")

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag not in ("b", "i", "a"):
            self.pieces.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.pieces.append(data)


def test_the_query_gives_the_articles(spark, pages):
    made = {r.page_id: r for r in entry.queries()["op13_main_text"](spark, SF_DIR).collect()}
    rows = pages.collect()
    assert len(made) == len(rows)
    for r in rows:
        reader = Article()
        reader.feed(r.html)
        expected = " ".join("".join(reader.pieces).split())
        assert (made[r.page_id].text, made[r.page_id].n_chars) == (expected, len(expected))


def test_layouts_it_has_not_seen(model, pages):
    html = [r.html for r in pages.collect()]
    held_out = main_text.training_pages(html[:100], 300, seed=99)
    labels = model.labels([p for p, _ in held_out])
    wrong = sum(int((a != b).sum()) for a, (_, b) in zip(labels, held_out))
    assert wrong <= 0.01 * sum(len(b) for _, b in held_out)


def test_a_page_with_everything(spark, model):
    prose = "The river had risen during the night, and by morning the lower meadows lay under water. " * 3
    html = f"""<html><head><title>t</title><style>p{{}}</style></head><body>
    <header class="site-header"><div class="logo">The Paper</div></header>
    <nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav>
    <div class="cookie-notice"><p>{prose}</p><button>Accept</button></div>
    <div class="wrapper"><div class="content"><h1>The flood &amp; after</h1><p>{prose}</p>
    <div class="ad"><p>{prose}</p></div><p>Short.</p><h2>Later</h2><p>{prose}</p></div>
    <aside class="sidebar"><h3>Related</h3><p>{prose}</p><ul><li><a href=x>More</a></li></ul></aside>
    <section id="comments"><h3>Comments</h3><div class="comment"><p>{prose}</p></div><div class="comment"><p>{prose}</p></div>
    <form><label>Name</label><input><button>Send</button></form></section></div>
    <footer>&copy; The Paper. {prose}</footer></body></html>"""
    rows = [(1, html), (1, html), (None, html), (2, None), (3, ""), (4, "<p>"), (5, "<nav><a href=x>Home</a></nav>")]
    df = spark.createDataFrame([(*r, "u", 7) for r in rows], "page_id long, html string, text string, n_chars int")
    kept = prose.strip()
    expected = f"The flood & after {kept} Short. Later {kept}"
    made = main_text.main_texts(df, model, ["page_id", "text", "n_chars"]).collect()
    assert made[0].asDict().keys() == {"page_id", "text", "n_chars", "text_", "n_chars_"}
    found = Counter((r.page_id, r.text_, r.n_chars_) for r in made)
    assert found[1, expected, len(expected)] == 2 and found[None, expected, len(expected)] == 1
    assert all(found[i, "", 0] == 1 for i in (2, 3, 4, 5))


def test_long_pages_are_read_whole(model):
    n = 30_000
    html = "<nav><ul><li><a href=x>Home</a></ul></nav><article>" + "".join(f"<p>Sentence number {i}, as it is." for i in range(n)) + "</article><footer>&copy; me</footer>"
    blocks = blocks_of(html)
    (labels,) = model.labels([main_text.Encoded(blocks)])
    assert len(blocks) == n + 2 and labels[1:-1].mean() > 0.999 and not labels[0] and not labels[-1]


def test_empty_tables_and_tables_without_articles(spark):
    schema = "page_id long, url string, html string"
    assert main_text.extract_main_text(spark.createDataFrame([], schema), ["page_id"]).count() == 0
    odd = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>x")], schema)
    made = main_text.extract_main_text(odd, ["page_id"], drawn=20, rounds=1).collect()
    assert sorted(r.page_id for r in made) == [1, 2, 3]


def test_gradients_are_those_of_the_loss():
    drawn = main_text.training_pages([], 3, seed=1)
    pages, labels = [p for p, _ in drawn], [y for _, y in drawn]
    own = main_text.Labeller(0)
    grads, _ = own.gradients(pages, labels)
    own.weights = {k: w.astype(np.float64) for k, w in own.weights.items()}
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        losses = []
        for step in (1e-3, -2e-3):
            own.weights[name][at] += step
            losses.append(own.gradients(pages, labels)[1])
        own.weights[name][at] += 1e-3
        assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(float(g[at]), rel=0.02, abs=1e-4)
