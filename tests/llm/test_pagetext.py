import html
import re
import time

import numpy as np
import pytest

from textloom.llm import pagetext
from textloom.llm.pagegen import page


def blocks(h, model=None):
    return pagetext.main_texts([h], model or pagetext.trained())[0].split("\n")


def test_generated_pages():
    """Held-out generated pages: nearly all characters right."""
    random = np.random.default_rng(99)
    wrong = total = 0
    for _ in range(150):
        h, known = page(random)
        got, want = set(blocks(h)) - {""}, {k for k, v in known.items() if v}
        wrong += sum(map(len, got ^ want))
        total += sum(map(len, want))
    assert wrong / total < 0.04


def plain(h):
    article = re.search(r"<article>(.*)</article>", h, re.S)[1]
    parts = re.split(r"</?p>|</?h1>", re.sub(r"<br>", " ", article))
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts)
    return "\n".join(x for x in parts if x)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_driver_pages(spark, size):
    df = spark.read.parquet(f"/root/testdata/{size}/pages.parquet")
    want = {r.page_id: plain(r.html) for r in df.collect()}
    got = pagetext.extract(df).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


SENTENCE = "Some readable sentence of the story, with a few commas, and then it ends."
FULL = f"""<html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body>
<div id="cookie-consent"><p>We use cookies on this site.</p><button>Accept</button></div>
<header><h1>Site name</h1><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav></header>
<main><article class="post"><h1>The &eacute;tude &amp; more</h1><p>{SENTENCE} One&nbsp;two.
 New   line.<p>{SENTENCE} Two <b>bold</b>er.<div class="ad">Buy this thing now</div><!-- note --><p>{SENTENCE} Three.</p><p>Short.</p>
<p>{SENTENCE} {SENTENCE} Four.</p></article></main>
<section id="comments"><h3>Comments</h3><ol><li class="comment"><b>Ann</b><p>I liked this story very much, thank you for it.</p></li><li class="comment"><p>Me too, it was good to read, and long.</p></li></ol></section>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=/x>Other story</a></li></ul></aside>
<form class="newsletter"><label>Your mail</label><input name=m></form>
<footer>&copy; Site, all rights reserved.</footer></body></html>"""


def test_whole_layout():
    want = ["The étude & more", f"{SENTENCE} One two. New line.", f"{SENTENCE} Two bolder.", f"{SENTENCE} Three.", "Short.", f"{SENTENCE} {SENTENCE} Four."]
    assert blocks(FULL) == want


def test_decoding_never_contradicts():
    """No node differs from an ancestor that was taken or dropped whole, and a clear vote wins."""
    trees = pagetext.Trees()
    trees.add("<article>" + "<p>text</p>" * 9 + "</article><footer>end</footer>", 0)
    c = pagetext.Columns(trees)
    odds = np.full(c.n, 3.0)
    odds[0], odds[-1], odds[4] = -1, -3, -0.4  # one paragraph alone is doubtful
    assert c.decode(odds).tolist() == [True] * 9 + [False]
    odds[4] = -9
    assert c.decode(odds).tolist() == [True] * 2 + [False] + [True] * 6 + [False]


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "<p>deep text here.</p>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "plain text, no markup"), (5, "u", deep), (6, "u", "<p title=\"x>unclosed"), (None, "u", FULL), (None, "u", FULL), (7, "u", "<article><h1>A b</h1>" + f"<p>{SENTENCE}</p>" * 20000 + "</article>"), (8, "u", "<script>" + "x" * 100000), (9, "u", "</p></div><li>x</table>&#x110000;&bogus;")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = {r.page_id: r for r in pagetext.extract(df).collect()}
    assert pagetext.extract(df).count() == len(rows)
    assert got[1].text == got[2].text == "" and got[1].n_chars == 0 and got[8].text == ""
    assert got[7].text.count("\n") == 20000
    assert got[None].text.count("\n") == 5
    assert pagetext.extract(df.where("page_id < 0")).collect() == []


def test_text_of_formulas_and_fallbacks_stays():
    h = f"""<article><h1>Title of it</h1><p>{SENTENCE} The value <math><mi>x</mi><mo>=</mo><mn>5</mn></math> holds.</p>
    <p>{SENTENCE} <svg class="i"/> After an icon.</p><p>{SENTENCE}<svg><title>icon</title><path d="M"/></svg> End.</p><title-card>{SENTENCE}</title-card>
    <p>{SENTENCE} <object>Fallback words</object> too.</p><p>{SENTENCE} <svg><path> unclosed</p><p>{SENTENCE} Last.</p></article>"""
    want = ["Title of it", f"{SENTENCE} The value x=5 holds.", f"{SENTENCE} After an icon.", f"{SENTENCE} End.", SENTENCE, f"{SENTENCE} Fallback words too.", SENTENCE, f"{SENTENCE} Last."]
    assert blocks(h) == want


def test_attributes_are_read_to_their_end():
    long = "x" * 5000
    trees = pagetext.Trees()
    trees.add(f'<div style="{long}" data-class="footer" class="sidebar">a</div><div class="sidebar">b</div>', 0)
    assert trees.groups[1] == trees.groups[2] == 1 << list(pagetext.TOKENS).index("side")


@pytest.mark.parametrize(
    "h",
    [
        "<div>" * 20000 + "</span></section></p>" * 20000,
        "<li><ul>" + "<div>" * 5000 + "<li></li>" * 20000,
        "<p " * 333000,
        '<p "' * 250001 + ">",
        "<p " + "a " * 500000 + ">x",
        "<script>" * 100000,
        "<!-- " * 200000,
        "<svg>" * 200000 + "<p>x",
    ],
)
def test_odd_markup_of_a_megabyte_is_read_in_a_moment(h):
    began = time.perf_counter()
    trees = pagetext.Trees()
    trees.add(h, 0)
    assert time.perf_counter() - began < 10


def test_query_by_brute_force(spark):
    """The query's rows are what the trees say of each page by itself."""
    from textloom.llm.queries import op10_page_text

    d = "/root/testdata/sf0.001"
    want = {r.page_id: (r.url, pagetext.main_texts([r.html], pagetext.trained())[0]) for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    assert {r.page_id: (r.url, r.text) for r in op10_page_text(spark, d).collect()} == want
