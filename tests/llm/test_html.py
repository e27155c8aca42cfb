from __future__ import annotations

import time

import numpy as np
import pytest

from larder.llm import html

TREE = html.tree()

PARAGRAPH = "This is a long paragraph of the article with many words, enough of them to be text and nothing else at all."
CASES = [
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>Head&amp;line</h1><p>{PARAGRAPH}</p><p>Short.</p></article><footer>&copy; 2024 x</footer></body></html>", f"Head&line {PARAGRAPH} Short."),
    (f"<article><p>{PARAGRAPH}<aside>Related things</aside><p>More   &nbsp; text\n here<br>line two</article>", f"{PARAGRAPH} More text here line two"),
    (f"<article><p>{PARAGRAPH}</p><section class='comments'><p>I disagree with every single word of this, says a reader.</p></section></article>", PARAGRAPH),
    (f"<div class='ad'>Buy now</div><main><p>{PARAGRAPH}</p><form><label>Name</label><input></form></main>", PARAGRAPH),
    (f"<div id=cookie-notice><p>We use cookies on this site to make it better for you and our partners, as you know.</p></div><div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div>", f"{PARAGRAPH} {PARAGRAPH}"),
    (f"<header><a href=/>Site</a></header><article><script>var t='</p><p>no</p>';</script><!-- <p>no</p> --><p>{PARAGRAPH} 1 &lt; 2 &#233;</p></article>", f"{PARAGRAPH} 1 < 2 é"),
    (f"<article><p>{PARAGRAPH} <b>bold <i>mixed</b> tags</i> 3 < 4", f"{PARAGRAPH} bold mixed tags 3 < 4"),
    (None, ""),
    ("", ""),
    ("<p", ""),
    ("<script>never ends", ""),
]

WORDS = lambda n: " ".join(["word"] * n)
LINKS = "<ul><li><a href=/1>one</a><li><a href=/2>two more</a><li><a href=/3>three</a></ul>"
#: Pages on which links, words and neighbours decide, or whose markup is cut or odd.
HARD = [
    *((f"<article><p>{WORDS(80)}</p><p>{WORDS(n)}</p></article>{LINKS}", f"{WORDS(80)} {WORDS(n)}") for n in (1, 5, 20, 60, 67, 68, 200)),  # the last paragraph before a list of links
    *((f"<div id=cookie-notice><p>{WORDS(n)}</p></div><a href=/>OK</a><article><p>{PARAGRAPH}</p></article>", PARAGRAPH) for n in (20, 70, 150)),
    (f"<div><p>{WORDS(70)} <a href=/>cookies</a></p></div><a href=/>OK</a><article><p>{PARAGRAPH}</p></article>", PARAGRAPH),
    (f"<div class='main share-content'><article><h1>Head</h1><p>{PARAGRAPH}</p></article></div>", f"Head {PARAGRAPH}"),
    (f"<div class='main share-content'><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div>", f"{PARAGRAPH} {PARAGRAPH}"),
    (f"<div class=has-sidebar><article class=comments-open><p>{PARAGRAPH}</p></article></div>", PARAGRAPH),
    (f"<article><p>{PARAGRAPH}</p><p class=notice>{WORDS(30)}</p><p>{PARAGRAPH}</p></article>", f"{PARAGRAPH} {PARAGRAPH}"),
    (f"<article><p>{PARAGRAPH}</p></article><section id=comments><article><p>{WORDS(40)}</p></article></section>", PARAGRAPH),
    (f"<script>x = 'İ'</SCRIPT ><article><p>İ {PARAGRAPH}</p></article>", f"İ {PARAGRAPH}"),
    (f"<script>x = 'İ'</SCRIPT><style>İ</STYLE><article><p>{PARAGRAPH}</p></article>", PARAGRAPH),
    (f"<html><head><title>T</title><meta charset=utf-8><article><p>{PARAGRAPH}</p></article>", PARAGRAPH),
    (f"<html><head><title>T</title></head><body class=has-comments><p>{PARAGRAPH}</p></body></html>", PARAGRAPH),
    *((f"<article><p>{PARAGRAPH}</p><div><{tag}><option>Buy</div><p>{PARAGRAPH}</p></article>", f"{PARAGRAPH} {PARAGRAPH}") for tag in ("button", "select", "svg", "noscript")),
    *((f"<article><{tag}>Buy<p>{PARAGRAPH}</p></article>", PARAGRAPH) for tag in ("button", "select")),
    (f"<article><svg><g><svg><text>a</text></svg><div></div></g></svg><p>{PARAGRAPH}</p></article>", PARAGRAPH),
    (f"</nav></div></section><article><p>{PARAGRAPH}</p></nav></article>", PARAGRAPH),
    *((f"<div {attrs}><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div>", f"{PARAGRAPH} {PARAGRAPH}") for attrs in ('title="a hidden menu id=ads"', "data-hidden=1", "data-id='sidebar'", 'aria-hidden="false"', 'style="color:red" class="x')),
    *((f"<div {attrs}><p>{PARAGRAPH}</p></div><article><p>{PARAGRAPH}</p></article>", PARAGRAPH) for attrs in ("hidden", 'aria-hidden="true"', "style='display: none'", "ID = 'Sidebar'")),
    (f"<form id=page><div><h1>Head of it</h1><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div></form>", f"Head of it {PARAGRAPH} {PARAGRAPH}"),
]


@pytest.mark.parametrize(("page", "want"), CASES + HARD)
def test_pages(page, want):
    assert html.main_text(page, TREE) == want


def test_labelled_table_is_learned():
    x, y = html.labelled()
    for row, label in zip(x, y, strict=True):
        assert html.decide(TREE, row) == label


def used(node):
    return set() if len(node) == 1 else {html.FEATURES[node[0]]} | used(node[2]) | used(node[3])


def test_words_and_links_decide():
    """Own link density splits first, words and neighbours below; without them, or with markup alone, the table is not learned."""
    assert html.FEATURES[TREE[0]] == "density"
    assert {"words", "words_after", "density_before", "density_after"} <= used(TREE)
    x, y = html.labelled()
    counted = [i for i, f in enumerate(html.FEATURES) if f.split("_")[0] in ("words", "density")]

    def wrong(columns):
        kept = np.where(np.isin(np.arange(x.shape[1]), columns), x, 0.0)
        fitted = html.fit_tree(kept, y)
        return sum(html.decide(fitted, r) != label for r, label in zip(kept, y, strict=True)) / len(y)

    everything = list(range(x.shape[1]))
    assert wrong(everything) == 0
    assert wrong([i for i in everything if i not in counted]) > 0.03  # markup alone
    assert wrong(counted) < 0.12  # words and links alone


def test_plain_pages_are_decided_by_words_and_links():
    page = f"{LINKS}<div><p>{WORDS(60)}</p><p>{WORDS(45)}</p><p>{WORDS(70)}</p></div>{LINKS}"
    assert html.main_text(page, TREE) == WORDS(175)
    assert html.main_text(LINKS * 5, TREE) == ""


def test_odd_pages_take_linear_time():
    began = time.perf_counter()
    for page in ("<" * 200_000, "<!--" * 50_000, "<a href='" * 30_000, "<div>" * 50_000, "<script>" * 50_000, "&" * 200_000, "<p class=x " * 30_000, "<div>" * 30_000 + "</nav>" * 30_000, "<svg>" * 30_000 + "</p>" * 30_000, "<button><div></nav>" * 20_000, "</script" * 30_000, "<div " + "a " * 200_000 + ">", "<div " + "a='" * 100_000, "<div hidden" + " " * 200_000 + ">"):
        html.main_text(page, TREE)
    assert time.perf_counter() - began < 30


def test_operator(spark):
    pages = spark.createDataFrame([(1, "u", CASES[0][0], 5), (1, "u", CASES[0][0], 5), (2, None, None, 5), (None, "v", "", 5)], "page_id long, url string, html string, text int")
    rows = html.extract(pages).collect()
    assert len(rows) == 4 and all(len(r.text) == r.n_chars for r in rows)
    assert html.extract(pages.limit(0)).count() == 0


def _words(n, word="text"):
    return " ".join([word] * n)


@pytest.mark.parametrize("gone", ["<p class=notice>{}</p>", "<div class=notice>{}</div>", "<div class=alert><p>{}</p></div>", "<p class=legal>{}</p>", "<form>{}</form>", "<form><p>{}</p><input></form>"])
@pytest.mark.parametrize("n", [8, 25, 60])
def test_notices_and_forms_are_not_main_text(gone, n):
    other = gone.format(_words(n, "other"))
    inside = f"<article><h1>{_words(5)}</h1><p>{_words(70)}</p>{other}<p>{_words(50)}</p></article>"
    before = f"{other}<article><h1>{_words(5)}</h1><p>{_words(90)}</p><p>{_words(40)}</p></article>"
    assert html.main_text(inside, html.tree()) == _words(125)
    assert html.main_text(before, html.tree()) == _words(135)


def test_a_form_around_the_whole_page_is_layout():
    assert html.main_text(f"<form id=page><h1>{_words(5)}</h1><p>{_words(60)}</p></form>", html.tree()) == _words(65)


def test_references_end_with_their_run_of_text():
    page = "<article><p>AT&<b>amp</b>; T &amp;lt; &#233; &nbsp; x</p></article>"
    assert html.main_text(page, html.tree()) == "AT&amp; T &lt; é x"
