"""Operator 4: main text of web pages from flat text blocks and a decision tree.

A page becomes a flat list of text blocks. A block's features are its own word count and link
density, those of the blocks before and after it, whether it is a heading or an item, where it
stands (inside an article, outside one, or on a page without any), and how strongly an element
around it names furniture of the page, with the share of the page's words that this element holds.
A decision tree decides block by block. It is fitted to a small labelled table: skeletons of
pages in which every block is labelled by hand, measured by the same parser that reads pages.

Defined results: null or empty html, and pages without main text, give the empty string; broken or
cut markup is read as far as it goes: a head ends at the first element that can't be in it, a
button, select or other element without text ends at the latest with the element around it; an
unmatched end tag is passed over; every step is linear in the page's length; repeated rows
each get their own result; other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import pieces

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template svg iframe object canvas title select option textarea button audio video map math datalist dialog".split())
#: Of those, the ones that hold no markup: everything up to their end tag is skipped.
OPAQUE = {tag: re.compile(f"</{tag}(?![a-z0-9-])", re.IGNORECASE | re.ASCII) for tag in "script style title textarea iframe".split()}
#: Elements that a head may hold; any other one ends it.
IN_HEAD = frozenset("title meta link base script style noscript template".split())
#: Elements that end the text block before them.
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Of those, the ones whose end is looked for; the others end with their parent.
NESTED = BLOCK - frozenset("p hr li dd dt html body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dd dt td th".split())
#: A button that never ends is over where one of these begins; a select, an option or a datalist where any block begins.
NOT_IN_BUTTON = BLOCK - frozenset("div label".split())
#: Strength with which an element names furniture: 3 by its tag or a plain word, 2 a form, 1 a word that content may carry too.
STRONG, FORM, WEAK = 3, 2, 1
BY_TAG = {"nav": STRONG, "footer": STRONG, "aside": STRONG, "menu": STRONG, "form": FORM, "fieldset": FORM}
#: Words of readers' comments; an article inside such an element is a comment.
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies".split())
#: Words in class, id or role that name furniture of a page.
STRONG_WORDS = COMMENT_WORDS | frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr popup modal newsletter signup login searchbox pagination pager outbrain taboola hidden contentinfo complementary notice notices alert alerts disclaimer legal".split())
#: Words that furniture carries, and content at times.
WEAK_WORDS = frozenset("header banner overlay subscribe subscription search share sharing social related recommended recommendations reply widget toolbar promotion copyright teaser tags meta byline".split())
#: Words that name the text itself, or say that a page has something: with one of them a furniture word counts as weak.
TEXT_WORDS = frozenset("article post entry story content main body text page wrapper container layout has with no open closed enabled".split())
#: An attribute with its value, if it has one; values of other attributes are passed over whole.
_ATTRS = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HREF = re.compile(r"\bhref\b", re.I)
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_QUOTE = re.compile(r"=\s*([\"'])")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    tag: str
    #: Inside an article, a main part or an article body.
    article: bool
    #: Strength of the furniture around it, and the number of that element (-1 without any).
    furniture: int
    element: int


class _Open(NamedTuple):
    """An open element: what it and those around it say of the text inside."""

    tag: str
    article: bool
    furniture: int
    element: int
    comments: bool


def _marks(tag: str, rest: str, in_article: bool) -> tuple[int, bool, bool]:
    """What an element's own tag and attributes say: furniture's strength, whether it is an article, whether it holds comments."""
    strength, article, comments = BY_TAG.get(tag, 0), tag in ("article", "main"), False
    if tag == "header" and not in_article:
        strength = STRONG
    if "=" in rest or "hidden" in rest:
        for name, value in _ATTRS.findall(rest):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                strength = STRONG
            elif name in ("class", "id", "role"):
                words = set(re.split(r"[^a-z]+", value))
                if name == "role" and words & {"main", "article"}:
                    article = True
                elif words & STRONG_WORDS:
                    strength = max(strength, WEAK if words & TEXT_WORDS else STRONG)
                    comments |= bool(words & COMMENT_WORDS) and not words & TEXT_WORDS
                elif words & WEAK_WORDS:
                    strength = max(strength, WEAK)
            elif name == "itemprop" and value == "articlebody":
                article = True
    return strength, article, comments


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in page order."""
    out: list[Block] = []
    text: list[str] = []
    links: list[str] = []
    outside = _Open("", False, 0, -1, False)
    stack: list[_Open] = []
    open_tags: Counter[str] = Counter()
    #: The element without text that is open, how often its own tag is open in it, and the blocks opened inside it.
    raw, depth, inside = "", 0, Counter()
    in_head, in_link, kind, elements, own = False, False, "body", 0, outside

    def close() -> None:
        if text:
            words = "".join(text).split()
            if words:
                out.append(Block(" ".join(words), len(words), len(" ".join(links).split()), kind, own.article, own.furniture, own.element))
            text.clear()
        links.clear()

    def entered(tag: str, rest: str) -> _Open:
        nonlocal elements
        around = stack[-1] if stack else outside
        strength, article, comments = _marks(tag, rest, around.article)
        comments |= around.comments
        furniture, element = around.furniture, around.element
        if article and not comments and not around.article:  # an article inside a page's layout: what lies around it says nothing of it
            furniture, element = 0, -1
        if strength and strength >= furniture:
            elements += 1
            furniture, element = strength, elements
        return _Open(tag, article and not comments or around.article, furniture, element, comments)

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at and not raw:
            if in_head and not page[at:lt].isspace():
                in_head = False
            if not in_head:
                said = html.unescape(page[at:lt])  # each run of text alone: a reference never goes on behind markup
                text.append(said)
                if in_link:
                    links.append(said)
        if lt == end:
            break
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        m = _NAME.match(page, lt + 1)
        if not m:
            if page.startswith(("<!", "<?"), lt):
                stop = page.find(">", lt)
                at = end if stop < 0 else stop + 1
            else:  # a lone < is text
                if not raw:
                    text.append("<")
                at = lt + 1
            continue
        tag, closing = m[1].lower(), page[lt + 1] == "/"
        stop = _tag_end(page, m.end())
        rest = page[m.end() : stop]
        at = stop + 1
        if tag in OPAQUE and not closing:
            gone = OPAQUE[tag].search(page, at)
            stop = page.find(">", gone.end()) if gone else -1
            at = end if stop < 0 else stop + 1
            if not raw:
                text.append(" ")
            continue
        if tag == "head":
            in_head = not closing and not out and not text
            continue
        if in_head and not closing and tag not in IN_HEAD:
            in_head = False
        if raw:
            if tag == raw:
                depth += -1 if closing else 0 if rest.endswith("/") or raw in ("button", "option") else 1
                if depth <= 0:
                    raw = ""
                continue
            if closing:
                if inside[tag]:
                    inside[tag] -= 1
                    continue
                if not open_tags[tag] and tag != "body":
                    continue
                raw = ""  # the element around it ends
            elif (raw in ("select", "option", "datalist") and tag in BLOCK) or (raw == "button" and tag in NOT_IN_BUTTON) or tag == "body":
                raw = ""
            else:
                if tag in NESTED:
                    inside[tag] += 1
                continue
        if tag in RAW:
            if not closing and not rest.endswith("/"):
                close()
                raw, depth, inside = tag, 1, Counter()
        elif tag == "a":
            in_link = not closing and bool(_HREF.search(rest))
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCK:
            close()
            if tag in NESTED:
                in_link &= not closing
                if not closing:
                    stack.append(entered(tag, rest))
                    open_tags[tag] += 1
                elif open_tags[tag]:
                    while (gone := stack.pop().tag) != tag:
                        open_tags[gone] -= 1
                    open_tags[tag] -= 1
                own = stack[-1] if stack else outside
            else:
                own = stack[-1] if stack else outside
                if not closing and rest:
                    own = entered(tag, rest)
            kind = "body" if closing else tag
    close()
    return out


def _tag_end(page: str, at: int) -> int:
    """Place of the > that ends a tag, not inside quotes; a quote that never ends counts as none."""
    stop = page.find(">", at)
    if stop < 0:
        return len(page)
    seek = at
    while (m := _QUOTE.search(page, seek, stop)) is not None:
        over = page.find(m[1], m.end())
        if over < 0:
            break
        seek = over + 1
        if seek > stop:
            stop = page.find(">", seek)
            if stop < 0:
                return len(page)
    return stop


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "item", "place", "furniture", "held")


def features(page: list[Block]) -> list[tuple[float, ...]]:
    """The features of every block, in the order of FEATURES; ``place`` is 1 inside an article, -1 outside one, 0 on a page without any."""
    density = [min(1.0, b.linked / b.words) for b in page]
    total, held = sum(b.words for b in page), Counter()
    for b in page:
        held[b.element] += b.words
    n, out, some = len(page), [], any(b.article for b in page)
    for i, b in enumerate(page):
        before = (page[i - 1].words, density[i - 1]) if i else (0, 0.0)
        after = (page[i + 1].words, density[i + 1]) if i + 1 < n else (0, 0.0)
        place = 1.0 if b.article else -1.0 if some else 0.0
        out.append((b.words, density[i], *before, *after, float(b.tag in HEADINGS), float(b.tag in ITEMS), place, float(b.furniture), held[b.element] / total if b.furniture else 0.0))
    return out


#: Skeletons of pages, one a line. [12] stands for 12 words, [3*] for 3 words in a link; + before the bracket labels them
#: main text, - other text. Numbers from 8 on are also taken smaller and larger (SCALES).
LABELLED = """
<header><a href=/>-[2*]</a></header><nav><ul><li>-[1*]<li>-[1*]<li>-[2*]<li>-[1*]</ul></nav><article><h1>+[9]</h1><p>+[40]</p><p>+[60]</p><p>+[3]</p><p>+[25]</p></article><footer>-[9]</footer>
<nav><ul><li>-[1*]<li>-[1*]<li>-[2*]<li>-[1*]</ul></nav><div class=ad>-[12]</div><article><h1>+[3]</h1><p>+[1]<p>+[90 2*]<p>+[5]</article><footer>-[9]</footer>
<nav><ul><li>-[1*]<li>-[1*]<li>-[2*]<li>-[1*]</ul></nav><div class=ad>-[3]</div><article><p>+[2]</article><footer>-[9]</footer>
<div class=ad>-[45]</div><article><h1>+[6*]</h1><p>+[300]</article><div class=ad>-[60]</div><footer><p>-[30 3*]</p><ul><li>-[2*]<li>-[1*]</ul></footer>
<main><h1>+[5]</h1><p>+[35]</p><h2>+[2]</h2><ul><li>+[4]<li>+[12]<li>+[7 2*]<li>+[1]</ul><p>+[20]</p></main><footer><p>-[30 3*]</p><ul><li>-[2*]<li>-[1*]</ul></footer>
<main><p>+[45]</p><p>+[30]</p><ul><li>-[4*]</li><li>-[5*]</li><li>-[6*]</li><li>-[3*]</li></ul></main><footer>-[9]</footer>
<article><h2>+[7]</h2><p>+[55]</p><p>+[40]</p></article><ul><li>-[4*]</li><li>-[5*]</li><li>-[6*]</li></ul><footer>-[9]</footer>
<article><p>+[18]</p><p>+[10]</p></article><div>-[2*]</div><div>-[3*]</div><footer>-[9]</footer>
<article><p>+[70]</p><aside>-[8]</aside><p>+[35]</p><aside><h3>-[2]</h3><ul><li>-[5*]<li>-[6*]</ul></aside><p>+[22]</p></article><footer>-[9]</footer>
<article><p>+[60]</p><div class=ad>-[4]</div><p>+[50]</p><div class="advert box">-[25]</div><p>+[8]</p></article>
<article><h1>+[4]</h1><p>+[80]</p><section class=comments><h3>-[2]</h3><p>-[12]</p><p>-[45]</p><p>-[3]</p></section></article><footer>-[9]</footer>
<article><p>+[80]</p><p>+[30]</p></article><section id=comments><h3>-[2]</h3><article class=comment><p>-[25]</p></article><article><p>-[60]</p><p>-[10]</p></article></section>
<article><p>+[15]</p></article><div id=comments><div>-[40]</div><div>-[90]</div><div>-[35]</div></div><footer>-[9]</footer>
<article><p>+[40]</p><form><label>-[1]</label><p>-[14]</p></form><p>+[30]</p><div class=newsletter><p>-[16]</p><p>-[2*]</p></div></article>
<article><header><h1>+[8]</h1><p>+[4]</p></header><p>+[45]</p><p class=notice>-[20]</p><p>+[35]</p><p class=alert>-[9]</p><p>+[30]</p></article>
<article><p>+[50]</p><div class=share><p>-[1*]</p><p>-[1*]</p><p>-[2*]</p></div><p>+[25]</p><div class=related><h4>-[2]</h4><p>-[6*]</p><p>-[8*]</p></div></article>
<article><p>+[50]</p><p class=related>+[28 2*]</p><p>+[25]</p><div class=widget>-[3]</div></article>
<article><blockquote>+[30]</blockquote><p>+[6*]</p><p>+[45 15*]</p><table><tr><td>+[2]<td>+[1]<tr><td>+[3]<td>+[1 1*]</table><p>+[20]</p></article>
<div class="main share-content"><article><h1>+[5]</h1><p>+[50]</p><p>+[12]</p></article></div><footer>-[9]</footer>
<div class=has-sidebar><article><p>+[40]</p><p>+[3]</p></article><div class=sidebar><p>-[20]</p><p>-[5*]</p></div></div>
<div class="main share-content"><h1>+[5]</h1><p>+[50]</p><p>+[35]</p></div><div class=footer><p>-[15]</p></div>
<article class=comments-open><p>+[40]</p><p>+[25]</p><p>+[4]</p></article><footer>-[9]</footer>
<div id=cookie-notice><p>-[70]</p><p>-[1*]</p></div><article><h1>+[6]</h1><p>+[60]</p></article>
<div><p>-[70 2*]</p></div><div>-[1*]</div><article><p>+[60]</p><p>+[40]</p></article><div><p>-[40]</p></div><footer>-[9]</footer>
<article><p>+[30]</p><ul><li>+[3 4*]<li>+[9]<li>+[2*]<li>+[12]</ul><p>+[40]</p></article>
<nav><ul><li>-[1*]<li>-[1*]<li>-[2*]<li>-[1*]</ul></nav><main><div class=breadcrumb><p>-[1*]</p><p>-[2*]</p></div><h1>+[4]</h1><p>+[55]</p><div class=pagination>-[1*]</div></main><footer>-[9]</footer>
<div><ul><li>-[1*]</li><li>-[2*]</li><li>-[1*]</li><li>-[3*]</li></ul></div><div><h1>+[6]</h1><p>+[60]</p><p>+[45]</p><p>+[30]</p><p>+[80]</p></div><div><p>-[3*]</p><p>-[2*]</p><p>-[1*]</p><p>-[6]</p></div>
<div><ul><li>-[1*]</li><li>-[2*]</li><li>-[1*]</li><li>-[3*]</li></ul></div><div><p>+[70]</p><p>+[14]</p><p>+[55]</p><p>+[5]</p><p>+[90]</p></div><div><p>-[3*]</p><p>-[2*]</p><p>-[1*]</p><p>-[6]</p></div>
<div><ul><li>-[1*]</li><li>-[2*]</li><li>-[1*]</li><li>-[3*]</li></ul></div><div>+[250 3*]</div><div><p>-[3*]</p><p>-[2*]</p><p>-[1*]</p><p>-[6]</p></div>
<p>+[40]</p><p>+[25]</p><p>+[60 6*]</p>
<h1>+[4]</h1><p>+[40]</p><h2>+[3]</h2><p>+[25]</p><h2>+[2]</h2><p>+[60 6*]</p><ul><li>-[2*]<li>-[3*]<li>-[2*]</ul>
<div>-[2]</div><div><ul><li>-[1*]</li><li>-[2*]</li><li>-[1*]</li><li>-[3*]</li></ul></div><div>-[6]</div><div>+[45]</div><div>+[38 2*]</div><div>+[70]</div><div>-[5*]</div><div>-[8*]</div><div>-[4]</div>
<table><tr><td>-[2*]<td>-[1*]<td>-[2*]</table><table><tr><td>+[120]<tr><td>+[65 3*]</table><table><tr><td>-[3*]<td>-[5]</table>
<div><p>+[35]</p><p>+[50]</p><ul><li>+[20]<li>+[15 2*]<li>+[25]</ul><p>+[40]</p></div><div><p>-[3*]</p><p>-[2*]</p><p>-[1*]</p><p>-[6]</p></div>
<form id=page><div><ul><li>-[1*]</li><li>-[2*]</li><li>-[1*]</li><li>-[3*]</li></ul></div><div><h1>+[5]</h1><p>+[60]</p><p>+[40]</p></div><div><p>-[3*]</p><p>-[2*]</p><p>-[1*]</p><p>-[6]</p></div></form>
<div><h3>-[3*]</h3><p>-[12 3*]</p><h3>-[4*]</h3><p>-[14 2*]</p><h3>-[2*]</h3><p>-[11 3*]</p></div><div><p>-[3*]</p><p>-[2*]</p><p>-[1*]</p><p>-[6]</p></div>
<ul><li>-[3*]<li>-[5*]<li>-[2*]<li>-[9*]<li>-[4*]</ul><p>-[3]</p>
<div><ul><li>-[1*]</li><li>-[2*]</li><li>-[1*]</li><li>-[3*]</li></ul></div><form><p>-[6]</p><label>-[1]</label><label>-[2]</label><p>-[3*]</p></form><div><p>-[3*]</p><p>-[2*]</p><p>-[1*]</p><p>-[6]</p></div>
<div class=login><p>-[9]</p><label>-[1]</label></div><div><p>-[3*]</p><p>-[2*]</p><p>-[1*]</p><p>-[6]</p></div>
<div id=header><p>-[4]</p></div><div class=nav>-[1*]</div><div id=content><h1>+[5]</h1><p>+[55]</p><p>+[40]</p><p>+[6]</p></div><div id=sidebar><h3>-[2]</h3><p>-[40]</p><p>-[4*]</p></div><div id=footer><p>-[35]</p></div>
<div class=post><h2>+[5]</h2><p>+[30]</p><p>+[65]</p></div><div class=comments><p>-[40]</p><p>-[25]</p><p>-[70]</p></div><div class=copyright>-[8]</div>
<div class=cookie-banner><p>-[45]</p><p>-[2*]</p></div><div><p>+[60]</p><p>+[40]</p><p>+[50]</p></div><div class=legal><p>-[40]</p></div>
<div id=cookie-notice><p>-[70]</p></div><div>-[1*]</div><div><p>+[45]</p><p>+[40]</p></div>
<div class=notice><p>-[25]</p></div><div><ul><li>-[1*]</li><li>-[2*]</li><li>-[1*]</li><li>-[3*]</li></ul></div><div><p>+[55]</p><p>+[60]</p></div><div class=disclaimer><p>-[30]</p></div>
<div class=sponsored><p>-[50]</p></div><div><p>+[60]</p><p>+[35]</p></div><div class=promo><p>-[18]</p></div>
<div><p>+[60]</p><p>+[35]</p></div><div class=share>-[1*]</div><div class=related><p>-[6*]</p><p>-[20 6*]</p></div><form><p>-[20]</p><label>-[3]</label></form>
<div class=page-wrapper><div class=search>-[2]</div><div class=entry><p>+[80]</p><p>+[20]</p><p>+[45]</p></div><div class=widget><h3>-[2]</h3><p>-[12]</p></div></div>
<nav><ul><li>-[1*]<li>-[1*]<li>-[2*]<li>-[1*]</ul></nav><article><p>+[14]</p></article>
<nav><ul><li>-[1*]<li>-[1*]<li>-[2*]<li>-[1*]</ul></nav><article><p>+[1]</p></article>
<nav><ul><li>-[1*]<li>-[1*]<li>-[2*]<li>-[1*]</ul></nav><article><h1>+[1]</h1><p>+[1]</p><p>+[1]</p><p>+[2]</p><p>+[1]</p></article>
<nav><ul><li>-[1*]<li>-[1*]<li>-[2*]<li>-[1*]</ul></nav><article><h1>+[2]</h1><p>+[1]</p><p>+[2]</p></article><footer>-[9]</footer>
<nav><ul><li>-[1*]<li>-[1*]<li>-[2*]<li>-[1*]</ul></nav><div class=ad>-[1]</div><article><h1>+[1]</h1><p>+[3]</p><p>+[1]</p></article><footer>-[9]</footer>
<div class=ad>-[9]</div><article><h1>+[16]</h1><p>+[400]</p><p>+[2]</p></article><footer>-[9]</footer>
<article><p>+[5]</p><p>+[2]</p><p>+[1]</p></article>
<article><p>+[120]</p></article>
<article><h1>+[3]</h1></article><footer>-[9]</footer>
<nav><ul><li>-[1*]<li>-[1*]<li>-[2*]<li>-[1*]</ul></nav><article><h1>+[3*]</h1><p>+[2*]</p><p>+[40]</p><p>+[1*]</p></article>
<nav><ul><li>-[1*]<li>-[1*]<li>-[2*]<li>-[1*]</ul></nav><article><ul><li>+[1]<li>+[1]<li>+[2]<li>+[1]</ul></article>
<div>-[2*]</div><div>-[1*]</div><article><p>+[9]</p><p>+[30]</p></article><div>-[2*]</div>
<div><ul><li>-[1*]</li><li>-[2*]</li><li>-[1*]</li><li>-[3*]</li></ul></div><div><p>+[60]</p></div>
<div><ul><li>-[1*]</li><li>-[2*]</li><li>-[1*]</li><li>-[3*]</li></ul></div><p>+[30]</p><p>+[45]</p>
<p>+[25]</p>
<p>+[60]</p>
<h1>+[3]</h1><p>+[18]</p>
<p>+[20]</p><p>+[4]</p><p>+[30]</p>
<article><p>+[35]</p><p>+[2]</p><p>+[1]</p></article><div>-[1]</div><div>-[2]</div>
<article><div class=notice>-[4]</div><p>+[35]</p><p>+[50]</p><div class=subscribe><p>-[6]</p></div></article>
<article><section class="post content"><p>+[35]</p><p>+[4]</p></section><section class="related posts"><p>-[5*]</p><p>-[12*]</p></section></article>
<div class="post-header"><h1>+[6]</h1></div><div class="entry-content"><p>+[50]</p><p>+[30]</p></div><div class="post-footer"><p>-[4 2*]</p></div>
<nav><ul><li>-[1*]<li>-[1*]<li>-[2*]<li>-[1*]</ul></nav><article><p>+[2]</p></article>
<nav><ul><li>-[1*]<li>-[1*]<li>-[2*]<li>-[1*]</ul></nav><article><p>+[3]</p></article>
<nav><ul><li>-[1*]<li>-[1*]<li>-[2*]<li>-[1*]</ul></nav><article><p>+[4]</p></article>
<nav><ul><li>-[1*]<li>-[1*]<li>-[2*]<li>-[1*]</ul></nav><article><p>+[5]</p></article>
<nav><ul><li>-[1*]<li>-[1*]<li>-[2*]<li>-[1*]</ul></nav><article><p>+[6]</p></article>
<nav><ul><li>-[1*]<li>-[1*]<li>-[2*]<li>-[1*]</ul></nav><article><p>+[7]</p></article>
<article><p>+[40]</p><p>+[1]</p></article><ul><li>-[1*]<li>-[3*]<li>-[2*]</ul>
<article><p>+[40]</p><p>+[2]</p></article><ul><li>-[1*]<li>-[3*]<li>-[2*]</ul>
<article><p>+[40]</p><p>+[3]</p></article><ul><li>-[1*]<li>-[3*]<li>-[2*]</ul>
<article><p>+[40]</p><p>+[5]</p></article><ul><li>-[1*]<li>-[3*]<li>-[2*]</ul>
<article><p>+[40]</p><p>+[7]</p></article><ul><li>-[1*]<li>-[3*]<li>-[2*]</ul>
<nav><ul><li>-[1*]<li>-[1*]<li>-[2*]<li>-[1*]</ul></nav><article><p>+[1]</p></article><ul><li>-[1*]<li>-[3*]<li>-[2*]</ul>
<nav><ul><li>-[1*]<li>-[1*]<li>-[2*]<li>-[1*]</ul></nav><article><p>+[3]</p></article><ul><li>-[1*]<li>-[3*]<li>-[2*]</ul>
<nav><ul><li>-[1*]<li>-[1*]<li>-[2*]<li>-[1*]</ul></nav><article><p>+[6]</p></article><ul><li>-[1*]<li>-[3*]<li>-[2*]</ul>
<nav><ul><li>-[1*]<li>-[1*]<li>-[2*]<li>-[1*]</ul></nav><article><p>+[30]</p></article><ul><li>-[1*]<li>-[3*]<li>-[2*]</ul>
<article><p>+[40]</p><p class=notice>-[20]</p><p>+[1]</p></article>
<article><p>+[40]</p><p class=notice>-[20]</p></article>
<article><p class=legal>-[30]</p><p>+[40]</p><p class=alert>-[35]</p><h2>+[2]</h2><p>+[50]</p></article>
<div class=notice><p>-[25]</p></div><article><h1>+[5]</h1><p>+[60]</p><div class=notice>-[40]</div><p>+[30]</p></article>
<div class=notice>-[25]</div><div><p>+[60]</p><p>+[35]</p></div><p class=alert>-[12]</p>
<div class=notice>-[25]</div><p>+[60]</p><p>+[35]</p>
<article><p>+[40]</p><form><p>-[25]</p></form><p>+[30]</p></article>
<article><h1>+[5]</h1><p>+[60]</p><form>-[25]</form></article>
<article><p>+[50]</p><form><p>-[60]</p><label>-[3]</label></form><p>+[20]</p></article>
<article><form><p>-[30]</p><p>-[25]</p></form><p>+[90]</p></article>
<div><p>+[60]</p><p>+[35]</p></div><form><p>-[50]</p></form>
<form><p>-[40]</p><label>-[2]</label></form><p>+[70]</p><p>+[45]</p>
<article><p class=teaser>+[25]</p><p class=byline>-[4]</p><p>+[60]</p></article>
<article><p>+[30]</p><div class=share>-[1*]</div><div class=tags>-[2*]</div></article>
<article><p>+[30]</p><div class=widget>-[1]</div><p>+[20]</p></article>
<div class="main share-content"><p>+[20]</p><p>+[22]</p></div>
<div class="main share-content"><h1>+[3]</h1><p>+[60]</p></div>
<form id=page><div><ul><li>-[1*]</li><li>-[2*]</li><li>-[1*]</li><li>-[3*]</li></ul></div><div><p>+[50]</p><p>+[40]</p></div></form>
<div class="post header"><p>+[40]</p><p>+[12]</p><p>+[30]</p></div>
<form id=page><div><h1>+[3]</h1><p>+[22]</p><p>+[20]</p></div></form>
<form><h1>+[6]</h1><p>+[60]</p></form>
<form><p>+[45]</p><p>+[30]</p></form>
"""
SCALES = (0.5, 0.8, 1.0, 1.6, 2.5)
_HOLE = re.compile(r"([+-])\[([0-9* ]+)\]")


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: features and labels (1 for main text) of every block of the skeletons."""
    x: list[tuple[float, ...]] = []
    y: list[int] = []
    for scale in SCALES:

        def filled(m: re.Match, scale: float = scale) -> str:
            said = "main" if m[1] == "+" else "other"
            parts = []
            for part in m[2].split():
                n = int(part.rstrip("*"))
                some = " ".join([said] * (n if n < 8 else max(8, round(n * scale))))
                parts.append(f"<a href=/>{some}</a>" if part.endswith("*") else some)
            return " ".join(parts)

        for skeleton in LABELLED.strip().splitlines():
            page = blocks(_HOLE.sub(filled, skeleton))
            x += features(page)
            y += [int(b.text.startswith("main")) for b in page]
    return np.array(x, dtype=float), np.array(y)


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 12) -> tuple:
    """A classification tree by Gini impurity: (feature, threshold, left, right), or the class at a leaf."""
    majority = int(2 * y.sum() >= len(y))
    if depth == 0 or y.min() == y.max():
        return (majority,)
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            a, b = y[left], y[~left]
            gini = sum(len(s) * 2 * s.mean() * (1 - s.mean()) for s in (a, b))
            best = min(best, (gini, f, float(cut)))
    if best[0] == np.inf:
        return (majority,)
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], fit_tree(x[left], y[left], depth - 1), fit_tree(x[~left], y[~left], depth - 1))


@functools.cache
def tree() -> tuple:
    """The tree fitted to the labelled table."""
    return fit_tree(*labelled())


def decide(node: tuple, row: tuple[float, ...]) -> int:
    while len(node) > 1:
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node[0]


def main_text(page: str | None, fitted: tuple) -> str:
    if not page:
        return ""
    found = blocks(page)
    return " ".join(b.text for b, row in zip(found, features(found), strict=True) if decide(fitted, row))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    fitted = tree()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text="html"):
            texts = [main_text(page, fitted) for page in piece.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    df = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return df.mapInArrow(scan, "page_id bigint, url string, text string, n_chars bigint")
