from __future__ import annotations

import itertools
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import pii
from tests.llm.conftest import make_docs


def plain(text):
    """The contract's patterns, read literally."""
    spans = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in twice) % 10 == 0:
            spans.append((2, *m.span()))
    spans += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return spans


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.+-01259 ()é\n_%", max_size=60))
def test_base_equals_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_known_values():
    text = "Mail a.b+c@x-y.example.org, 10.0.0.256 10.0.0.255 1.2.3.4.5 card 4111 1111 1111 1111 call +1 (988) 555-2485."
    found = [(pii.KINDS[k], text[s:e]) for k, s, e in pii.base_spans(text)]
    assert found == [("email", "a.b+c@x-y.example.org"), ("ip", "10.0.0.255"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (988) 555-2485")]


def test_long_runs_take_linear_time():
    began = time.perf_counter()
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + " " * 300_000, "a@" * 100_000, "1 " * 150_000):
        pii.base_spans(text)
    assert time.perf_counter() - began < 20


def made(n, seed=3):
    """Invented texts with entities among numbers that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3)))
    out = []
    for i in range(n):
        parts = [word() for _ in range(r.randint(15, 60))]
        for x in (f"+1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}", f"{word()}.{i}@mail{i % 7}.example.com", str(r.randint(1900, 2030)), f"{r.randint(1, 9)}.{r.randint(0, 9)}", f"10.{i % 200}.3.{i % 99}"):
            parts.insert(r.randrange(len(parts)), x)
        out.append(" ".join(parts))
    return out


@pytest.fixture(scope="module")
def model():
    return pii.fit_crf(made(300))


def add(model, *texts):
    return pii.added_spans(model, list(texts), [pii.base_spans(t) for t in texts])


def test_precision_and_recall_on_planted_repeats(model):
    """Texts and entities that the fit has not seen; mentions in forms that the patterns miss, among other numbers."""
    hit = wrong = missed = 0
    for text in made(200, seed=77):
        longer, spans = pii.mentioned_again(text, pii.base_spans(text))
        base = pii.base_spans(longer)
        want = {x for x in set(spans) - set(base) if all(e <= x[1] or x[2] <= s for _, s, e in base)}
        got = set(add(model, longer)[0])
        hit, wrong, missed = hit + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert hit > 200 and hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.7


def test_repeats_are_added_and_clean_text_is_left(model):
    text = "Call +1 (988) 555-2485 now. Later the same phone again: 555-2485 please."
    base = pii.base_spans(text)
    added = add(model, text)[0]
    assert [text[s:e] for _, s, e in added] == ["555-2485"]
    assert all(e <= s2 or e2 <= s for _, s, e in added for _, s2, e2 in base)
    clean = "There were 12 people, 3 dogs and version 2.0 of the years 1995-2001, pages 120-1310, in 2024."
    assert add(model, clean, clean + " " + clean) == [[], []]


@pytest.mark.parametrize("times", [1, 10, 500])
def test_repeats_of_one_form_get_one_verdict(model, times):
    """All equal tokens with equal neighbours are labelled alike, however far from the known one; other texts of a batch do not matter."""
    text = "Call +1 (988) 555-2485 now. " + "Then the number 555-2485 rings as ever. " * times
    added = add(model, text)[0]
    assert [text[s:e] for _, s, e in added] == ["555-2485"] * times
    assert add(model, "nothing 1", text, made(1)[0])[1] == added
    alone = "Then the number 555-2485 rings as ever. " * times
    assert add(model, alone)[0] == []  # without a known one nothing speaks for it


def test_long_tokens_are_nodes(model):
    """A number inside a run of 300 characters without a space, as in JSON, and a long token itself."""
    value = '{"a":"' + "x" * 300 + '","phone":"555-2485","b":"' + "y" * 300 + '"}'
    text = f"Call +1 (988) 555-2485 now. {value}"
    assert [text[s:e] for _, s, e in add(model, text)[0]] == ["555-2485"]
    graph = pii.Graph()
    graph.add(0, "a " + "1x" * 5000 + " b")
    assert graph.span == [(2, 10_002)] and graph.fixed == [2]


def test_context_is_whole_words():
    found = list(pii.tokens_in_context("of " + "long" * 30 + " 12 " + "tail" * 30))
    assert found == [(2, 124, 126, "12", ["of", "long" * 30, "tail" * 30, "$"])]


def enumerate_marginals(model, unary, e):
    n, k = unary.shape
    want = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        p = np.exp(sum(unary[i, y] for i, y in enumerate(labels)) + sum(model["pair"][t][labels[a], labels[b]] for a, b, t in e))
        for i, y in enumerate(labels):
            want[i, y] += p
    return want / want.sum(axis=1, keepdims=True)


def test_message_passing_agrees_with_enumeration():
    """Exact on trees; on loops (two chained tokens under one hub, and a ring of four) near, with the same best labels."""
    r = np.random.default_rng(1)
    k = len(pii.LABELS)
    for edges, exact in (([(0, 1, 0), (1, 2, 0)], True), ([(0, 3, 1), (1, 3, 1), (2, 3, 1)], True), ([(0, 1, 0), (0, 2, 1), (1, 2, 1)], False), ([(0, 1, 0), (1, 2, 0), (2, 3, 1), (0, 3, 1)], False)):
        for _ in range(20):
            pair = r.normal(size=(2, k, k)) * 0.6
            model = {"pair": (pair + pair.transpose(0, 2, 1)) / 2}
            unary = r.normal(size=(max(map(max, ((a, b) for a, b, _ in edges))) + 1, k)) * 2
            got, want = pii.marginals(model, unary, np.array(edges)), enumerate_marginals(model, unary, edges)
            assert np.abs(got - want).max() < (1e-3 if exact else 0.12)
            clear = np.sort(want, axis=1)[:, -1] - np.sort(want, axis=1)[:, -2] > 0.2
            assert (got.argmax(axis=1) == want.argmax(axis=1))[clear].all()


def test_fixed_neighbours_are_exact(model):
    """A chain in which tokens without digit and @ are nodes with the one label o gives the same marginals."""
    graph = pii.Graph()
    graph.add(0, "call 555-2485 now 12 13")
    got = pii.label_tokens(model, graph, np.zeros(3, dtype=np.int64))
    x = graph.arrays()[0]
    unary = np.zeros((7, len(pii.LABELS)))  # ^ call 555-2485 now 12 13 $
    unary[[2, 4, 5]] = model["weight"][x].sum(axis=1)
    unary[[0, 1, 3, 6], 1:] = -1e6
    want = enumerate_marginals(model, unary[[1, 2, 3, 4, 5, 6]], [(i, i + 1, 0) for i in range(5)])
    assert np.allclose(got, want[[1, 3, 4]], atol=1e-3)


def test_nothing_to_learn_adds_nothing():
    for texts in ([], ["no numbers"], ["only 12 and 13"]):
        assert add(pii.fit_crf(texts), "call +1 (988) 555-2485 or 555-2485") == [[]]


def test_operator_on_edge_rows(spark, edge_rows):
    docs = make_docs(spark, [*edge_rows, (900, "write me@example.com", "en", "a")])
    rows = pii.find_pii(docs).collect()
    assert len(rows) == len(edge_rows) + 1
    fitted = pii.fit_crf(made(300))
    twice = [(5, "Call +1 (988) 555-2485 now, then 555-2485 please", "en", "a")] * 2 + [(5, None, "en", "a")]
    assert sorted(str(r.spans_text) for r in pii.find_pii(make_docs(spark, twice), model=fitted).collect()) == ["", "phone:5:22,phone:33:41", "phone:5:22,phone:33:41"]
    assert {r.doc_id: r.base_text for r in rows}[900] == "email:6:20"
    assert pii.find_pii(docs.limit(0)).count() == 0
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[900] == "write <EMAIL>" and clean[1] is None
    assert pii.redact(docs).columns == docs.columns
