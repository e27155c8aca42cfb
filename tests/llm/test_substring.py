from __future__ import annotations

import random

import pytest
import xxhash

from larder.llm import substring
from larder.llm.common import words_of
from tests.llm.conftest import make_docs, sentence


def brute(rows, window=20):
    first = {}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    for doc, text, *_ in order:
        w = words_of(text)
        for i in range(len(w) - window + 1):
            here = ((doc is not None, doc or 0), i)
            first[tuple(w[i : i + window])] = min(first.get(tuple(w[i : i + window]), here), here)
    out = []
    for doc, text, *_ in rows:
        w, gone = words_of(text), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < ((doc is not None, doc or 0), i):
                gone.update(range(i, i + window))
        out.append((str(doc), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"one_in": 1, "share": 0.0, "least": 1}, {"one_in": 1, "share": 0.002, "least": 2}, {"large": 1}, {"large": 40}, {"run": 1}])
def test_against_brute_force(spark, edge_rows, vocabulary, options):
    r = random.Random(8)
    passages = [sentence(r, n, vocabulary) for n in (20, 25, 60, 200)]
    rows = [x for x in edge_rows if len(x[1] or "") < 100_000]
    rows += [(300 + i, " ".join([sentence(r, r.randint(0, 30), vocabulary), r.choice(passages), sentence(r, r.randint(0, 30), vocabulary)]), "en", "s") for i in range(60)]
    rows += [(400, "p q r " * 60, "en", "s"), (401, "p q r " * 30, "en", "s"), (400, "other text of the same id " * 8, "en", "s")]
    got = substring.deduplicate(make_docs(spark, rows), **options).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_removed, x.kept) for x in got) == brute(rows)


def test_batches_do_not_matter(spark, vocabulary):
    r = random.Random(1)
    passage = sentence(r, 40, vocabulary)
    rows = [(i, sentence(r, 25, vocabulary) + " " + passage, "en", "s") for i in range(80)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for options in ({}, {"large": 30}):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = substring.deduplicate(make_docs(spark, rows), **options).collect()
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert sorted((str(x.doc_id), x.n_words, x.n_removed, x.kept) for x in got) == brute(rows)


def test_hot_minimisers_are_bounded_by_their_share(spark, vocabulary):
    passage = sentence(random.Random(1), 40, vocabulary)
    docs = make_docs(spark, [(i, sentence(random.Random(i), 60, vocabulary) + " " + passage, "en", "s") for i in range(100)]).selectExpr("doc_id", "xxhash64(text) as digest", "text")
    hot = substring._hot(docs, 20, 4, 1, 0.01, 2)
    assert 0 < len(hot) <= 100 and hot <= set(substring.super_kmers(passage.split())[0].tolist()) | set(substring.run_hashes(passage.split()).tolist())


def test_empty(spark):
    docs = make_docs(spark, [(1, None, "en", "s")])
    assert substring.deduplicate(docs).first().asDict() == {"doc_id": 1, "n_words": 0, "n_removed": 0, "kept": ""}
    assert substring.deduplicate(docs.limit(0)).count() == 0


def same_low_bits(make, bits=24, seed=42):
    """An odd and an even text whose Spark xxhash64 agrees in its lowest bits."""
    met = {}
    for i in range(200_000):
        text = make(i)
        low = xxhash.xxh64_intdigest(text.encode(), seed) % (1 << bits)
        if (low, 1 - i % 2) in met:
            return sorted((met[low, 1 - i % 2], text), key=len)
        met[low, i % 2] = text
    raise AssertionError


@pytest.mark.parametrize("options", [{}, {"one_in": 1, "share": 0.0, "least": 1}, {"large": 5}])
def test_texts_of_one_id_with_equal_low_bits(spark, vocabulary, options):
    passage = sentence(random.Random(4), 40, vocabulary)
    short, long = same_low_bits(lambda i: f"n{i} " + (passage if i % 2 else " ".join(f"{i}x{k}" for k in range(25)) + " " + passage))
    rows = [(None, short, "en", "s"), (None, long, "en", "s"), (7, "lead " + passage, "en", "s"), (None, long, "en", "s")]
    got = substring.deduplicate(make_docs(spark, rows), **options).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_removed, x.kept) for x in got) == brute(rows)


def test_many_texts_and_copies_of_one_id(spark, vocabulary):
    """Passages at near places of many texts without an id, so that a later string may hold a window earlier; copies give a span once."""
    r = random.Random(2)
    passages = [sentence(r, 45, vocabulary) for _ in range(6)]
    rows = [(None, " ".join([sentence(r, r.randint(0, 12), vocabulary), r.choice(passages), sentence(r, 5, vocabulary)]), "en", "s") for _ in range(150)]
    rows += rows[:3] * 30
    got = substring.deduplicate(make_docs(spark, rows)).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_removed, x.kept) for x in got) == brute(rows)
