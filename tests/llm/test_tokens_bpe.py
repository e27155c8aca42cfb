from __future__ import annotations

import functools
import hashlib
import random
import struct
import time

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larder.llm import bpe, tokens
from tests.llm.conftest import make_docs

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "<|endoftext|>a<|endoftext|>", "<|endoftext", "  \n\n  x \t y   ", "日本語テキスト🙂👩‍👩‍👧", "don't we'll I'M", "é" * 300, "1234567890" * 50, "  nbsp　x", "a\x00b\x7f", "x" * 20_000]


@functools.cache
def load():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return load()


@pytest.fixture(scope="module")
def own():
    return bpe.codec(PATH)


def ids_of(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, own, text):
    packed = own.encode(text)
    assert ids_of(packed) == library.encode(text, add_special_tokens=False).ids
    assert own.decode(packed) == library.decode(ids_of(packed), skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    own = bpe.codec(PATH)
    packed = own.encode(text)
    assert ids_of(packed) == load().encode(text, add_special_tokens=False).ids
    assert own.decode(packed) == text


def test_long_piece_takes_linear_time(own):
    began = time.perf_counter()
    assert own.decode(own.encode("ab" * 200_000)) == "ab" * 200_000
    assert time.perf_counter() - began < 30


def test_bpe_operator(spark, library, edge_rows):
    rows = [*edge_rows, *((2000 + i, t, "en", "s") for i, t in enumerate(ODD))]
    docs = make_docs(spark, rows)
    want = []
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((str(doc), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((str(x.doc_id), x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.encode_decode(docs, PATH).collect()) == sorted(want)
    column = bpe.encode_column(docs, PATH).collect()
    assert all(x.round_trip and len(x.ids) == x.n_tokens for x in column) and len(column) == len(rows)
    assert bpe.encode_decode(docs.limit(0), PATH).count() == 0


def test_cache(spark, library, edge_rows, tmp_path):
    docs = make_docs(spark, [*edge_rows, *((2000 + i, t, "en", "s") for i, t in enumerate(ODD))])
    cache = str(tmp_path / "cache")
    texts = [(x.doc_id, x.text or "") for x in docs.select("doc_id", "text").collect()]
    want = sorted((str(d), len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for d, t in texts)
    got = tokens.token_counts(docs, PATH, cache).collect()
    assert sorted((str(x.doc_id), x.n_bytes, x.n_tokens) for x in got) == want
    assert all(x.over_limit == (x.n_tokens > 512) for x in got)
    stored = spark.read.parquet(cache).count()
    assert stored == len({t for _, t in texts})  # distinct contents once
    # a second run with new rows encodes those alone; another version encodes all again
    more = docs.union(make_docs(spark, [(9000, "something new", "en", "s")]))
    assert tokens.token_counts(more, PATH, cache).count() == len(texts) + 1
    assert spark.read.parquet(cache).count() == stored + 1
    other = public_tokenizers.path("piece_bpe_32k.model")
    tokens.token_counts(more, other, cache).collect()
    assert spark.read.parquet(cache).count() == 2 * (stored + 1)
    assert tokens.token_counts(docs.limit(0), PATH, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("few", [0, 1_000])
def test_few_and_many_misses(spark, library, edge_rows, tmp_path, few):
    docs = make_docs(spark, [*edge_rows, *edge_rows[:8]])
    want = sorted((str(d), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in [*edge_rows, *edge_rows[:8]])
    for _ in range(2):
        got = tokens.token_counts(docs, PATH, str(tmp_path / "cache"), few=few).collect()
        assert sorted((str(x.doc_id), x.n_tokens) for x in got) == want
    assert spark.read.parquet(str(tmp_path / "cache")).count() == len({t or "" for _, t, *_ in edge_rows})


def test_warm_cache_moves_no_text_but_the_missing(spark, tmp_path):
    """With few misses the rows that lack a count are found by a broadcast before the only exchange."""
    docs = make_docs(spark, [(i, f"text {i}", "en", "s") for i in range(50)]).selectExpr("unhex(sha2(text, 256)) as content_digest", "text")
    plan = tokens.missing_texts(docs, docs.limit(1).select("content_digest"), True)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate" if "HashAggregate" in plan else "SortAggregate") < plan.index("BroadcastHashJoin") and "SortMergeJoin" not in plan


def test_cached_count_is_used(spark, tmp_path):
    """A stored count is taken as it is, which shows that hits are not encoded."""
    docs, cache = make_docs(spark, [(1, "hello world", "en", "s")]), str(tmp_path / "cache")
    row = [(hashlib.sha256(b"hello world").digest(), tokens.tokenizer_digest(PATH), 77)]
    spark.createDataFrame(row, tokens.CACHE_SCHEMA).write.partitionBy("tokenizer_digest").parquet(cache)
    assert tokens.token_counts(docs, PATH, cache).first().n_tokens == 77


def test_pair_compatibility_is_that_of_merging(own):
    r, v = random.Random(0), own.vocabulary
    whole = list(v.whole.values())
    for _ in range(3000):
        a, b = r.choice(whole), r.choice(whole)
        merged = Merger(v).encode(v.bytes[a] + v.bytes[b])
        assert v.fits(a, b) == (merged == [a, b])


class Merger:
    """Byte-pair merging as defined: the lowest rank first, leftmost on ties."""

    def __init__(self, vocabulary):
        self.v = vocabulary

    def encode(self, data):
        ids = [self.v.single[b] for b in data]
        while True:
            ranked = [(self.v.pair[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.v.pair]
            if not ranked:
                return ids
            new, i = min(ranked)
            ids[i : i + 2] = [new]
