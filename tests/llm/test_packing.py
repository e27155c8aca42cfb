from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from larder.llm import packing
from larder.llm.queries import END_ID, PACKED_VOCABULARY, op12_packing, vocabulary_path
from tests.llm.conftest import make_docs

HARD = [
    "a", "A.", "don't Don'T stop.", "it's,", "x.,y", "word.Word", "n't.", "'s.", "d's", "''s", "C3PO.", "100%.", "ÀÉ Ünï©ode.", "éa é.", "İstanbul İ.", "ΣΑΣ σας ς.", "日本語 text,", "🙂🙂.",
    "<|endoftext|>", "a<|endoftext|>b.", "<|ENDOFTEXT|> <|startoftext|>.", "a b　c\u0085d", "a\x1cb \x1d.", "tab\tand\r\nlines\x0b\x0c.", "ﬁne ſ.", "ŉ.", "a‍b", "́.", "x" * 300 + ".", "Ｆｕｌｌ．", "l'été.", "we'll've",
]


@pytest.fixture(scope="module")
def encoded_by_library():
    _, encode = packing.library(vocabulary_path(PACKED_VOCABULARY))
    return lambda text: [*encode([text or ""])[0], END_ID]


def test_words_give_the_ids_of_whole_texts(vocabulary):
    r = random.Random(3)
    path = vocabulary_path(PACKED_VOCABULARY)
    texts = HARD + [" ".join(r.choice(HARD + vocabulary).title() + r.choice(["", ".", ",", "!?", "'s"]) for _ in range(40)) for _ in range(200)]
    texts += ["".join(r.choice(["a", "B", "é", "İ", "Σ", "'", "s", ".", ",", " ", "\n", "́", "1", "|", "<", "\x1c", "ǅ"]) for _ in range(60)) for _ in range(800)]
    wanted = [packing._as_bytes(i) for i in packing.library(path)[1](texts)]
    for memo in (packing.MEMO, 50):  # a memo that is full all the time changes nothing
        encoder, found = packing.WordEncoder(path, memo), []
        for k in range(0, len(texts), 37):
            ids, sizes = encoder(pa.array([None, *texts[k : k + 37], ""])[1:], b"\1\0\0\0")
            ends = np.cumsum(sizes)
            found += [ids[a : b - 1].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)][:-1]
            assert all(ids[ends - 1] == 1)
        assert found == wanted


def check(rows, docs, encoded, width):
    """Every id in one piece, sequences gapless and full but for the last."""
    whole = {}
    for d in rows:
        whole.setdefault((d.doc_id, d.doc_tokens), []).append(d)
    ids = {}
    for i, text in docs:
        ids.setdefault(i, []).append(encoded(text))
    found = sorted((d.sequence_id, d.offset, d.length, d.doc_id, d.start, bytes(d.ids)) for d in rows)
    at = 0
    for s, o, n, *_ in found:
        assert (s, o) == divmod(at, width) and n > 0 and o + n <= width
        at += n
    assert at == sum(len(x) for v in ids.values() for x in v)
    rebuilt = {}
    for _, _, n, i, start, piece in found:  # the pieces of a document follow each other
        own = rebuilt.setdefault(i, [])
        if start == 0:
            own.append([])
        assert len(own[-1]) == start and len(piece) == 4 * n
        own[-1] += np.frombuffer(piece, "<u4").tolist()
    assert {i: sorted(v) for i, v in rebuilt.items()} == {i: sorted(v) for i, v in ids.items()}
    return at


@pytest.mark.parametrize("width", [64, 2048])
@pytest.mark.parametrize("by_words", [True, False])
def test_pieces(spark, edge_rows, encoded_by_library, width, by_words):
    docs = make_docs(spark, edge_rows).repartition(5)
    packed = packing.pack(docs, vocabulary_path(PACKED_VOCABULARY), END_ID, width, by_words)
    total = check(packed.collect(), [(r[0], r[1]) for r in edge_rows], encoded_by_library, width)
    rows = packing.sequences(packed, width).orderBy("sequence_id").collect()
    assert [r.n_tokens for r in rows] == [width] * (total // width) + [total % width] * (total % width > 0)
    stream = np.frombuffer(b"".join(bytes(r.ids) for r in rows), "<u4")
    assert sorted(np.flatnonzero(stream == END_ID) + 1)[-1] == total
    joined = b"".join(bytes(p.ids) for p in packed.orderBy("sequence_id", "offset").collect())
    assert joined == stream.tobytes()


@pytest.mark.parametrize(("words", "width", "wanted"), [(3, 8, {4}), (4, 8, {8}), (7, 8, {8}), (8, 8, {8, 1})])
def test_padding_of_the_last_sequence(spark, words, width, wanted):
    docs = make_docs(spark, [(1, " ".join("a" for _ in range(words)), "en", "a")], extra=False)
    rows = packing.pack(docs, vocabulary_path(PACKED_VOCABULARY), END_ID, width).collect()
    assert {r.sequence_tokens for r in rows} == wanted


def test_empty_table(spark):
    packed = packing.pack(make_docs(spark, []), vocabulary_path(PACKED_VOCABULARY), END_ID)
    assert packed.count() == 0 and packing.sequences(packed).count() == 0


def test_cut_batch_of_scattered_rows():
    batch = pa.RecordBatch.from_arrays([pa.array([6, 0]), pa.array([1, None], pa.int64()), pa.array([9, 2]), pa.array([b"abcd" * 9, b"efgh" * 2], pa.binary())], names=["at", "doc_id", "doc_tokens", "ids"])
    rows = packing.cut_batch(batch, 8).to_pylist()
    assert [(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"], len(r["ids"])) for r in rows] == [(1, 0, 2, 0, 6, 8), (1, 2, 7, 1, 0, 28), (None, 0, 2, 0, 0, 8)]


def test_query(spark, encoded_by_library):
    sf = "/root/testdata/sf0.001"
    rows = op12_packing(spark, sf).collect()
    docs = {r.doc_id: encoded_by_library(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sum(r.length for r in rows) == sum(map(len, docs.values()))
    for r in rows:
        part = docs[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(docs[r.doc_id]) and r.ids_crc32 == zlib.crc32(packing._as_bytes(part))
