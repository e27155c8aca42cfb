from __future__ import annotations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from larder.llm import decontam, langid, pii
from tests.llm.test_decontam import brute
from tests.llm.test_simhash import brute_classes, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "encoding"]


def test_against_brute_force(spark):
    """Every stage again, row by row in Python, with the models that the operators train."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    predict = langid.predictor(langid.train(docs))
    rows = [x for x in rows if (lambda p: p[0] != "und" and p[1] >= 0.5)(predict(x[1]))]
    root = brute_classes([brute_fingerprint(t) for _, t in rows])
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root[i]] = min(least.get(root[i], d), d)
    rows = [x for x in rows if x[0] in set(least.values())]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [x for x in rows if not brute(x[1], items)[-1]]
    after = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(after)
    base = [pii.base_spans(t) for _, t in rows]
    clean = [pii.redacted(t, b + a) for (_, t), b, a in zip(rows, base, pii.added_spans(model, [t for _, t in rows], base), strict=True)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((d, library.encode(t, add_special_tokens=False).ids) for (d, _), t in zip(rows, clean, strict=True))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in got) == want
    assert all(r.round_trip for r in got)


def test_edges(spark, edge_rows, monkeypatch):
    from tests.llm.conftest import make_docs

    docs = make_docs(spark, edge_rows)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        if name != "encoding":
            assert got.columns == docs.columns
        got.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("text", ["", "!!!", "1 2 3"])
def test_words_of_nothing(text):
    assert decontam.bench_words(text) in ([], ["1", "2", "3"])
