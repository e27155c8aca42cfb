from __future__ import annotations

import random
import zlib

import numpy as np

from larder.llm import langid
from tests.llm.conftest import make_docs, sentence


def words_like(r, letters):
    return ["".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(150)]


def test_held_out_accuracy_and_edges(spark, edge_rows):
    r = random.Random(1)
    tongues = {"aa": words_like(r, "aeioulmn"), "bb": words_like(r, "aeioukrtz"), "cc": words_like(r, "äöüsch")}
    rows = [(i, sentence(r, 40, tongues[k]), k, "s") for i in range(400) for k in [r.choice(list(tongues))]]
    odd = [(1000 + i, *x[1:]) for i, x in enumerate(edge_rows) if x[1] is None or not langid._LETTER.search(x[1])]
    docs = make_docs(spark, rows + odd)
    got = {x.doc_id: x for x in langid.identify(docs).collect()}
    assert len(got) == len(rows) + len(odd)
    for i, _, _, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
    held = [(got[i].lang_pred, k) for i, _, k, _ in rows if got[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.98
    assert all(got[x[0]].lang_pred == "und" and got[x[0]].score == 0 for x in odd)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_held_out_labels_are_never_read(spark):
    r = random.Random(3)
    a, b = words_like(r, "aeiou"), words_like(r, "xyzkt")
    rows = [(i, sentence(r, 20, a if i % 2 else b), "a" if i % 2 else "b", "s") for i in range(200)]
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else k, s) for i, t, k, s in rows]
    one, two = (sorted(map(tuple, langid.identify(make_docs(spark, x)).collect())) for x in (rows, wrong))
    assert one == two


def test_nothing_to_learn(spark):
    docs = make_docs(spark, [(1, "some text", None, "s"), (None, "more", "en", "s")])
    assert {x.lang_pred for x in langid.identify(docs).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_temperature_lowers_log_loss():
    r = np.random.default_rng(0)
    y = r.integers(0, 3, 300)
    logits = 20 * (np.eye(3)[y] * 0.3 + r.normal(size=(300, 3)))
    t = langid.fit_temperature(logits, y)
    loss = lambda k: -np.log(langid.softmax(logits / k)[np.arange(300), y] + 1e-12).mean()
    assert loss(t) <= loss(1.0)


def test_signs_that_are_no_letters(spark):
    r = random.Random(3)
    a, b = words_like(r, "aeiou"), words_like(r, "xyzkt")
    rows = [(i, sentence(r, 20, a if i % 2 else b), "a" if i % 2 else "b", "s") for i in range(100)]
    odd = [(1000 + i, t, "a", "s") for i, t in enumerate(["½ ²", "Ⅷ", "12 _ 3", "①", "٣"])]
    got = {x.doc_id: x.lang_pred for x in langid.identify(make_docs(spark, rows + odd)).collect()}
    assert {got[x[0]] for x in odd} == {"und"} and got[1] == "a"


def test_sample_is_bounded_and_repeated_rows_count_once(spark):
    r = random.Random(4)
    a, b = words_like(r, "aeiou"), words_like(r, "xyzkt")
    rows = [(i, sentence(r, 20, a if i % 2 else b), "a" if i % 2 else "b", "s") for i in range(200)]
    once, often = (langid.predictor(langid.train(make_docs(spark, x), sample_rows=10_000)) for x in (rows, rows + rows[:1] * 500))
    assert all(once(t)[0] == often(t)[0] == k for _, t, k, _ in rows)  # 500 copies do not outweigh the others
    few = langid.train(make_docs(spark, rows), sample_rows=1)
    assert few["labels"] == ["a", "b"]


def plain_ngrams(text):
    """Hashed n-grams one at a time, with whole numbers of 64 bits."""
    words = "".join(c if langid._OTHER.sub("", c) else " " for c in text.lower()).split()
    clean, mask, out = f" {' '.join(words)} ", 2**64 - 1, {}
    for n in range(1, langid.NGRAMS + 1):
        for i in range(len(clean) - n + 1):
            code = 0
            for k in range(n):
                code = (code * 1_114_111 + ord(clean[i + k]) + k + 1) & mask
            bucket = (code * 0x9E3779B97F4A7C15 & mask) >> (64 - langid.BITS)
            out[bucket] = out.get(bucket, 0) + 1
    return out


def test_ngrams_equal_plain_counts_whatever_the_parts(monkeypatch):
    texts = ["a", "Hello, Wörld 12!", "  ", "ß İ ǅ", "日本語 текст 🙂 é", "one two three four " * 5]
    for part in (1_000_000, 7, 1):
        monkeypatch.setattr(langid, "PART", part)
        for text in texts:
            at, n = langid.ngram_counts(text)
            assert dict(zip(at.tolist(), n.tolist(), strict=True)) == plain_ngrams(text)


def test_ftrl_equals_a_plain_loop(monkeypatch):
    import math

    monkeypatch.setattr(langid, "DIM", 12)
    r = np.random.default_rng(4)
    rows = [(np.sort(r.choice(12, 4, replace=False)), r.random(4)) for _ in range(30)]
    y = r.integers(0, 3, 30)
    got = langid.fit_ftrl(rows, y, 3, epochs=2)
    z, n, order = [[0.0] * 3 for _ in range(12)], [[0.0] * 3 for _ in range(12)], np.random.default_rng(7)

    def weight(b, k):
        if abs(z[b][k]) <= 0.02:
            return 0.0
        return -(z[b][k] - math.copysign(0.02, z[b][k])) / ((1 + math.sqrt(n[b][k])) / 1.0 + 0.02)

    for _ in range(2):
        for i in order.permutation(30):
            at, v = rows[i]
            score = [sum(x * weight(b, k) for b, x in zip(at, v, strict=True)) for k in range(3)]
            total = sum(math.exp(s) for s in score)
            g = {(b, k): x * (math.exp(score[k]) / total - (y[i] == k)) for b, x in zip(at, v, strict=True) for k in range(3)}
            w = {key: weight(*key) for key in g}
            for (b, k), d in g.items():
                z[b][k] += d - (math.sqrt(n[b][k] + d * d) - math.sqrt(n[b][k])) * w[b, k]
                n[b][k] += d * d
    assert np.allclose(got, [[weight(b, k) for k in range(3)] for b in range(12)])
