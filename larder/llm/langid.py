"""Operator 5: language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams over the whole text. Document frequencies
count every learnable document. Weights are trained by follow-the-regularised-leader with an
elastic-net penalty on a bounded sample, alike for every language; a temperature fitted on a part
of the sample that training did not see calibrates the probabilities.

Bounds: about ``SAMPLE_ROWS`` labelled documents fit the classifier, alike for every language: those whose hash lies
under their language's share, repeated rows once. Languages themselves are few: their sizes, one row each, are
collected. Everything else covers all rows and whole texts.

Defined results: text that is null or has no letter (Unicode's L) is ``und`` with score 0, as is every text
when nothing can be learned; a null doc_id is neither learned from nor held out; repeated rows each
get their own result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import pieces

BITS = 14
DIM = 1 << BITS
SAMPLE_ROWS = 4000
NGRAMS = 3
#: Letters of a text whose n-grams are counted at once.
PART = 1_000_000
#: A letter in Unicode's sense, the same here and in the filter of learnable rows; number-like signs such as a half or a Roman numeral are none.
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the letters of a text, words apart by one space: bucket numbers and counts."""
    clean = f" {_OTHER.sub(' ', text.lower()).strip()} "
    total = np.zeros(DIM, dtype=np.int64)
    for start in range(0, len(clean), PART):  # a part's n-grams begin in it and end up to two letters behind it
        c = np.frombuffer(clean[start : start + PART + NGRAMS - 1].encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        code = np.zeros(len(c), dtype=np.uint64)
        for n in range(1, NGRAMS + 1):
            if len(c) < n:
                break
            code = code[: len(c) - n + 1] * np.uint64(1_114_111) + c[n - 1 :] + np.uint64(n)
            total += np.bincount((code[:PART] * _MIX >> np.uint64(64 - BITS)).astype(np.int64), minlength=DIM)
    at = np.flatnonzero(total)
    return at, total[at]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def document_frequencies(learnable: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts hold each bucket, over all learnable rows, and the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIM + 1, dtype=np.int64), 0
        for piece in pieces(batches):
            for text in piece.column(0).to_pylist():
                total[ngram_counts(text)[0]] += 1
                n += 1
        total[DIM] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    rows = learnable.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIM + 1, dtype=np.int64)
    for r in rows:  # DIM + 1 rows at most
        out[r.bucket] = r.n
    return out[:DIM], int(out[DIM])


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / (np.sqrt(v @ v) or 1.0)


class Rows:
    """Rows of (buckets, weights) over the columns of an Arrow table; weights are made when a row is read."""

    def __init__(self, at: pa.ListArray, counts: pa.ListArray, order: np.ndarray, idf: np.ndarray):
        self.ends, self.at, self.counts = np.asarray(at.offsets), np.asarray(at.values), np.asarray(counts.values)
        self.order, self.idf = order, idf

    def __len__(self) -> int:
        return len(self.order)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.ends[self.order[i]], self.ends[self.order[i] + 1])
        at = self.at[own].astype(np.int64)
        return at, weigh(self.counts[own].astype(float), self.idf[at])

    def part(self, which: np.ndarray) -> Rows:
        out = object.__new__(Rows)
        out.__dict__ = self.__dict__ | {"order": self.order[which]}
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: Sequence[tuple[np.ndarray, np.ndarray]] | Rows, y: np.ndarray, classes: int, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """Weights (DIM x classes) by FTRL-proximal with L1 and L2 penalties; rows are (buckets, values)."""
    z, n = np.zeros((DIM, classes)), np.zeros((DIM, classes))
    order = np.random.default_rng(7)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            w = weights(at)
            p = softmax(v @ w)
            p[y[i]] -= 1.0
            g = v[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by a grid on a log scale."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(5.0), 60))
    loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> dict:
    """The model: labels, idf, weight, temperature. Held-out documents are never read here."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    learnable = df.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike("\\p{L}"))
    sizes = {r["lang"]: r["count"] for r in learnable.groupBy("lang").count().collect()}
    labels = sorted(sizes)
    if not labels:
        return {"labels": [], "idf": np.zeros(DIM), "weight": np.zeros((DIM, 0)), "temperature": 1.0}
    df_counts, n = document_frequencies(learnable)
    idf = np.log((1.0 + n) / (1.0 + df_counts)) + 0.1
    each = sample_rows / len(labels)
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, each / sizes[k])) for k in labels], "lang string, share double")
    mark = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    picked = learnable.join(F.broadcast(shares), "lang").where(mark < F.col("share") * (1 << 30)).select("doc_id", "text", "lang").distinct()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            got = [ngram_counts(t) for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array([a for a, _ in got], pa.list_(pa.int32())), pa.array([c for _, c in got], pa.list_(pa.int32()))], names=["doc_id", "lang", "at", "n"])

    # two columns of whole numbers, 8 bytes for each distinct bucket of a sampled text: at most DIM of them
    sample = picked.mapInArrow(vectors, "doc_id bigint, lang string, at array<int>, n array<int>").toArrow().combine_chunks()
    ids, langs = sample["doc_id"].to_pylist(), sample["lang"].to_pylist()
    at, counts = (sample[c].combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.int32())) for c in ("at", "n"))
    whole = Rows(at, counts, np.arange(len(ids)), idf)
    digest = lambda i: whole.at[whole.ends[i] : whole.ends[i + 1]].tobytes()
    whole.order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], langs[i], digest(i))), dtype=int)
    y = np.array([labels.index(langs[i]) for i in whole.order], dtype=int)
    check = np.arange(len(whole)) % 5 == 4
    weight = fit_ftrl(whole.part(~check), y[~check], len(labels))
    tested = whole.part(check)
    logits = np.array([v @ weight[a] for a, v in (tested[i] for i in range(len(tested)))]).reshape(-1, len(labels))
    return {"labels": labels, "idf": idf, "weight": weight.astype(np.float32), "temperature": fit_temperature(logits, y[check])}


def predictor(model: dict):
    """text -> (language, score)."""
    labels, idf, weight, heat = model["labels"], model["idf"], model["weight"], model["temperature"]

    def predict(text: str | None) -> tuple[str, float]:
        if not text or not labels or not _LETTER.search(text):
            return "und", 0.0
        at, counts = ngram_counts(text)
        p = softmax(weigh(counts, idf[at]) @ weight[at] / heat)
        best = int(p.argmax())
        return labels[best], float(p[best])

    return predict


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: dict | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score."""
    predict = predictor(model or train(docs, id_col, text_col, lang_col))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            got = [predict(t) for t in piece.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.float64())], schema=schema)

    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col).cast("long")).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return df.mapInArrow(scan, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.5, text_col: str = "text", model: dict | None = None) -> DataFrame:
    """The rows, all columns unchanged, whose language is known with a score of ``least`` or more."""
    predict = predictor(model or train(docs))
    at = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text=text_col):
            got = [predict(t) for t in piece.column(at).to_pylist()]
            yield piece.filter(pa.array([lang != "und" and score >= least for lang, score in got], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
