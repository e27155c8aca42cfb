"""A learned encoder: latent semantic vectors by randomised SVD over hashed TF-IDF.

Fitting takes a few passes over the texts, each with sums alone between tasks and driver: document frequencies, the range finder
(features x directions, twice), and the Gram matrix in the found directions. The driver holds matrices of ``FEATURES`` x (dim +
``EXTRA``) numbers whatever the vocabulary and the number of texts. Encoding is one product per text; the weights are
part of the job and are read once per worker process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import tokenize

#: Hashed terms, directions beyond the wanted ones, rows of the feature matrix that travel as one.
FEATURES, EXTRA, STRIP = 16_384, 10, 256


def term_ids(text: Column, features: int) -> Column:
    """Hashed ids of a text's tokens, repeats included; null has none."""
    return F.transform(tokenize(text), lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int"))


def weigh(ids: pa.ListArray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, weight) of the unit TF-IDF rows of a batch: (1 + ln count) * idf; a row without tokens has none."""
    sizes = np.diff(np.asarray(ids.offsets))
    flat = np.asarray(ids.flatten()).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    cell, count = np.unique(row * len(idf) + flat, return_counts=True)
    row, feature = np.divmod(cell, len(idf))
    weight = (1 + np.log(count)) * idf[feature]
    norm = np.sqrt(np.bincount(row, weight**2, minlength=len(sizes)))[row]
    return row, feature, weight / np.where(norm > 0, norm, 1.0)


def _times(row: np.ndarray, feature: np.ndarray, weight: np.ndarray, matrix: np.ndarray, n: int) -> np.ndarray:
    """Sparse rows times a matrix, a thousand or so cells at a time; cells of one row are summed side by side."""
    out = np.zeros((n, matrix.shape[1]))
    if len(row) and (row[1:] < row[:-1]).any():
        order = np.argsort(row, kind="stable")
        row, feature, weight = row[order], feature[order], weight[order]
    for i in range(0, len(row), 65_536):
        here = row[i : i + 65_536]
        start = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
        out[here[start]] += np.add.reduceat(weight[i : i + 65_536, None] * matrix[feature[i : i + 65_536]], start, axis=0)
    return out


def _sum_strips(parts: DataFrame, width: int) -> np.ndarray:
    """Rows (strip, data) of equal shapes, summed over tasks and put together; the sums are FEATURES x width numbers at most."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"strip": [pdf["strip"].iloc[0]], "data": [sum(np.frombuffer(d) for d in pdf["data"]).tobytes()]})

    found = parts.groupBy("strip").applyInPandas(add, "strip int, data binary").orderBy("strip").toArrow()
    return np.concatenate([np.frombuffer(d).reshape(-1, width) for d in found["data"].to_pylist()]) if found.num_rows else np.zeros((0, width))


@dataclass(frozen=True)
class LatentEncoder:
    """idf of every hashed term and the projection of unit TF-IDF rows; made by ``fit``."""

    idf: np.ndarray
    projection: np.ndarray
    singular: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, text: Column, dim: int = 64, features: int = FEATURES, seed: int = 42, rounds: int = 2) -> LatentEncoder:
        """``rounds``: passes of the range finder; each brings the directions closer to those of the exact decomposition."""
        ids = df.select(term_ids(text, features).alias("ids"))
        facts = ids.select(F.explode(F.array_distinct("ids")).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("df")).toArrow()  # a row per hashed term
        n = df.count()
        counts = np.zeros(features)
        counts[np.asarray(facts["i"])] = np.asarray(facts["df"])
        idf = np.log((1 + n) / (1 + counts)) + 1
        width = min(dim + EXTRA, features)

        basis: np.ndarray | None = None

        def range_finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start = np.random.default_rng(seed).normal(size=(features, width)) if basis is None else basis
            total, some = np.zeros((features, width)), False
            for batch in batches:
                row, feature, weight = weigh(batch.column(0), idf)
                low = _times(row, feature, weight, start, batch.num_rows)
                total += _times(feature, row, weight, low, features)
                some = True
            if some:
                strips = [total[i : i + STRIP].tobytes() for i in range(0, features, STRIP)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(strips)), pa.int32()), pa.array(strips, pa.binary())], names=["strip", "data"])

        for _ in range(rounds):
            found = _sum_strips(ids.mapInArrow(range_finder, "strip int, data binary"), width)
            if not len(found):
                return cls(idf, np.zeros((features, dim)), np.zeros(dim))
            basis, _ = np.linalg.qr(found)

        def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, width))
            for batch in batches:
                low = _times(*weigh(batch.column(0), idf), basis, batch.num_rows)
                total += low.T @ low
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["strip", "data"])

        values, directions = np.linalg.eigh(_sum_strips(ids.mapInArrow(gram, "strip int, data binary"), width))
        order = np.argsort(-values)[:dim]
        projection = basis @ directions[:, order]
        projection *= np.where(projection[np.abs(projection).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)  # a sign that does not hang on the order of sums
        return cls(idf, projection, np.sqrt(np.maximum(values[order], 0)))

    def encode(self, df: DataFrame, text: Column, out: str = "embedding") -> DataFrame:
        """Adds unit vectors (zero where a text has no token, null where it is null), in Arrow batches."""
        idf, projection = self.idf, self.projection.astype(np.float32)

        @F.pandas_udf("array<float>")
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                some = s.notna().to_numpy()
                ids = pa.array([x for x in s[some]], pa.list_(pa.int32()))
                low = _times(*weigh(ids, idf), projection, len(ids)) if len(ids) else np.zeros((0, projection.shape[1]))
                norm = np.linalg.norm(low, axis=1, keepdims=True)
                got = pd.Series([None] * len(s), dtype=object)
                got[some] = pd.Series(list((low / np.where(norm > 0, norm, 1)).astype(np.float32)), index=np.flatnonzero(some), dtype=object)
                yield got

        known = F.when(text.isNotNull(), term_ids(text, len(self.idf)))
        return df.withColumn("_ids", known).withColumn(out, vectors("_ids")).drop("_ids")
