"""An index of vectors by coarse centroids: rows stored by the cell of their nearest centroid, a search reads the cells next to its queries.

Centroids are fitted on a bounded sample (``SAMPLE`` rows, by least hash) of unit vectors; every row is stored. ``probes`` cells are
read per query, as partitions of the stored table, and their rows are compared exactly. How many are needed for a wanted recall is measured
against the exact search (``recall``, ``probes_for``). A search with ``probes=None`` is exact: each cell knows the widest angle of
its rows to its centroid, so a cell is left out only if no row in it can be among the k best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.nearest import BLOCK_BYTES, Best, cosine_scores, matrix, tiles
from larder.operators.search import ranked, vector_search
from larder.sources.workdir import materialize

SAMPLE, ROUNDS, MOST_CELLS = 50_000, 12, 16_384


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def centroids(sample: np.ndarray, cells: int, seed: int = 42) -> np.ndarray:
    """Spherical k-means of unit rows: starts from rows drawn by the seed; a cell that loses all its rows keeps its centroid."""
    at = sample[np.random.default_rng(seed).permutation(len(sample))[:cells]]
    for _ in range(ROUNDS):
        own = np.concatenate([(sample[i : i + 4096] @ at.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        filled = np.linalg.norm(sums, axis=1) > 1e-12
        at = np.where(filled[:, None], _unit(sums), at)
    return at


@dataclass(frozen=True)
class VectorIndex:
    """path holds ``rows`` (doc_id, v, partitioned by cell) and ``cells`` (cell, centre, widest, n). Rows of no length are not in it: no search finds them."""

    spark: SparkSession
    path: str
    centre: np.ndarray
    cells: np.ndarray
    widest: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, id_col: str = "doc_id", vector_col: str = "embedding") -> VectorIndex:
        """Stores the vectors; ``cells``: the square root of the number of rows if not given."""
        rows = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(vector_col).alias("v"))
        n = rows.count()
        picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).toArrow()["v"].combine_chunks()
        dim = pa.compute.max(pa.compute.list_value_length(picked)).as_py() or 0 if len(picked) else 0
        sample, _ = matrix(picked, dim)
        sample = sample[np.linalg.norm(sample, axis=1) > 0]
        at = centroids(_unit(sample), min(cells or int(np.sqrt(n)) or 1, MOST_CELLS, max(1, len(sample)))) if len(sample) else np.zeros((1, max(1, dim)))
        kind = rows.schema["doc_id"].dataType.simpleString()

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found, where = matrix(batch.column(1), at.shape[1])
                kept = np.linalg.norm(found, axis=1) > 0
                found, where = found[kept], where[kept]
                near = _unit(found) @ at.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                part = batch.take(pa.array(where))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell, pa.int32()), pa.array(angle)], names=["doc_id", "v", "cell", "angle"])

        placed = materialize(rows.mapInArrow(place, f"doc_id {kind}, v {rows.schema['v'].dataType.simpleString()}, cell int, angle double"), "placed")
        # AQE splits a cell that holds very many rows; a cell has a file per task then
        placed.hint("rebalance", "cell").select("doc_id", "v", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
        facts = placed.groupBy("cell").agg(F.max("angle").alias("widest"), F.count(F.lit(1)).alias("n"))
        centre = vectors.sparkSession.createDataFrame(pa.table({"cell": pa.array(range(len(at)), pa.int32()), "centre": pa.array(list(at), pa.list_(pa.float64()))}))
        centre.join(facts, "cell").write.parquet(f"{path}/cells")
        return cls.open(vectors.sparkSession, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        found = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()  # MOST_CELLS rows at most
        centre = np.array(found["centre"].to_pylist(), dtype=float) if found.num_rows else np.zeros((0, 1))
        return cls(spark, path, centre, np.asarray(found["cell"]), np.asarray(found["widest"], dtype=float))

    def _probed(self, asked: np.ndarray, k: int, probes: int | None, floor: np.ndarray | None) -> np.ndarray:
        """queries x cells: which cells each query reads. ``floor``: score that each query's k-th row surely reaches."""
        near = np.clip(_unit(asked) @ self.centre.T, -1, 1) if len(self.centre) else np.zeros((len(asked), 0))
        if probes is not None:
            own = np.zeros(near.shape, dtype=bool)
            np.put_along_axis(own, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
            return own
        best = np.cos(np.maximum(0, np.arccos(near) - self.widest))
        return best + 1e-7 >= floor[:, None]

    def _read(self, cells: np.ndarray) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").where(F.col("cell").isin([int(c) for c in cells]))

    def files(self, probed: np.ndarray) -> tuple[int, int]:
        """Files that a search of these cells reads, and all files."""
        every = self.spark.read.parquet(f"{self.path}/rows").inputFiles()
        read = {f"cell={c}" for c in self.cells[probed.any(axis=0)]}
        return sum(f.rsplit("/", 2)[-2] in read for f in every), len(every)

    def _compare(self, names: pa.Array, asked: np.ndarray, own: np.ndarray | None, probed: np.ndarray, k: int) -> DataFrame:
        """The k best rows of every task for each query, among the cells it reads."""
        rows = self._read(self.cells[probed.any(axis=0)]).select("doc_id", "v", "cell")
        kind, query_kind = rows.schema["doc_id"].dataType.simpleString(), {pa.int64(): "bigint", pa.int32(): "int"}.get(names.type, "string")
        column = {int(c): i for i, c in enumerate(self.cells)}

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, doc_type = Best(len(asked), k), None
            for batch in batches:
                doc_type = batch.column(0).type
                found, at = matrix(batch.column(1), asked.shape[1])
                ids, cells = batch.column(0).take(pa.array(at)).to_numpy(zero_copy_only=False), np.asarray(batch.column(2))[at]
                ids = ids.astype(str) if ids.dtype == object else ids
                for c in np.unique(cells):
                    who, here = np.flatnonzero(probed[:, column[int(c)]]), np.flatnonzero(cells == c)
                    for q, d in tiles(len(who), len(here)):
                        kept.offer(who[q], cosine_scores(asked[who[q]], found[here[d]]), ids[here[d]], own)
            yield from kept.batch(names, doc_type)

        return rows.mapInArrow(best, f"query_id {query_kind}, doc_id {kind}, score double")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exclude_self: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
        """As ``vector_search``. Queries are taken in blocks of ``block_bytes``. Exact (``probes`` null) first reads the nearest cells
        that hold k rows, then every other cell that can still change the k best."""
        asked = queries.where("query_id is not null and vector is not null").select("query_id", F.col("vector").alias("v"))
        if not len(self.cells):
            return ranked(asked.select("query_id", F.lit(None).cast("long").alias("doc_id"), F.lit(0.0).alias("score")).where("false"), "score", k)
        n, out = asked.count(), None
        per_block = max(1, block_bytes // (8 * (self.centre.shape[1] + 2 * k + len(self.cells) // 8 + 1)))
        blocks = max(1, -(-n // per_block))
        for block in range(blocks):
            part = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).toArrow()
            found, at = matrix(part["v"], self.centre.shape[1])
            names = part["query_id"].combine_chunks().take(pa.array(at))
            own = None
            if exclude_self:
                own = names.to_numpy(zero_copy_only=False)
                own = own.astype(str) if own.dtype == object else own
            if probes is None:
                near = self._probed(found, k, max(1, min(len(self.cells), 4)), None)
                first = materialize(ranked(self._compare(names, found, own, near, k), "score", k).drop("rank"), "nearest")
                got = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).toArrow()
                floors = dict(zip(got["query_id"].to_pylist(), got["floor"].to_pylist(), strict=True))  # a row per query of the block
                floor = np.array([floors.get(q, -2.0) for q in names.to_pylist()])
                rest = self._probed(found, k, None, floor) & ~near
                hits = first.unionByName(self._compare(names, found, own, rest, k)) if rest.any() else first
            else:
                hits = self._compare(names, found, own, self._probed(found, k, probes, None), k)
            hits = hits if blocks == 1 else materialize(hits, "nearest")
            out = hits if out is None else out.unionByName(hits)
        return ranked(out, "score", k)

    def recall(self, vectors: DataFrame, queries: DataFrame, k: int, probes: int, **how: str) -> float:
        """Share of the exact search's k best that a search with so many probes finds, over all these queries and rows."""
        exact = materialize(vector_search(vectors, queries, k, **how).select("query_id", "doc_id"), "exact")
        found = exact.join(self.search(queries, k, probes).select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").count()
        return found / max(1, exact.count())

    def probes_for(self, vectors: DataFrame, queries: DataFrame, k: int, least: float = 0.9, **how: str) -> tuple[int, float]:
        """(probes, recall): the fewest probes, by doubling, that reach the recall for these queries."""
        probes = 1
        while True:
            got = self.recall(vectors, queries, k, probes, **how)
            if got >= least or probes >= len(self.cells):
                return min(probes, len(self.cells)), got
            probes *= 2
