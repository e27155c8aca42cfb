"""The k best rows for every query of a set, by any score of two matrices, in one pass over the rows.

The queries go to the tasks as one matrix, as many at a time as ``BLOCK_BYTES`` hold with their k best (tens of
thousands); a larger set takes a pass for each such block, whose results are written to the shared folder before the next
block is read. A task compares ``CELLS`` pairs at a time and holds k candidates per query and about as many that wait to be
sorted in, so its memory depends neither on the rows nor on the number of queries, and what is shuffled is k rows per query and task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.sources.workdir import materialize

#: Bytes of a block of queries with their candidates.
BLOCK_BYTES = 32_000_000
#: Scores computed at once, and queries among them at most: a few megabytes, which stay in the cache.
CELLS, ASKED = 500_000, 2_000

#: (queries, rows) -> score of each pair, the larger the better, NaN for none.
Score = Callable[[np.ndarray, np.ndarray], np.ndarray]


def cosine_scores(asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of each query and row to 9 places, so that equal rows tie; NaN where either has length zero."""
    scale = np.outer(np.linalg.norm(asked, axis=1), np.linalg.norm(rows, axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.round(np.where(scale > 0, (asked @ rows.T) / scale, np.nan), 9)


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists of length ``dim`` in a list column as one matrix, and their places; nulls and other lengths are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.flatnonzero((np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), -1)) == dim))
    flat = column.take(pa.array(at)).flatten()
    return np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(len(at), dim), at


def first_k(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row: highest score, then least id; ordered by row."""
    order = np.lexsort((ids, -score, row))
    new = np.concatenate([[True], row[order][1:] != row[order][:-1]]) if len(order) else np.zeros(0, dtype=bool)
    start = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order)))
    return order[rank < k]


class Best:
    """The k best rows of each of n queries among those offered so far; candidates wait until there are as many as are held."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.floor = np.full(n, np.finfo(float).min)  # what a query's next candidate must reach
        self.row, self.value, self.doc = np.zeros(0, dtype=np.int64), np.zeros(0), None
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.most, self.n_waiting = max(n * k, CELLS // 2), 0

    def offer(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray | None = None) -> None:
        """``scores``: queries ``who`` x rows ``ids``, NaN for none; it is written to. ``own``: a row that each query must not find."""
        scores[np.isnan(scores)] = -np.inf
        least, k, rows = self.floor[who], self.k + (own is not None), scores.shape[1]
        hit = scores >= least[:, None]
        if rows > k and np.count_nonzero(hit) > 2 * k * len(who):  # of these rows alone, only the k best and their ties can stay
            hit = scores >= np.maximum(least, np.partition(scores, rows - k, axis=1)[:, rows - k])[:, None]
        q, d = np.nonzero(hit)
        if own is not None:
            apart = own[who[q]] != ids[d]
            q, d = q[apart], d[apart]
        if len(q):
            self.waiting.append((who[q], scores[q, d], ids[d]))
            self.n_waiting += len(q)
            if self.n_waiting >= self.most:
                self._sort_in()

    def _sort_in(self) -> None:
        rows, values, docs = zip(*self.waiting, strict=True)
        held = [] if self.doc is None else [self.doc]
        row, value, doc = np.concatenate([self.row, *rows]), np.concatenate([self.value, *values]), np.concatenate([*held, *docs])
        kept = first_k(row, value, doc, self.k)
        self.row, self.value, self.doc, self.waiting, self.n_waiting = row[kept], value[kept], doc[kept], [], 0
        last = np.flatnonzero(np.append(self.row[1:] != self.row[:-1], True))
        full = np.bincount(self.row, minlength=len(self.floor))[self.row[last]] >= self.k
        self.floor[self.row[last[full]]] = self.value[last[full]]

    def batch(self, queries: pa.Array, doc_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """query_id, doc_id, score of what was kept, if anything."""
        if self.waiting:
            self._sort_in()
        if self.doc is not None:
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(self.row)), pa.array(self.doc, doc_type), pa.array(self.value)], names=["query_id", "doc_id", "score"])


def tiles(n: int, rows: int) -> Iterator[tuple[slice, slice]]:
    """Queries x rows in parts of about ``CELLS`` pairs."""
    width = min(n, ASKED)
    step = max(1, CELLS // max(1, width))
    for s in range(0, rows, step):
        for a in range(0, n, ASKED):
            yield slice(a, a + ASKED), slice(s, s + step)


def _best_in_task(corpus: DataFrame, ids: pa.Array, asked: np.ndarray, own: np.ndarray | None, k: int, score: Score) -> DataFrame:
    dim, n = asked.shape[1], len(asked)
    kind = corpus.schema["doc_id"].dataType.simpleString()
    query_kind = {pa.int64(): "bigint", pa.int32(): "int"}.get(ids.type, "string")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, doc_type, every = Best(n, k), None, np.arange(n)
        for batch in batches:
            doc_type = batch.column(0).type
            rows, at = matrix(batch.column(1), dim)
            names = batch.column(0).take(pa.array(at)).to_numpy(zero_copy_only=False)
            names = names.astype(str) if names.dtype == object else names
            for q, d in tiles(n, len(rows)):
                found.offer(every[q], score(asked[q], rows[d]), names[d], own)
        yield from found.batch(ids, doc_type)

    return corpus.select("doc_id", "v").mapInArrow(best, f"query_id {query_kind}, doc_id {kind}, score double")


def nearest(corpus: DataFrame, queries: DataFrame, k: int, score: Score) -> DataFrame:
    """query_id, doc_id, score: the k best rows of every task for each query, among them the k best of all; rank them where they meet.

    ``corpus``: doc_id, v (list of numbers); ``queries``: query_id, v and, if a row must not be found by its own query, own (its doc_id).
    Ids are numbers or texts; a row or query with a null id is left out, as is a vector whose length is not that of the queries.
    """
    asked = queries.where("query_id is not null and v is not null")
    sizes = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    per_block = max(1, BLOCK_BYTES // (8 * ((sizes.dim or 0) + 2 * k)))
    blocks = max(1, -(-sizes.n // per_block))
    rows, out = corpus.where("doc_id is not null"), None
    for block in range(blocks):
        part = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).toArrow()
        vectors, at = matrix(part["v"], sizes.dim or 0)
        part = part.take(pa.array(at))
        own = None
        if "own" in part.column_names:
            own = part["own"].to_numpy()
            own = own.astype(str) if own.dtype == object else own
        found = _best_in_task(rows, part["query_id"].combine_chunks(), vectors, own, k, score)
        found = found if blocks == 1 else materialize(found, "nearest")
        out = found if out is None else out.unionByName(found)
    return out
