"""Operator 13: hard negatives by threshold joins after L2AP.

Dimensions are ordered by their energy over all rows and read in chunks. For every chunk boundary the norms of what remains
bound the rest of a score, for rows and anchors alike. A task takes its rows a block at a time and

* indexes a row only in the chunks before its suffix norm, times any anchor's, falls under that anchor's threshold: a pair that met
  in the omitted dimensions alone cannot reach it;
* accumulates partial scores chunk by chunk over the rows a chunk holds, and drops a pair once its partial score and the
  remaining norms cannot reach the anchor's threshold; what survives is completed from the omitted dimensions and verified;
* keeps the first few rows of every window, and raises its own thresholds to the last of them once all of an anchor's are full.

Thresholds start at what a sample of rows (``SAMPLE_ROWS``, by least hash) suggests, and are lowered for the anchors whose windows did
not fill, at last to the window's own end; so the sample decides how many rounds there are, never what is found.
Anchors are taken in blocks of ``BLOCK_BYTES``; only the block goes to the tasks and what it found comes back. Scores are integers, exact.

Defined results: rows without id, label or vector, or with a null component, take no part; an anchor's other rows are those of
another id; rows that repeat an id are anchors and candidates of their own; vectors of unequal length are filled with zeros; equal scores
go by smaller id; an anchor without positives or a positive below zero has no window; empty tables give no rows. Other
columns are ignored. Scores beyond 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import materialize, shared_dir

#: Dimensions read between two prunings, scores computed at once, bytes of a block of anchors, rows of the sample that thresholds start from.
CHUNK, CELLS, BLOCK_BYTES, SAMPLE_ROWS = 8, 2_000_000, 8_000_000, 4_096
#: Share of pairs left below which they are followed one by one.
SPARSE = 0.1
FOUND = "slot bigint, vec_id bigint, score bigint"
NONE = -np.inf


def matrix(column: pa.ListArray, dim: int, order: np.ndarray | None = None, kind=np.float64) -> np.ndarray:
    """A list column as a matrix with zeros behind short rows."""
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), dim), dtype=kind)
    flat = np.asarray(column.flatten())
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out if order is None else out[:, order]


def suffix_norms(x: np.ndarray) -> np.ndarray:
    """Norm of what remains of each row at each chunk boundary, a little too large rather than too small."""
    squares = np.square(x.astype(np.float64))
    per_chunk = np.add.reduceat(squares, np.arange(0, x.shape[1], CHUNK), axis=1)
    left = np.cumsum(per_chunk[:, ::-1], axis=1)[:, ::-1]
    return np.concatenate([np.sqrt(left) * (1 + 1e-9), np.zeros((len(x), 1))], axis=1)


def first_k(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each slot, ordered by slot, then score, then least id."""
    order = np.lexsort((ids, -score, slot))
    s = slot[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, dtype=int)
    return order[np.arange(len(s)) - np.repeat(start, np.diff(start, append=len(s))) < k]


class Anchors:
    """A block of anchors with their windows: for each anchor, lower and upper bounds of score, several windows or one."""

    def __init__(self, names, labels, vectors, low, high):
        self.names, self.labels, self.vectors, self.low, self.high = names, labels, vectors, low, high
        self.norms = suffix_norms(vectors)

    def part(self, which: np.ndarray) -> Anchors:
        return Anchors(self.names[which], self.labels[which], self.vectors[which], self.low[which], self.high[which])


def pairs_above(asked: Anchors, at: np.ndarray, x: np.ndarray, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs with a score of at least the anchor's threshold ``at``; ``allowed``: pairs that count."""
    a, norms, chunks = asked.vectors, suffix_norms(x), -(-x.shape[1] // CHUNK)
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.where(asked.norms[:, :-1] > 0, at[:, None] / asked.norms[:, :-1], np.where(at > 0, np.inf, NONE)[:, None]).min(axis=0)
    covered = norms[:, :-1] < reach  # from this boundary on no anchor reaches its threshold
    cut = np.where(covered.any(axis=1), covered.argmax(axis=1), chunks)
    by_cut = np.argsort(-cut, kind="stable")
    by_cut = by_cut[cut[by_cut] > 0]  # rows that the index holds at all
    x, norms, cut = x[by_cut], norms[by_cut], cut[by_cut]
    partial = np.zeros((len(a), len(x)), dtype=x.dtype)
    alive = np.ones(partial.shape, dtype=bool) if allowed is None else allowed[:, by_cut]
    held, done = np.searchsorted(-cut, -np.arange(chunks), side="left"), 0  # rows with a cut beyond the chunk
    while done < chunks and held[done] and alive.any() and (not done or alive.mean() > SPARSE):
        own = slice(done * CHUNK, (done + 1) * CHUNK)
        n = held[done]
        partial[:, :n] += a[:, own] @ x[:n, own].T
        done += 1
        rest = np.minimum(done, cut)  # rows with an earlier cut wait at it
        alive &= partial + asked.norms[:, rest] * norms[np.arange(len(x)), rest] >= at[:, None]
    i, j = np.nonzero(alive)
    score = partial[i, j]
    for c in range(chunks):  # the pairs that are left, in the dimensions not yet counted
        own = slice(c * CHUNK, (c + 1) * CHUNK)
        todo = np.flatnonzero(c >= np.minimum(done, cut[j]))
        score[todo] += np.einsum("ij,ij->i", a[i[todo], own], x[j[todo], own])
        keep = np.ones(len(i), dtype=bool)
        keep[todo] = score[todo] + asked.norms[i[todo], c + 1] * norms[j[todo], c + 1] >= at[i[todo]]
        i, j, score = i[keep], j[keep], score[keep]
    return i, by_cut[j], score


def search(rows: DataFrame, asked: Anchors, at: np.ndarray, same: bool, k: int, order: np.ndarray, kind) -> DataFrame:
    """slot, vec_id, score: in every task, the first k rows of each window with scores of at least the anchor's threshold.

    ``same``: rows of the anchor's label and another id, else rows of another label. Slot: anchor's place times windows plus the window's.
    """
    windows, dim = asked.low.shape[1], asked.vectors.shape[1]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, value, doc = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=kind), np.zeros(0, dtype=np.int64))
        floor = at.copy()
        step = max(64, CELLS // max(1, len(asked.names)))
        for batch in batches:
            ids, labels = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            vectors = matrix(batch.column(2), dim, order, kind)
            groups = [(asked.labels == v, labels == v) for v in np.intersect1d(asked.labels, labels)] if same else [(None, None)]
            for who, which in groups:
                mine = np.arange(len(asked.names)) if who is None else np.flatnonzero(who)
                theirs = np.arange(len(ids)) if which is None else np.flatnonzero(which)
                part = asked if who is None else asked.part(mine)
                for s in range(0, len(theirs), step):
                    here = theirs[s : s + step]
                    allowed = part.names[:, None] != ids[here] if same else part.labels[:, None] != labels[here]
                    i, j, score = pairs_above(part, floor[mine], vectors[here], allowed)
                    i, j = mine[i], here[j]
                    in_window = (asked.low[i] <= score[:, None]) & (score[:, None] <= asked.high[i])
                    p, w = np.nonzero(in_window)
                    slot, value, doc = np.concatenate([slot, i[p] * windows + w]), np.concatenate([value, score[p]]), np.concatenate([doc, ids[j[p]]])
                    kept = first_k(slot, value, doc, k)
                    slot, value, doc = slot[kept], value[kept], doc[kept]
                    least = np.full(asked.low.size, NONE)
                    full = np.bincount(slot, minlength=least.size) >= k
                    np.copyto(least, np.inf, where=(asked.low > asked.high).ravel())
                    last = np.flatnonzero(np.append(slot[1:] != slot[:-1], True)) if len(slot) else []
                    least[slot[last]] = np.where(full[slot[last]], value[last], NONE)
                    raised = least.reshape(asked.low.shape).min(axis=1)
                    floor = np.maximum(floor, np.where(np.isfinite(raised), raised, NONE))
        if len(slot):
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(doc), pa.array(value.astype(np.int64))], names=["slot", "vec_id", "score"])

    found = rows.mapInArrow(best, FOUND)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k)


def fill(rows: DataFrame, asked: Anchors, guess: np.ndarray, same: bool, k: int, order: np.ndarray, kind) -> Iterator[DataFrame]:
    """Results of ``search`` with thresholds lowered until every window is full or read to its end; slots are those of all anchors.

    ``guess``: scores of the sample's rows that may be in a window of each anchor, -inf for the others.
    """
    windows, left = asked.low.shape[1], np.flatnonzero((asked.low <= asked.high).any(axis=1))
    end = np.where(asked.low <= asked.high, asked.low, np.inf).min(axis=1)
    by_rank = -np.sort(-guess, axis=1)
    rank = 1
    while len(left):
        part = asked.part(left)
        last = rank > k or by_rank.shape[1] < rank
        at = end[left] if last else np.maximum(end[left], by_rank[left, rank - 1])
        at = np.where(by_rank[left, min(rank, by_rank.shape[1]) - 1] == NONE, end[left], at) if by_rank.shape[1] else end[left]
        found = materialize(search(rows, part, at.astype(np.float64), same, k, order, kind), "windows")
        counts = np.zeros(part.low.size, dtype=np.int64)
        got = found.groupBy("slot").count().toArrow()  # a row per window of the block at most
        counts[np.asarray(got["slot"])] = np.asarray(got["count"])
        done = ((counts.reshape(part.low.shape) >= k) | (part.low > part.high)).all(axis=1) | (at <= end[left])
        places = pa.table({"own": np.flatnonzero(done), "place": left[done]})
        finished = F.broadcast(rows.sparkSession.createDataFrame(places))
        out = found.withColumn("own", F.expr(f"slot div {windows}")).join(finished, "own")
        yield out.select((F.col("place") * windows + F.pmod("slot", F.lit(windows))).alias("slot"), "vec_id", "score", "rank")
        left, rank = left[~done], rank + k - 1


def energy(rows: DataFrame) -> tuple[int, np.ndarray, float]:
    """(rows, energy of each dimension, largest squared norm) over all rows; a row per task and dimension is summed."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, most, n = np.zeros(0), 0.0, 0
        for batch in batches:
            n += batch.num_rows
            dim = max([0, *np.diff(np.asarray(batch.column(0).offsets))])
            x = np.square(matrix(batch.column(0), dim))
            total = np.pad(total, (0, max(0, dim - len(total))))
            total[:dim] += x.sum(axis=0)
            most = max(most, x.sum(axis=1).max(initial=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total)), pa.int64()), pa.array(np.concatenate([[most], total])), pa.array([n, *[0] * len(total)], pa.int64())], names=["d", "e", "n"])

    found = rows.select("v").mapInArrow(sums, "d bigint, e double, n bigint").groupBy("d").agg(F.max("e").alias("most"), F.sum("e").alias("total"), F.sum("n").alias("n")).toArrow().to_pydict()
    at = dict(zip(found["d"], zip(found["most"], found["total"], found["n"], strict=True), strict=True))
    dims = max(at, default=-1) + 1
    most, _, n = at.get(-1, (0.0, 0.0, 0))
    return n, np.array([at[d][1] for d in range(dims)]), most


def hard_negatives(embeddings: DataFrame, anchor: Column, low: tuple[int, int] = (4, 5), positives: int = 5, negatives: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``embeddings``: vec_id, label, v (whole numbers); ``anchor``: which rows are anchors. A window is the scores from
    low[0]/low[1] of the positive's to the positive's.
    """
    spark = embeddings.sparkSession
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())
    rows = materialize(embeddings.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<bigint>").alias("v"), anchor.alias("is_anchor")), "vectors")
    n, by_dimension, most = energy(rows)
    if most >= 2**62:
        raise ValueError("scores of these vectors do not fit 64 bits")
    order, dim = np.argsort(-by_dimension, kind="stable"), max(1, len(by_dimension))
    order = order if len(order) else np.zeros(1, dtype=int)
    kind = np.float64 if most < 2**52 else np.int64  # sums of products are exact in either
    asked = rows.where("is_anchor").select("vec_id", "label", "v")
    rows = rows.select("vec_id", "label", "v")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label").limit(SAMPLE_ROWS).toArrow().combine_chunks()
    seen, seen_labels = matrix(sample["v"].combine_chunks(), dim, order, kind) if sample.num_rows else np.zeros((0, dim), dtype=kind), np.asarray(sample["label"])
    blocks = max(1, -(-asked.count() * 8 * (dim + 4 * positives * negatives) // block_bytes))
    folder, paths = shared_dir(spark, "negatives"), []
    for block in range(blocks):
        own = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)).toArrow().combine_chunks()
        if not own.num_rows:
            continue
        names, labels = np.asarray(own["vec_id"]), np.asarray(own["label"])
        vectors = matrix(own["v"].combine_chunks(), dim, order, kind)
        scores = (vectors @ seen.T).astype(np.float64)
        whole = np.full((len(names), 1), np.inf)
        same = labels[:, None] == seen_labels
        likely = np.where(same & (names[:, None] != np.asarray(sample["vec_id"])), scores, NONE)
        best = np.full((len(names), positives, 2), -1, dtype=np.int64)
        for found in fill(rows, Anchors(names, labels, vectors, -whole, whole), likely, True, positives, order, kind):
            got = found.toArrow()  # the positives of this block
            best[np.asarray(got["slot"]), np.asarray(got["rank"]) - 1] = np.stack([np.asarray(got["vec_id"]), np.asarray(got["score"])], axis=1)
        high = best[:, :, 1].astype(kind)  # -1 where there is no positive
        upper = np.where(high < 0, -1.0, high)
        lower = np.where(high < 0, 0.0, -(-high * low[0] // low[1]))
        least = np.where(high >= 0, high, np.inf).min(axis=1, keepdims=True)
        likely = np.where(~same & (scores <= least), scores, NONE)
        i, w = np.nonzero(high >= 0)
        windows = pa.table({"slot": i * positives + w, "anchor_id": names[i], "positive_id": best[i, w, 0], "positive_score": best[i, w, 1]})
        if not len(i):
            continue
        windows = F.broadcast(spark.createDataFrame(windows))
        for k, found in enumerate(fill(rows, Anchors(names, labels, vectors, lower, upper), likely, False, negatives, order, kind)):
            paths.append(f"{folder}/{block}-{k}")
            named = found.join(windows, "slot")
            named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(paths[-1])
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


#: Every anchor against all rows in SQL, with whole components of 64.
ORACLE = """
WITH rows AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.rid, a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
    FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS place FROM scored WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.rid, p.place ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.rid = p.rid AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score QUALIFY rank <= 5
"""
