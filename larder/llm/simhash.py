"""Operator 6: SimHash near-duplicates by deletion-variant signatures.

Every distinct 64-bit fingerprint is cut into two segments. If two fingerprints differ in at most
two bits, one of the segments differs in at most one, so the two share a variant of that segment
in which one bit is a wildcard. Variants are joined by equality (sorted by variant, equal ones stand
together) and pairs verified.

Only small buckets give pairs. Fingerprints in larger buckets (families of near copies) take another,
exact way with no pairs: each is listed under itself and its 64 one-bit neighbours; such a list
has 65 members at most, all within two bits of each other, so linking each member to the least
one loses no link. Components come from alternating large and small star steps, each written
to the shared folder.

Defined results: null or empty text has fingerprint zero and is linked like any other;
component_id is the least doc_id of the component (null only if all its ids are null); rows that
repeat a doc_id each get their own result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import ascii_lower, materialize, pieces, words_of

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Members up to which a bucket's pairs are joined and verified; larger ones take the exact way without pairs.
MAX_BUCKET = 8
#: (doc_id, digest) pairs that are broadcast at most.
FEW = 300_000


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    words = words_of(ascii_lower(text)) if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([digest(" ".join(words).encode(), seed)], dtype=np.uint64)
    parts = (words[i:] for i in range(size))
    return np.array([digest(s.encode(), seed) for s in map(" ".join, zip(*parts, strict=False))], dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes; no words: zero."""
    h = shingle_hashes(text)
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65_536):
        part = h[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (of the text, tells rows with one id apart), fp (signed 64 bits)."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("fp", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            fp = np.array([fingerprint(t) for t in piece.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(fp)], schema=schema)

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text")).mapInArrow(scan, "doc_id bigint, digest bigint, fp bigint")


def variants(fps: DataFrame) -> DataFrame:
    """fp under 64 keys: segment number and wildcard place above, the segment without that bit below."""
    spread = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    segment = F.expr("CASE WHEN i < 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END")
    return spread.select("fp", segment.bitwiseAND(F.expr("~shiftleft(1L, i % 32)")).bitwiseOR(F.expr("shiftleft(cast(i as bigint), 32)")).alias("key"))


def neighbours(fps: DataFrame) -> DataFrame:
    """fp under itself and each fingerprint one bit away."""
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i")).select("fp", F.expr("CASE WHEN i = 64 THEN fp ELSE fp ^ shiftleft(1L, i) END").alias("near"))


def _joined(keyed: DataFrame, max_bucket: int) -> DataFrame:
    """u, v: verified pairs (u > v) of buckets of up to ``max_bucket``; each member of a larger bucket as u = v.

    Rows come sorted by key; a bucket that goes on in the next batch waits for it, up to max_bucket rows.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def out(u: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch:
        empty = np.zeros(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *u])), pa.array(np.concatenate([empty, *v]))], schema=schema)

    def complete(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        """Pairs and large members of buckets that are all there."""
        if not len(key):
            return out([], [])
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        size = np.repeat(np.diff(starts), np.diff(starts))
        large = fp[size > max_bucket]
        u, v = [large], [large]
        for d in range(1, max_bucket):
            at = np.flatnonzero((key[d:] == key[:-d]) & (size[d:] <= max_bucket))
            if not len(at):
                break
            a, b = fp[at], fp[at + d]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE
            u.append(np.maximum(a, b)[near])
            v.append(np.minimum(a, b)[near])
        return out(u, v)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = np.zeros(0, dtype=np.int64)
        over: int | None = None  # the key of a large bucket whose members go out as they come
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            if over is not None:
                n = int(np.searchsorted(key != over, True)) if (key != over).any() else len(key)
                yield out([fp[:n]], [fp[:n]])
                key, fp = key[n:], fp[n:]
            if not len(key):
                continue
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            yield complete(key[:cut], fp[:cut])
            key, fp, over = key[cut:], fp[cut:], None
            if len(key) > max_bucket:
                over = int(key[-1])
                yield out([fp], [fp])
                key, fp = key[:0], fp[:0]
        yield complete(key, fp)

    return keyed.repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(scan, "u bigint, v bigint")


def links(fps: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges u > v between distinct fingerprints at DISTANCE or less, enough to connect all that are linked."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(_joined(variants(fps.repartition(n)), max_bucket).distinct(), "pairs")
    large = found.where("u = v").select(F.col("u").alias("fp"))
    lists = neighbours(large).groupBy("near").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = lists.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u > v")
    return found.where("u > v").unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, v: each node that is not the least of its component, with the least. Alternating star steps."""
    edges = materialize(edges, "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges
        before = now


def classes(fps: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """fp, component_id for each distinct fingerprint of a table of doc_id and fp."""
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    tied = components(links(distinct.select("fp"), max_bucket)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = distinct.join(tied, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row per input row: doc_id, fingerprint (hex), component_id."""
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    return fps.join(classes(fps, max_bucket), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bucket: int = MAX_BUCKET, few: int = FEW) -> DataFrame:
    """The rows, all columns unchanged, of one document of each component: the one of the least (doc_id, digest of the text).

    Ids and digests alone are shuffled to choose; the pairs that go, counted, are broadcast up to ``few`` and else joined.
    Rows that repeat both id and text are one document: the one of the least hash over all columns stays (rows equal in
    every column: any).
    """
    pair = ["none", "row_id", "row_digest"]
    key = lambda i, d: [i.isNull().alias("none"), F.coalesce(i, F.lit(0).cast("long")).alias("row_id"), d.alias("row_digest")]
    fps = materialize(fingerprints(docs, id_col, text_col).select("doc_id", "fp", *key(F.col("doc_id"), F.col("digest"))), "fingerprints")
    by_fp = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct(*pair)).alias("first")), "distinct")
    tied = components(links(by_fp.select("fp"), max_bucket)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    firsts = by_fp.join(tied, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")).select("first.*")
    counted = fps.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"))
    marked = materialize(counted.join(firsts.withColumn("first", F.lit(True)), pair, "left"), "marked")

    def bounded(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.limit(few + 1).count() <= few else df

    inner = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *key(docs[id_col].cast("long"), F.xxhash64(docs[text_col].cast("string"))))
    kept = inner.join(bounded(marked.where("first is null").select(*pair)), pair, "left_anti")
    repeated = marked.where("first and n > 1").select(*pair)
    if repeated.isEmpty():
        return kept.select("row.*")
    repeated = bounded(repeated)
    one = kept.join(repeated, pair, "left_semi").groupBy(*pair).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return kept.join(repeated, pair, "left_anti").select("row.*").unionByName(one.select("row.*"))
