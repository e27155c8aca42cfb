"""Operator 7: token counts through a digest cache.

A row of the cache is (content digest, tokenizer digest, count). The documents' distinct digests,
without texts, are joined to it; only contents that it lacks are encoded, each once, and appended. With few
misses (counted; ``FEW`` at most) no text is shuffled but theirs, so a warm cache saves moving the corpus
as well as encoding it. The tokenizer's digest is that of its vocabulary file, so another version never
meets the old counts.

Content is normalised only as far as no count can change by it: null becomes empty, nothing else.
Only rows of the cache that hold this tokenizer's digest are read; a digest appended twice by
concurrent runs counts once.

Defined results: null text counts as empty, zero tokens; repeated texts are encoded once;
repeated rows each get their own result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import materialize, pieces

LIMIT = 512
#: Digests (32 bytes each) that are broadcast at most to find the texts that are missing.
FEW = 200_000
CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Texts -> token counts by the library that belongs to the file's ending."""
    if path.endswith(".json"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(e) for e in p.encode(texts, num_threads=1)]
    raise ValueError(f"no tokenizer library for {path}")


def read_cache(spark: SparkSession, cache_path: str, digest: str) -> DataFrame:
    """Digest and count of every cached content of this tokenizer; the folder is made if it isn't there."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer_digest").parquet(cache_path)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == digest)
    return cache.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def missing_texts(docs: DataFrame, misses: DataFrame, few: bool) -> DataFrame:
    """content_digest, text of each digest in ``misses``, once. ``docs``: content_digest, text.

    Few misses are broadcast, so that only their own texts are shuffled. Otherwise copies combine in each task
    before the shuffle, so that a text which a third of all rows repeat travels once per task.
    """
    if few:
        docs = docs.join(F.broadcast(misses), "content_digest", "left_semi")
    distinct = docs.groupBy("content_digest").agg(F.first("text").alias("text"))
    return distinct if few else distinct.join(misses, "content_digest", "left_semi").select("content_digest", "text")


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, few: int = FEW) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit. Appends what was missing to the cache first."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    content_digest = F.unhex(F.sha2(text, 256)).alias("content_digest")
    keyed = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), content_digest, F.octet_length(text).cast("long").alias("n_bytes")), "digests")
    looked = materialize(keyed.select("content_digest").distinct().join(read_cache(spark, cache_path, version), "content_digest", "left"), "looked")
    misses = looked.where("n_tokens is null").select("content_digest")
    schema = pa.schema([("content_digest", pa.binary()), ("n_tokens", pa.int64())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for piece in pieces(batches, limit=1_000_000, rows=256):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(count(piece.column(1).to_pylist()), pa.int64())], schema=schema)

    counts = looked.where("n_tokens is not null")
    n = misses.count()
    if n:
        texts = missing_texts(docs.select(content_digest, text.alias("text")), misses, n <= few)
        fresh = materialize(texts.mapInArrow(encode, "content_digest binary, n_tokens bigint"), "fresh")
        fresh.withColumn("tokenizer_digest", F.lit(version)).write.mode("append").partitionBy("tokenizer_digest").parquet(cache_path)
        counts = counts.unionByName(fresh)
    return keyed.join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
