"""The queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import bpe, decontam, html, langid, negatives, packing, pii, quality, secrets, simhash, substring, tokens, trie
from larder.llm.common import shared_dir, table

#: The vocabulary files of the token queries, as the installed package of public tokenizers names them, and the id behind each packed document.
VOCABULARY, PACKED_VOCABULARY, END_ID = "byte_bpe_50k.json", "word_bpe_49k.json", 1

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts and digest, and all spans with those the skip-chain CRF adds."""
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in pii.KINDS), F.sha2("base_text", 256).alias("base_sha256"), F.col("spans_text").alias("spans"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document, by Wu-Manber search."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics and the robust outlier verdict of every document."""
    found = quality.quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document; each call starts with a cache of its own, so every distinct text is encoded."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary_path(), shared_dir(spark, "token-cache"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by prefix dynamic programming, and those ids decoded."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of every document with the forest's verdict."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat an earlier window of 20 words, removed."""
    found = substring.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document's tokens in sequences of 2048."""
    found = packing.pack(table(spark, sf_dir, "documents"), vocabulary_path(PACKED_VOCABULARY), END_ID)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives close under each positive of every anchor; vectors as whole 256ths, the labels of some rows moved on by one."""
    rows = table(spark, sf_dir, "embeddings")
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    return negatives.hard_negatives(rows.where(finite).select("vec_id", label.alias("label"), whole.alias("v")), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Query]:
    found = [op1_pii, op2_decontamination, op3_quality, op4_html, op5_langid, op6_simhash, op7_token_counts, op8_bpe, op9_secrets, op10_substring_dedup, op11_prefix_trie, op12_packing, op13_hard_negatives]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontam.ORACLE, "op10_substring_dedup": substring.ORACLE, "op11_prefix_trie": trie.ORACLE, "op13_hard_negatives": negatives.ORACLE}
