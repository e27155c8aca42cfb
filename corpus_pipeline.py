"""A corpus for training, stage by stage; counted as part of the subpackage larder.llm.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written as
Parquet before the next reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import bpe, decontam, langid, pii, simhash
from larder.llm.common import materialize, table
from larder.llm.queries import vocabulary_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a score of at least a half; those without letters or with no clear language go.

    Null and empty texts have no letter and go. Repeated rows each stay or go alike. Where nothing can be learned (an empty
    table, no labels) no language is known and no row stays.
    """
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one of the least id, then of the least digest of its text.

    Null and empty texts share the fingerprint zero and are linked like any others. A null id comes after every other.
    Of rows that repeat id and text the one of the least hash over all columns stays. An empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window.

    Null and empty texts have none and stay. Repeated rows each stay or go alike. With an empty benchmark all rows stay.
    """
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text.

    Null texts stay null (n_chars null), empty ones empty. Spans that overlap merge under the kind of the first, ties by its
    end, then by kind. Repeated rows each get the same text. An empty table stays empty.
    """
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text.

    Null counts as empty, with no ids. Repeated rows each get their own result. An empty table stays empty.
    """
    return bpe.encode_column(docs, vocabulary_path())


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: SQL can express neither the classifier nor the fingerprints; a brute-force version stands in tests/llm.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
