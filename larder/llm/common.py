"""Small helpers that every training-data operator shares."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.sources.workdir import materialize, shared_dir

__all__ = ["SPACES", "ascii_lower", "id_and_text", "materialize", "pieces", "shared_dir", "table", "words_of"]

#: The whitespace that separates words: space, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"


def ascii_lower(text: str) -> str:
    """A-Z folded, every other letter as it is (bytes.lower knows ASCII only)."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none. str.split() would also split at Unicode white space."""
    if not text:
        return []
    for c in SPACES[1:]:
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under names no other column can clash with."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def pieces(batches: Iterator[pa.RecordBatch], limit: int = 4_000_000, rows: int = 2_000, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        start, size = 0, 0
        for i, n in enumerate(pa.compute.binary_length(col).to_pylist()):
            size += n or 0
            if size >= limit or i + 1 - start >= rows:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
