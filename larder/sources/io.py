"""Readers, writers and table maintenance as functions of DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.exprs import try_number


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",", nrows: int | None = None, drop: Sequence[str] = (), line_breaks: bool = False) -> DataFrame:
    """CSV with a header; without a schema every column is text. ``drop`` names index columns.

    ``line_breaks``: fields may hold quoted line breaks; each file is then one task, where otherwise it is split.
    """
    reader = spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"').option("sep", sep)
    df = (reader.schema(schema) if schema else reader).csv(path).drop(*drop)
    return df.limit(nrows) if nrows is not None else df


def write_csv_table(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').option("sep", sep).csv(path)


def coerce_numeric(df: DataFrame, exclude: Sequence[str]) -> DataFrame:
    """Every column but those excluded as double; text that is no number becomes null."""
    keep = {c.lower() for c in exclude}
    return df.select(*(F.col(c) if c.lower() in keep else F.col(c).cast("string").try_cast("double").alias(c) for c in df.columns))


def fix_set_literals(col: Column) -> Column:
    return F.translate(col, "{}", "[]")


def uppercase_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.upper() for c in df.columns))


def parse_list(col: Column) -> Column:
    """Text of a list to array<string>: JSON, else comma parts of the bracketed text, else one element; '' and null to null."""
    bare = F.trim(col)
    strip = lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", "")
    parts = F.filter(F.transform(F.split(F.regexp_replace(bare, r"^\[|\]$", ""), ","), strip), lambda x: x != "")
    return F.when(bare.isNull() | (bare == ""), None).when(bare.rlike(r"(?s)^\[.*\]$"), F.coalesce(F.from_json(bare, "array<string>"), parts)).otherwise(F.array(bare))


def parse_number_list(col: Column) -> Column:
    """As parse_list, as numbers, exponents included; other elements become null."""
    return F.transform(parse_list(col), lambda x: x.try_cast("double"))


def array_to_text(df: DataFrame, cols: Sequence[str], sep: str = " | ") -> DataFrame:
    return df.withColumns({c: F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), sep) for c in cols})


def text_to_array(df: DataFrame, cols: Sequence[str], sep: str = " | ") -> DataFrame:
    """Inverse of array_to_text; '' is the empty array."""
    literal = "".join(f"\\{c}" if c in "|.*+?()[]{}^$\\" else c for c in sep)
    return df.withColumns({c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, literal)) for c in cols})


def split_nutrition(df: DataFrame, names: Sequence[str], col: str = "nutrition") -> DataFrame:
    """The parts of an array as named doubles; a short array gives nulls."""
    return df.withColumns({n: F.get(F.col(col), F.lit(i)).cast("double") for i, n in enumerate(names)})


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """``{query: {doc_id: grade}}`` as rows query, doc_id, relevance."""
    return judgments_of(spark.read.text(path, wholetext=True).select(F.col("value").alias("json")))


def judgments_of(df: DataFrame, col: str = "json") -> DataFrame:
    graded = df.select(F.explode(F.from_json(col, "map<string,map<string,double>>")).alias("query", "docs"))
    return graded.select("query", F.explode("docs").alias("doc_id", "relevance")).select("query", F.col("doc_id").try_cast("bigint").alias("doc_id"), "relevance")


def read_query_list(spark: SparkSession, path: str) -> DataFrame:
    """``[query, ...]`` as rows query_id (place from 0), query."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("query_id", "query"))


def write_json_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_table(df: DataFrame, name: str, mode: str = "append", catalog: bool = True) -> None:
    """To the catalog or, with catalog=False, a Parquet folder; creates it if absent. mode "ignore" is IF NOT EXISTS."""
    if catalog:
        df.write.mode(mode).saveAsTable(name)
    else:
        df.write.mode(mode).parquet(name)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def ensure_columns(df: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Absent columns added as null of the given type."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c.lower() not in have})


def verify_embeddings(df: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    """One row of checks: rows, nulls, wrong_dim, ok."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(col).isNull()).alias("nulls"),
        F.count_if(F.size(col) != dim).alias("wrong_dim"),
    ).select("*", ((F.col("rows") > 0) & (F.col("nulls") == 0) & (F.col("wrong_dim") == 0)).alias("ok"))


def update_where(df: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """UPDATE ... SET ... WHERE; a null condition changes nothing."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def merge_update(target: DataFrame, source: DataFrame, key: str, cols: Sequence[str], unique: bool = False) -> DataFrame:
    """MERGE ... WHEN MATCHED THEN UPDATE: no row is added or removed, and a matched null overwrites.

    Repeated keys of ``source`` raise, as they would multiply rows; null keys match nothing. ``unique`` says that the source is
    grouped by its key, so that nothing need be checked.
    """
    source = source.where(F.col(key).isNotNull())
    repeated = [] if unique else source.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"the source of a merge has {key} {repeated[0][0]!r} more than once")
    new = source.select(F.col(key).alias("_key"), F.struct(*cols).alias("_new"))
    joined = target.join(new, target[key] == F.col("_key"), "left")
    change = {c: F.when(F.col("_key").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in cols}
    return joined.withColumns(change).drop("_key", "_new")


def delete_cascade(parents: DataFrame, children: DataFrame, ids: DataFrame, key: str = "conversation_id") -> tuple[DataFrame, DataFrame]:
    """Both tables without the rows of the given keys."""
    gone = ids.select(key).distinct()
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def replace_values(df: DataFrame, col: str, values: Mapping[str, str]) -> DataFrame:
    """Dirty number text patched by a table, then read as a number."""
    return df.replace(dict(values), subset=[col]).withColumn(col, try_number(F.col(col)))
