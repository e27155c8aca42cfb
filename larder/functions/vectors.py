"""Vector arithmetic on array columns, inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a null or zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def l2_normalize(a: Column) -> Column:
    """Unit length in float; a zero vector stays as it is."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")).cast("float"))


def parse_vector(col: Column) -> Column:
    """``[0.1 0.2 ...]`` text, parts apart by spaces or commas, to an array of float."""
    bare = F.trim(F.regexp_replace(F.translate(col, "[],", "   "), r"\s+", " "))
    return F.when(bare != "", F.transform(F.split(bare, " "), lambda x: x.try_cast("float")))
