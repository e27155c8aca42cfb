"""Scalar helpers: null-strict extrema, safe casts, numbers and JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _strict(pick, *cols: Column) -> Column:
    missing = reduce(lambda a, b: a | b, (c.isNull() for c in cols))
    return F.when(~missing, pick(*cols))


def null_least(*cols: Column) -> Column:
    """The least argument, null if any is null (Spark's own ``least`` skips nulls)."""
    return _strict(F.least, *cols)


def null_greatest(*cols: Column) -> Column:
    return _strict(F.greatest, *cols)


def clamp(col: Column, low: float, high: float) -> Column:
    """col within [low, high]; null stays null."""
    return null_least(null_greatest(col, F.lit(float(low))), F.lit(float(high)))


def try_number(col: Column) -> Column:
    """A double, null where the text is none; a decimal comma counts as a point, only the first token is read."""
    first = F.regexp_extract(F.trim(col.cast("string")), r"^\S+", 0)
    return F.translate(first, ",", ".").try_cast("double")


def clean_name(col: Column) -> Column:
    """The key form of an ingredient's name."""
    return F.lower(F.trim(col))


def slice_text(col: Column, start: int, end: int) -> Column:
    """Text without ``start`` characters in front and ``-end`` at its end; shorter text becomes empty."""
    return F.when(col.isNotNull(), F.substring(col, F.lit(start + 1), F.greatest(F.length(col) - start + end, F.lit(0))))


def json_number(col: Column, path: str) -> Column:
    """A number at a JSON path of a text column; null where the text, the path or the number is none."""
    return F.get_json_object(col, path).try_cast("double")


def json_text(col: Column) -> Column:
    """Model output to JSON: code fences, line breaks and outer quotes dropped, then the first object found."""
    bare = F.regexp_replace(F.regexp_replace(col, r"```(?:json)?", ""), r"[\r\n]+", " ")
    bare = F.regexp_replace(F.trim(bare), r"^[\"']+(?=\{)|(?<=\})[\"']+$", "")
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def array_mean(col: Column) -> Column:
    """Mean of an array of numbers; null if it is null or empty."""
    return F.when(F.size(col) > 0, F.aggregate(col, F.lit(0.0), lambda a, x: a + x) / F.size(col))


def array_std(col: Column) -> Column:
    """Population standard deviation of an array of numbers."""
    mean = array_mean(col)
    square = F.aggregate(F.transform(col, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(col) > 0, F.sqrt(square / F.size(col)))


def square(a: Column) -> Column:
    return a * a


def total(*cols: Column) -> Column:
    """Sum of the arguments, null if any is null."""
    return reduce(lambda a, b: a + b, cols)


def power(a: Column, b: Column) -> Column:
    """a to the power of b in double precision; null for null, and where no number comes of it."""
    p = F.pow(a.cast("double"), b.cast("double"))
    return F.when(~F.isnan(p), p)


def safe_quotient(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def safe_sqrt(a: Column) -> Column:
    return F.when(a >= 0, F.sqrt(a))


#: Order of size by nutrient at which a value is green, then orange; +1 where more is better.
HEALTH_LEVELS = {"protein": (1, 30, 15), "fiber": (1, 10, 5), "calories": (-1, 400, 600), "carbs": (-1, 50, 100), "fat": (-1, 20, 40), "sodium": (-1, 500, 1000)}


def health_level(value: Column, nutrient: Column) -> Column:
    """green, orange or red by nutrient; orange for others; null value is null."""
    out = F.lit("orange")
    for name, (sign, green, orange) in HEALTH_LEVELS.items():
        level = F.when(value * sign >= green * sign, "green").when(value * sign >= orange * sign, "orange").otherwise("red")
        out = F.when(nutrient == name, level).otherwise(out)
    return F.when(value.isNotNull(), out)
