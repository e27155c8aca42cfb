"""Row validation and search filters as columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.schemas import NUTRIENTS

#: Diet labels a search may ask for.
DIET_LABELS = [
    "amish", "dairy_free", "diabetic", "egg_free", "gluten_free", "halal", "kosher", "low_calorie", "low_carb",
    "low_cholesterol", "low_fat", "low_protein", "low_saturated_fat", "low_sodium", "no_shell_fish", "non_alcoholic", "nut_free",
    "vegan", "vegetarian",
]
OPERATORS = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__, "=": Column.__eq__}
#: Days of a named time range.
RANGES = {"7d": 7, "30d": 30, "90d": 90, "all": None}


@dataclass(frozen=True)
class NumericFilter:
    name: str
    operator: str
    value: float


@dataclass(frozen=True)
class SearchFilters:
    numeric_filters: Sequence[NumericFilter] = ()
    dietary_filters: Sequence[str] = ()
    include_ingredients: Sequence[str] = ()
    exclude_ingredients: Sequence[str] = ()
    any_ingredients: Sequence[str] = ()
    numeric_columns: Sequence[str] = field(default=("minutes", "n_steps", "n_ingredients", "servings", "score_sante", *(f"{n}_100g" for n in NUTRIENTS)))


def has_ingredient(word: str, col: str = "ingredients") -> Column:
    """Whether any element holds the word as a substring, case folded; null for a null array."""
    return F.exists(F.col(col), lambda x: F.contains(F.lower(x), F.lit(word.lower())))


def build_filter(filters: SearchFilters, ingredients: str = "ingredients", labels: str = "filters") -> Column | None:
    """All conditions joined by AND; None if there are none. Unknown columns, operators and labels raise."""
    out: list[Column] = []
    for f in filters.numeric_filters:
        if f.operator not in OPERATORS:
            raise ValueError(f"unknown operator {f.operator!r}")
        if f.name not in filters.numeric_columns:
            raise ValueError(f"unknown column {f.name!r}")
        out.append(OPERATORS[f.operator](F.col(f.name), F.lit(f.value)))
    for label in filters.dietary_filters:
        if label not in DIET_LABELS:
            raise ValueError(f"unknown diet label {label!r}")
        out.append(F.array_contains(labels, label))
    out += [has_ingredient(w, ingredients) for w in filters.include_ingredients]
    out += [~has_ingredient(w, ingredients) for w in filters.exclude_ingredients]
    if filters.any_ingredients:
        out.append(reduce(lambda a, b: a | b, (has_ingredient(w, ingredients) for w in filters.any_ingredients)))
    return reduce(lambda a, b: a & b, out) if out else None


def apply_filters(df: DataFrame, filters: SearchFilters | None, **cols: str) -> DataFrame:
    condition = build_filter(filters, **cols) if filters else None
    return df if condition is None else df.where(condition)


def time_range(ts: Column, name: str, as_of: Column) -> Column:
    """ts within the named range before ``as_of``; "all" has no limit; unknown names raise."""
    if name not in RANGES:
        raise ValueError(f"unknown time range {name!r}")
    days = RANGES[name]
    return F.lit(True) if days is None else ts >= as_of - F.expr(f"INTERVAL {days} DAYS")


def clean_recipes_filter() -> Column:
    """The rows that cleaning keeps."""
    full = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return (
        F.col("id").isNotNull() & F.col("submitted").isNotNull() & F.col("description").isNotNull() & (F.length("name") > 0)
        & (F.col("minutes") > 5) & full("tags") & full("filters") & full("steps") & full("ingredients") & F.coalesce(F.size("nutrition") == 7, F.lit(False))
    )


def validate_recipes(df: DataFrame) -> DataFrame:
    """Adds validation_errors, an array of texts, empty for a valid row."""
    blank = F.coalesce(F.trim("name"), F.lit("")) == ""
    rules = [
        (F.col("n_steps") != F.size("steps"), "n_steps differs from the number of steps"),
        (F.col("n_ingredients") != F.size("ingredients"), "n_ingredients differs from the number of ingredients"),
        (F.col("minutes") < 0, "minutes is negative"),
        (blank, "name is blank"),
    ]
    return df.withColumn("validation_errors", F.filter(F.array(*(F.when(c, F.lit(t)) for c, t in rules)), lambda x: x.isNotNull()))


def invalid_rows(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("validation_errors") > 0)


def error_counts(validated: DataFrame) -> DataFrame:
    return validated.select(F.explode("validation_errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n_rows"))


def lookup_by_id(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Status (success or not_found) and row of every wanted id."""
    wanted, found = ids.select(F.col(key).alias("_id")), df.select(F.col(key).alias("_key"), F.struct("*").alias("recipe"))
    status = F.when(F.col("_key").isNotNull(), "success").otherwise("not_found")
    return wanted.join(found, F.col("_id") == F.col("_key"), "left").select(F.col("_id").alias(key), status.alias("status"), "recipe")


def nutrition_view(df: DataFrame) -> DataFrame:
    """Adds nutrition_detailed, a struct of the per-100 g columns (carb_g_100g as carbs_g_100g)."""
    return df.withColumn("nutrition_detailed", F.struct(*(F.col(f"{n}_100g").alias("carbs_g_100g" if n == "carb_g" else f"{n}_100g") for n in NUTRIENTS)))


def to_recipe(df: DataFrame) -> DataFrame:
    """The outward form of a recipe: quantities renamed, nutrition nested, score columns dropped, safe defaults."""
    out = nutrition_view(df).withColumnRenamed("ingredients_raw_str", "ingredients_with_quantities")
    out = out.withColumns({"id": F.coalesce(F.col("id").try_cast("bigint"), F.lit(-1)), "name": F.coalesce("name", F.lit("Unknown Recipe"))})
    return out.drop("similarity_score", "bm25_score", "rrf_score", *(f"{n}_100g" for n in NUTRIENTS))


def keyword_search(df: DataFrame, needle: str, *cols: str) -> DataFrame:
    """Rows that hold the text in any of the columns, literally, case folded."""
    return df.where(reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(needle.lower())) for c in cols)))


def keep_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a table of keys."""
    return df.join(keys.select(key).distinct(), key, "left_semi")
