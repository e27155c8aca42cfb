"""Ingredient substitution as joins and windows over many recipes at once.

Names meet descriptions in one pass of an automaton (``larder.operators.matching``), never each with each; the nearest rows of a
target come from one pass over the catalogue (``larder.operators.nearest``), which stays where it is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import description_flags
from larder.operators.matching import least_holding
from larder.operators.nearest import nearest
from larder.operators.sketches import quantiles
from larder.schemas import NUTRIENTS

#: Nutrient and order of preference of each goal of an addition.
ADD_GOALS = {"increase_protein": "protein_g", "decrease_protein": "protein_g", "increase_fiber": "fiber_g", "decrease_sugar": "sugar_g", "decrease_carbs": "carb_g", "decrease_calories": "energy_kcal", "decrease_sodium": "sodium_mg", "decrease_satfat": "saturated_fats_g"}
#: Nutrient and sign of each goal of a removal.
REMOVE_GOALS = {"decrease_sugar": ("sugar_g", 1), "decrease_sodium": ("sodium_mg", 1), "decrease_calories": ("energy_kcal", 1), "decrease_carbs": ("carb_g", 1), "decrease_protein": ("protein_g", 1), "increase_protein": ("protein_g", -1)}
DIETS = ("no_lactose", "no_gluten", "no_nuts", "vegetarian", "vegan")
#: The flag a diet needs in the catalogue, and its value.
DIET_FLAGS = {"no_lactose": ("is_lactose", 0), "no_gluten": ("is_gluten", 0), "no_nuts": ("contains_nuts", 0), "vegetarian": ("is_vegetarian", 1), "vegan": ("is_vegetable", 1)}
#: The tag that breaks a diet, and the value that does; null breaks none.
DIET_BREAKERS = {"no_lactose": ("is_dairy", True), "no_gluten": ("is_gluten", True), "no_nuts": ("contains_nuts", True), "vegetarian": ("is_vegetarian", False), "vegan": ("is_vegetable", False)}
MOST_REMOVED, POOL, CANDIDATES = 3, 200, 5


@dataclass(frozen=True)
class Constraints:
    """Names of the active constraints."""

    active: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        unknown = self.active - {*DIETS, *ADD_GOALS, *REMOVE_GOALS}
        if unknown:
            raise ValueError(f"unknown constraints {sorted(unknown)}")

    @property
    def diets(self) -> list[str]:
        return [d for d in DIETS if d in self.active]


def ingredient_catalogue(clusters: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Clustered ingredients with 0/1 flags: from tags (missing ones false), or from words of the description."""
    if tags is None:
        return clusters.withColumns(description_flags(F.col("descrip")))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    known = tags.select("ndb_no", F.col("is_dairy").alias("is_lactose"), "is_gluten", "contains_nuts", "is_vegetarian", "is_vegetable")
    return clusters.join(known, "ndb_no", "left").withColumns({c: flag(c) for c in ("is_lactose", "is_gluten", "contains_nuts", "is_vegetarian", "is_vegetable")})


def breaks_diet(constraints: Constraints) -> Column:
    """Whether an ingredient's tags break an active diet; unknown tags break none."""
    out = F.lit(False)
    for d in constraints.diets:
        tag, value = DIET_BREAKERS[d]
        out = out | F.coalesce(F.col(tag) == value, F.lit(False))
    return out


def meets_diet(constraints: Constraints) -> Column:
    out = F.lit(True)
    for d in constraints.diets:
        flag, value = DIET_FLAGS[d]
        out = out & (F.col(flag) == value)
    return out


def infer_role() -> Column:
    """What an ingredient is in a dish, by the first of these tags that holds."""
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    return (
        F.when(true("is_seafood"), "animal_protein").when(~F.coalesce("is_vegetarian", F.lit(True)), "animal_protein").when(true("is_sweetener"), "sugar")
        .when(true("is_grain"), "carb").when(true("is_dairy"), "dairy_fat").when(true("is_vegetable"), "plant").when(true("contains_nuts"), "nuts").otherwise("other")
    )


def match_ingredients(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """name, ndb_no, descrip of the best candidate: the exact name, else one that holds the name or any word of it; ties by descrip.

    ``names``: name; ``candidates``: ndb_no, descrip. Names without a match keep nulls. A candidate that holds a word holds
    it inside one of its own words, so the least candidate of each word is found first and a name takes the least of its words'.
    """
    value = F.struct("descrip", "ndb_no")
    side = candidates.select(F.lower(F.trim("descrip")).alias("low"), value.alias("value"))
    keyed = names.select(F.lower(F.trim("name")).alias("key")).distinct()
    parts = keyed.select("key", F.explode(F.filter(F.split("key", r"\s+"), lambda x: x != "")).alias("needle"))
    words = side.select(F.explode(F.filter(F.split("low", r"\s+"), lambda x: x != "")).alias("low"), "value")
    partial = parts.join(least_holding(parts, words), "needle").groupBy("key").agg(F.min("best").alias("partial"))
    exact = side.groupBy("low").agg(F.min("value").alias("exact")).withColumnRenamed("low", "key")
    found = keyed.join(exact, "key", "left").join(partial, "key", "left").select("key", F.coalesce("exact", "partial").alias("best"))
    return names.withColumn("key", F.lower(F.trim("name"))).join(found, "key", "left").select(*names.columns, "best.ndb_no", "best.descrip")


def _weighted_distance(split: int, w_macro: float, w_micro: float):
    """Minus the weighted sum of the distances on the first ``split`` axes and on the others."""

    def score(asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
        def distance(cut: slice) -> np.ndarray:
            total = np.zeros((len(asked), len(rows)))
            for a, b in zip(asked[:, cut].T, rows[:, cut].T, strict=True):
                total += np.square(b[None, :] - a[:, None])
            return np.sqrt(total)

        return -(w_macro * distance(slice(0, split)) + w_micro * distance(slice(split, None)))

    return score


def substitutes(targets: DataFrame, catalogue: DataFrame, constraints: Constraints, k: int = 5, w_macro: float = 0.7, w_micro: float = 0.3) -> DataFrame:
    """target, ndb_no, descrip, distance, rank: the k nearest rows that meet the diets, without those that start as the target does.

    A target is the first catalogue row (by ndb_no) whose description holds its name. ``catalogue``: ndb_no,
    descrip, macro and micro (arrays of axes) and the diet flags. First k, then the first-word rule, so fewer than k may stay.
    """
    side = catalogue.select("ndb_no", "descrip", F.concat("macro", "micro").alias("v"), F.size("macro").alias("split"), meets_diet(constraints).alias("fits"))
    wanted = targets.select("target", F.lower(F.trim("target")).alias("needle")).where("needle <> ''").distinct()
    own = least_holding(wanted, side.select(F.lower("descrip").alias("low"), F.col("ndb_no").alias("value")))
    origin = wanted.join(own, "needle").join(side.select(F.col("ndb_no").alias("best"), "v"), "best").select(F.col("target").alias("query_id"), "v", F.col("best").alias("own"))
    split = side.agg(F.max("split")).first()[0] or 0
    near = nearest(side.where("fits").select(F.col("ndb_no").alias("doc_id"), "v"), origin, k, _weighted_distance(split, w_macro, w_micro))
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    named = best.select(F.col("query_id").alias("target"), F.col("doc_id").alias("ndb_no"), (-F.col("score")).alias("distance"), "rank").join(side.select("ndb_no", "descrip"), "ndb_no")
    word = lambda c: F.regexp_extract(F.lower(F.trim(c)), r"^\S+", 0)
    return named.where(~F.startswith(F.lower("descrip"), word("target"))).select("target", "ndb_no", "descrip", "distance", "rank")


def removal_score(constraints: Constraints) -> Column:
    """Grams times the wanted nutrients per 100 g; null where a quantity is unknown or not positive, or no goal is active."""
    goals = [(n, s) for g, (n, s) in REMOVE_GOALS.items() if g in constraints.active]
    if not goals:
        return F.lit(None).cast("double")
    total = F.lit(0.0)
    for nutrient, sign in goals:
        total = total + sign * F.col("qty_g") * F.coalesce(nutrient, F.lit(0.0)) / 100.0
    return F.when((F.col("qty_g") > 0) & F.col("has_nutrition"), total)


def ingredients_to_remove(lines: DataFrame, constraints: Constraints) -> DataFrame:
    """id, ingredient, place: ingredients that break a diet in list order, then those of the highest score; 3 at most, 1 without a diet.

    ``lines``: id, pos, ingredient, the tags, qty_g, nutrients, has_nutrition.
    """
    most = MOST_REMOVED if constraints.diets else 1 if any(g in constraints.active for g in REMOVE_GOALS) else 0
    scored = lines.select("id", "pos", "ingredient", breaks_diet(constraints).alias("breaks"), removal_score(constraints).alias("score")).where(F.col("breaks") | F.col("score").isNotNull())
    order = Window.partitionBy("id").orderBy(F.desc("breaks"), F.when(F.col("breaks"), F.col("pos")).asc_nulls_last(), F.desc("score"), "pos")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("id", "ingredient", "breaks", "place")


def judge_substitutes(scored: DataFrame) -> DataFrame:
    """Per (id, target) the candidate of the highest index; ties and missing scores by rank. ``scored``: id, target, candidate, rank, score_sante."""
    order = Window.partitionBy("id", "target").orderBy(F.desc_nulls_last("score_sante"), "rank")
    return scored.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def transform_substitute(recipes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Recipes with ingredients replaced: ``mapping``: id, old, new. Each line is judged on the original list, see README."""
    per = mapping.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_m"))
    out = recipes.join(per.hint("merge"), "id", "left")  # a row per recipe, however small it is written
    swap = F.transform("ingredients", lambda x: F.coalesce(F.try_element_at("_m", x), x))
    return out.withColumn("ingredients", F.when(F.col("_m").isNull(), F.col("ingredients")).otherwise(swap)).drop("_m")


def add_candidates(recipe_roles: DataFrame, catalogue: DataFrame, constraints: Constraints, exact: bool = True) -> DataFrame:
    """id, ndb_no, descrip, rank: up to five additions for the first active goal.

    From catalogue rows beyond the goal's median, the 200 furthest that break no diet and whose
    role the recipe doesn't have yet ("other" always may). ``recipe_roles``: id, roles (array). ``exact`` false: the median
    from a sketch (``larder.operators.sketches``), which never holds the distinct values of a large catalogue.
    """
    goal = next((g for g in ADD_GOALS if g in constraints.active), None)
    if goal is None:
        return recipe_roles.select("id", F.lit(None).cast("string").alias("ndb_no"), F.lit(None).cast("string").alias("descrip"), F.lit(None).cast("int").alias("rank")).where("false")
    nutrient, up = ADD_GOALS[goal], goal.startswith("increase")
    middle = quantiles(catalogue, nutrient, [0.5], exact).select(F.get("quantiles", F.lit(0)).alias("_median"))
    far = catalogue.crossJoin(F.broadcast(middle)).where(F.col(nutrient) > F.col("_median") if up else F.col(nutrient) < F.col("_median"))  # one row
    order = [F.desc(nutrient) if up else F.asc(nutrient), F.asc("ndb_no")]
    pool = far.where("descrip is not null and ndb_no is not null").orderBy(*order).limit(POOL)
    named = pool.withColumn("_key", F.lower(F.trim("descrip")))
    firsts = named.withColumn("_rn", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_rn = 1")
    fit = firsts.where(~breaks_diet(constraints)).select("ndb_no", "descrip", F.col(nutrient).alias("_n"), infer_role().alias("role"))
    # ranked once for each set of roles, of which there are few (a set of eight roles' names), then met by the recipes that have it
    keyed = recipe_roles.withColumn("_roles", F.array_sort(F.coalesce("roles", F.array().cast("array<string>"))))
    sets = keyed.select("_roles").distinct()
    pairs = sets.crossJoin(F.broadcast(fit)).where((F.col("role") == "other") | ~F.array_contains("_roles", F.col("role")))  # POOL rows at most
    by = Window.partitionBy("_roles").orderBy(F.desc("_n") if up else F.asc("_n"), "ndb_no")
    best = pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= CANDIDATES)
    return keyed.select("id", "_roles").join(best, "_roles").select("id", "ndb_no", "descrip", "rank")


def transform_add(recipes: DataFrame, added: DataFrame) -> DataFrame:
    """Recipes with additions appended, each once. ``added``: id, new (array)."""
    out = recipes.join(added.hint("merge"), "id", "left")
    return out.withColumn("ingredients", F.array_distinct(F.concat("ingredients", F.coalesce("new", F.array().cast("array<string>"))))).drop("new")


def transform_delete(recipes: DataFrame, removed: DataFrame) -> DataFrame:
    """Recipes without the given ingredients; repeated lines that stay keep repeating. ``removed``: id, gone (array)."""
    out = recipes.join(removed, "id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<string>")))
    return out.withColumn("ingredients", F.filter("ingredients", lambda x: ~F.array_contains("gone", x))).drop("gone")


def rewrite_steps(df: DataFrame, mapping: str = "mapping", steps: str = "steps", added: str | None = None) -> DataFrame:
    """Ingredient names replaced in every step by an array of (old, new), a null new deleting; ``added`` names give a step each."""
    one = lambda step: F.aggregate(F.col(mapping), step, lambda acc, m: F.replace(acc, m["old"], F.coalesce(m["new"], F.lit(""))), lambda s: F.trim(F.regexp_replace(s, " +", " ")))
    new = F.when(F.size(mapping) > 0, F.transform(steps, one)).otherwise(F.col(steps))
    if added:
        new = F.concat(new, F.transform(added, lambda x: F.concat(F.lit("Add "), x)))
    return df.withColumn(steps, new)


def transform_response(before: DataFrame, after: DataFrame, message: str = "") -> DataFrame:
    """id, original_name, transformed_name, success, message, nutrition_before and nutrition_after (structs), from rows with id, name and nutrients."""
    pack = lambda: F.struct(*NUTRIENTS, "score_sante")
    a = before.select("id", F.col("name").alias("original_name"), pack().alias("nutrition_before"))
    b = after.select("id", F.col("name").alias("transformed_name"), pack().alias("nutrition_after"))
    return a.join(b.hint("merge"), "id", "left").select("id", "original_name", "transformed_name", F.col("nutrition_after").isNotNull().alias("success"), F.lit(message).alias("message"), "nutrition_before", "nutrition_after")


def constraint_struct(flags: Mapping[str, bool] | Sequence[str]) -> Constraints:
    return Constraints(frozenset(k for k, v in flags.items() if v) if isinstance(flags, Mapping) else frozenset(flags))
