"""Whole transformations of many recipes at once: substitute, add or delete ingredients, rewrite the steps, weigh before and after.

Every step is a join or a window over all recipes: what is removed, what each name is in the catalogue, candidates, the
index of every (recipe, candidate) pair, the winner, the new lists. No recipe takes a round trip of its own. A pair's index
comes from the sums of the recipe's other lines and the candidate's nutrients, so no line is repeated for a candidate; the catalogue and
the lines are written once, and only the catalogue's rows that some line or candidate names meet the lines. Tables with a row per recipe
are joined by merging: written small, they would pass for small, and their rows would go through the driver.

``Kitchen`` names the tables: recipes(id, name, ingredients, steps), weights(id, serving_size, servings),
quantity(id, ingredients, qty_g), catalogue(ndb_no, descrip, nutrients, the diets' flags, macro, micro), tags(ndb_no, booleans).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.exprs import clean_name
from larder.operators.nutrition import line_sums, per_100g, per_gram, recipe_weights
from larder.operators.search import small
from larder.operators.substitute import Constraints, add_candidates, infer_role, ingredients_to_remove, judge_substitutes, match_ingredients, rewrite_steps, substitutes, transform_add, transform_delete, transform_response, transform_substitute
from larder.schemas import NUTRIENTS
from larder.sources.workdir import materialize


@dataclass(frozen=True)
class Kitchen:
    recipes: DataFrame
    weights: DataFrame
    quantity: DataFrame
    catalogue: DataFrame
    tags: DataFrame


def recipe_lines(kitchen: Kitchen) -> DataFrame:
    """id, pos, ingredient, ndb_no (the catalogue's best match of the name), qty_g, total_weight of every line."""
    lines = kitchen.recipes.select("id", F.posexplode("ingredients").alias("pos", "ingredient")).withColumn("key", clean_name(F.col("ingredient")))
    known = small(materialize(match_ingredients(lines.select(F.col("key").alias("name")).distinct(), kitchen.catalogue.select("ndb_no", "descrip")), "names"))
    grams = kitchen.quantity.groupBy("id", clean_name(F.col("ingredients")).alias("key")).agg(F.sum("qty_g").alias("qty_g"))
    out = lines.join(known.select(F.col("name").alias("key"), "ndb_no"), "key", "left").join(grams.hint("merge"), ["id", "key"], "left")
    return out.join(recipe_weights(kitchen.weights).hint("merge"), "id", "left").drop("key")


def _stored(kitchen: Kitchen) -> Kitchen:
    """The kitchen with its catalogue, which a transformation reads many times, written once."""
    return replace(kitchen, catalogue=materialize(kitchen.catalogue, "catalogue"))


def _named(table: DataFrame, *ids: DataFrame) -> DataFrame:
    """The rows of a table by ndb_no that some of these ids (column ndb_no) name; they go to every task where they are few."""
    used = small(materialize(reduce(DataFrame.unionByName, ids).distinct(), "used"))
    return small(materialize(table.join(used, "ndb_no", "left_semi"), "named"))


def _facts(kitchen: Kitchen, *ids: DataFrame) -> DataFrame:
    return _named(kitchen.catalogue.select("ndb_no", *NUTRIENTS), *ids)


def removals(lines: DataFrame, kitchen: Kitchen, constraints: Constraints) -> DataFrame:
    """id, ingredient, breaks, place of what the constraints remove."""
    used = lines.select("ndb_no")
    facts = _facts(kitchen, used).withColumn("has_nutrition", F.lit(True))
    full = lines.join(_named(kitchen.tags, used), "ndb_no", "left").join(facts, "ndb_no", "left").withColumn("has_nutrition", F.coalesce("has_nutrition", F.lit(False)))
    return ingredients_to_remove(full, constraints)


def _swapped(listed: DataFrame, offers: DataFrame, on: list[str], facts: DataFrame) -> DataFrame:
    """id, target, place, candidate, descrip, rank, score_sante: each list's index with each candidate in the place of its target.

    ``listed``: id, target, place, own (whether the line is the target's), ndb_no, qty_g, total_weight; ``offers``: candidate, descrip, rank and the columns ``on``.
    """
    sums = line_sums(listed, facts, "id", "target", "place", own=F.col("own"))
    tried = sums.join(offers, on).join(small(per_gram(facts, "candidate")), "candidate")
    got = per_100g(tried, "id", "target", "place", "candidate", "descrip", "rank", of=True)
    return got.select("id", "target", "place", "candidate", "descrip", "rank", F.round("score_sante", 9).alias("score_sante"))


def _finished(kitchen: Kitchen, changed: DataFrame, before: DataFrame, after: DataFrame, message: str, facts: DataFrame) -> DataFrame:
    """The response of every recipe with its new ingredients and steps. ``changed``: id, ingredients, steps; before and after: lines of changed recipes, whose ``facts`` are known."""
    named = kitchen.recipes.select("id", "name")
    weighed = lambda lines: named.join(per_100g(line_sums(lines.select("id", "ndb_no", "qty_g", "total_weight").repartition("id"), facts, "id"), "id").hint("merge"), "id")
    return transform_response(weighed(before), weighed(after), message).join(changed.select("id", "ingredients", "steps").hint("merge"), "id")


def _steps(recipes: DataFrame, mapping: DataFrame, added: bool = False) -> DataFrame:
    """Recipes with their steps rewritten. ``mapping``: id, place, old, new (null deletes; with ``added``, old is null and new is added)."""
    pair = F.transform(F.array_sort(F.collect_list(F.struct("place", "old", "new"))), lambda m: F.struct(m["old"].alias("old"), m["new"].alias("new")))
    per = mapping.groupBy("id").agg(pair.alias("_map"))
    empty = F.array().cast("array<struct<old:string,new:string>>")
    out = recipes.join(per.hint("merge"), "id", "left").withColumn("_map", F.coalesce("_map", empty))
    if added:
        out = out.withColumns({"_added": F.transform("_map", lambda m: m["new"]), "_map": empty})
    return rewrite_steps(out, "_map", added="_added" if added else None).drop("_map", "_added")


def substitute_flow(kitchen: Kitchen, constraints: Constraints, remove: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Ingredients that break the constraints (or ``remove``: id, ingredient, place) replaced by the candidate of the highest index.

    id, original_name, transformed_name, success, message, nutrition_before, nutrition_after, ingredients, steps; a recipe
    without any replacement keeps its lists and has success false. Each line is judged on the original list, all in one
    plan; ``substitute_rounds`` judges one after another.
    """
    kitchen = _stored(kitchen)
    lines = materialize(recipe_lines(kitchen), "lines")
    gone = removals(lines, kitchen, constraints) if remove is None else remove
    gone = materialize(gone.select("id", F.col("ingredient").alias("target"), "place"), "gone")
    found = materialize(substitutes(gone.select("target").distinct(), kitchen.catalogue, constraints, k), "substitutes")
    offers = found.select("target", F.col("ndb_no").alias("candidate"), "descrip", "rank")
    facts = _facts(kitchen, lines.select("ndb_no"), found.select("ndb_no"))
    listed = lines.join(gone.hint("merge"), "id").withColumn("own", F.col("ingredient") == F.col("target"))
    best = judge_substitutes(_swapped(listed, small(offers), ["target"], facts))
    best = materialize(best.select("id", F.col("target").alias("old"), F.col("descrip").alias("new"), "candidate", "place"), "best")
    changed = _steps(transform_substitute(kitchen.recipes, best.select("id", "old", "new")), best)
    known = best.select("id", F.col("old").alias("ingredient"), "candidate")
    after = lines.join(best.select("id").distinct().hint("merge"), "id", "left_semi").join(known.hint("merge"), ["id", "ingredient"], "left").withColumn("ndb_no", F.coalesce("candidate", "ndb_no"))
    return _finished(kitchen, changed, lines, after, "substituted", facts)


def _removed(kitchen: Kitchen, lines: DataFrame, constraints: Constraints, remove: DataFrame | None) -> DataFrame:
    """id, ingredient, place (from 1): a recipe's given list, then what else breaks an active diet; the constraints' own choice where it has none."""
    found = removals(lines, kitchen, constraints).select("id", "ingredient", "place")
    if remove is None:
        return found
    given = remove.select("id", "ingredient", F.lit(0).alias("extra"), "place")
    extra = found if constraints.diets else found.join(given.select("id").distinct(), "id", "left_anti")
    both = given.unionByName(extra.withColumn("extra", F.lit(1))).join(lines.select("id", "ingredient").distinct().hint("merge"), ["id", "ingredient"], "left_semi")
    once = both.groupBy("id", "ingredient").agg(F.min(F.struct("extra", "place")).alias("at"))
    return once.select("id", "ingredient", F.row_number().over(Window.partitionBy("id").orderBy("at", "ingredient")).alias("place"))


def substitute_rounds(kitchen: Kitchen, constraints: Constraints, remove: DataFrame | None = None, given: DataFrame | None = None, k: int = 5) -> DataFrame:
    """As substitute_flow, each replacement judged on the list that the ones before it have left.

    ``remove``: id, ingredient, place: what a recipe's user wants gone; what breaks an active diet goes besides, and names that
    the recipe lacks are ignored. ``given``: id, place, name: the user's substitute for the removal of that place, taken
    without judgment if the catalogue knows the name; surplus ones are ignored. The working list starts with the
    lines that stay; a removal joins it with its substitute, in its turn, and stays out of it, and of the nutrition after, where
    none is found, though not out of the recipe. A recipe's n-th removals are one round over all recipes, three rounds
    without given lists; a round is written before the next.
    """
    kitchen = _stored(kitchen)
    lines = materialize(recipe_lines(kitchen), "lines")
    gone = materialize(_removed(kitchen, lines, constraints, remove), "gone")
    found = materialize(substitutes(gone.select(F.col("ingredient").alias("target")).distinct(), kitchen.catalogue, constraints, k), "substitutes")
    offers = small(found.select(F.col("target").alias("ingredient"), F.col("ndb_no").alias("candidate"), "descrip", "rank"))
    open_places = gone
    if given is not None:
        known = materialize(match_ingredients(given.select("name").distinct(), kitchen.catalogue.select("ndb_no", "descrip")).where("ndb_no is not null"), "known")
        own = given.join(small(known), "name").groupBy("id", "place").agg(F.min(F.struct("ndb_no", "descrip")).alias("c"))
        own = materialize(gone.join(own.hint("merge"), ["id", "place"]).select("id", "ingredient", "place", F.col("c.ndb_no").alias("candidate"), F.col("c.descrip").alias("descrip"), F.lit(1).alias("rank")), "given")
        open_places = gone.join(own.hint("merge"), ["id", "place"], "left_anti")
    tried = open_places.join(offers, "ingredient").select("id", "ingredient", "place", "candidate", "descrip", "rank")
    tried = materialize(tried if given is None else tried.unionByName(own), "offers")
    facts = _facts(kitchen, lines.select("ndb_no"), tried.select(F.col("candidate").alias("ndb_no")))
    state = lines.join(gone.hint("merge"), ["id", "ingredient"], "left").withColumn("live", F.col("place").isNull())
    best = None
    for turn in range(1, (tried.agg(F.max("place")).first()[0] or 0) + 1):
        now = tried.where(F.col("place") == turn).select("id", "candidate", "descrip", "rank")
        target = gone.where(F.col("place") == turn).select("id", F.col("ingredient").alias("target"))
        listed = state.where(F.col("live") | (F.col("place") == turn)).join(target.hint("merge"), "id").withColumns({"own": ~F.col("live"), "place": F.lit(turn)})
        won = judge_substitutes(_swapped(listed, now.hint("merge"), ["id"], facts))
        won = materialize(won.select("id", F.col("target").alias("old"), F.col("descrip").alias("new"), "candidate", F.lit(turn).alias("place")), "round")
        best = won if best is None else best.unionByName(won)
        taken = won.select("id", "place", F.col("candidate").alias("_new"))
        state = state.join(taken.hint("merge"), ["id", "place"], "left").withColumns({"ndb_no": F.coalesce("_new", "ndb_no"), "live": F.col("live") | F.col("_new").isNotNull()}).drop("_new")
        state = materialize(state, "list")
    if best is None:
        best = kitchen.recipes.select("id", F.lit("").alias("old"), F.lit("").alias("new"), F.lit("").alias("candidate"), F.lit(0).alias("place")).where("false")
    changed = _steps(transform_substitute(kitchen.recipes, best.select("id", "old", "new")), best)
    after = state.where("live").join(best.select("id").distinct().hint("merge"), "id", "left_semi")
    return _finished(kitchen, changed, lines, after.select(*lines.columns), "substituted", facts)


def add_flow(kitchen: Kitchen, constraints: Constraints, given: DataFrame | None = None) -> DataFrame:
    """The addition, among up to five for the first active goal, that gives each recipe the highest index; columns as in substitute_flow.

    ``given``: id, place, name: the user's own additions, which come before it in their order, weighed by the catalogue's match of
    the name. What a recipe has already is not added again.
    """
    kitchen = _stored(kitchen)
    lines = materialize(recipe_lines(kitchen), "lines")
    roles = lines.join(_named(kitchen.tags.select("ndb_no", infer_role().alias("role")), lines.select("ndb_no")), "ndb_no", "left").groupBy("id").agg(F.collect_set("role").alias("roles"))
    rich = kitchen.catalogue.select("ndb_no", "descrip", *NUTRIENTS).join(kitchen.tags, "ndb_no", "left")
    offered = materialize(add_candidates(materialize(roles, "roles"), materialize(rich, "tagged"), constraints), "offered")
    facts = _facts(kitchen, lines.select("ndb_no"), offered.select("ndb_no"))
    # a recipe's sums once; an addition is one more line without grams
    sums = line_sums(lines.select("id", "ndb_no", "qty_g", "total_weight").repartition("id"), facts, "id", open_lines=1)
    tried = sums.join(offered.withColumnRenamed("ndb_no", "candidate").hint("merge"), "id").join(small(per_gram(facts, "candidate")), "candidate")
    scored = per_100g(tried, "id", F.lit("added").alias("target"), "candidate", "rank", "descrip", of=True).withColumn("score_sante", F.round("score_sante", 9))
    best = judge_substitutes(scored).select("id", F.col("descrip").alias("new"), "candidate", F.lit(1).alias("last"), F.lit(0).alias("place"))
    if given is not None:
        known = match_ingredients(given.select("name").distinct(), kitchen.catalogue.select("ndb_no", "descrip"))
        known = small(materialize(known.select("name", F.col("ndb_no").alias("candidate")), "known"))
        wanted = given.join(known, "name", "left")
        best = best.unionByName(wanted.select("id", F.col("name").alias("new"), "candidate", F.lit(0).alias("last"), "place"))
    once = best.groupBy("id", "new").agg(F.min(F.struct("last", "place", "candidate")).alias("at")).join(lines.select("id", F.col("ingredient").alias("new")).hint("merge"), ["id", "new"], "left_anti")
    once = once.select("id", "new", "at.candidate", F.row_number().over(Window.partitionBy("id").orderBy("at.last", "at.place", "new")).alias("place"))
    once = materialize(once, "added")
    per = once.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "new"))), lambda x: x["new"]).alias("new"))
    changed = _steps(transform_add(kitchen.recipes, per), once.select("id", "place", F.lit(None).cast("string").alias("old"), "new"), added=True)
    more = once.select("id", F.col("candidate").alias("ndb_no"), F.lit(None).cast("double").alias("qty_g")).join(recipe_weights(kitchen.weights).hint("merge"), "id", "left")
    after = lines.select("id", "ndb_no", "qty_g", "total_weight").join(once.select("id").distinct().hint("merge"), "id", "left_semi").unionByName(more)
    facts = facts if given is None else _facts(kitchen, after.select("ndb_no"))
    return _finished(kitchen, changed, lines, after, "added", facts)


def delete_flow(kitchen: Kitchen, constraints: Constraints, remove: DataFrame | None = None) -> DataFrame:
    """Ingredients that break the constraints (or ``remove``: id, ingredient, place) left out; columns as in substitute_flow."""
    kitchen = _stored(kitchen)
    lines = materialize(recipe_lines(kitchen), "lines")
    gone = materialize(removals(lines, kitchen, constraints) if remove is None else remove, "gone")
    pairs = gone.select("id", F.col("ingredient").alias("old"), F.lit(None).cast("string").alias("new"), "place")
    names = gone.groupBy("id").agg(F.collect_set("ingredient").alias("gone"))
    changed = _steps(transform_delete(kitchen.recipes, names), pairs)
    after = lines.join(gone.select("id").distinct(), "id", "left_semi").join(gone.select("id", "ingredient"), ["id", "ingredient"], "left_anti")
    return _finished(kitchen, changed, lines, after, "deleted", _facts(kitchen, lines.select("ndb_no")))


def response_json(responses: DataFrame) -> DataFrame:
    """Responses as the JSON text that the transformation log stores: id, response."""
    facts = lambda c: F.struct(*(F.col(f"{c}.{n}").alias("calories" if n == "energy_kcal" else n) for n in NUTRIENTS), F.col(f"{c}.score_sante").alias("health_score"))
    packed = F.struct("original_name", F.struct(F.col("transformed_name").alias("name"), "ingredients", "steps").alias("recipe"), "success", "message", facts("nutrition_before").alias("nutrition_before"), F.when(F.col("nutrition_after").isNotNull(), facts("nutrition_after")).alias("nutrition_after"))
    return responses.select("id", F.to_json(packed).alias("response"))
