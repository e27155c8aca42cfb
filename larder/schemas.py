"""Canonical table schemas; names follow the engine's logical model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nutrients of the per-100 g profile, in table order.
NUTRIENTS = ("energy_kcal", "protein_g", "saturated_fats_g", "fat_g", "carb_g", "fiber_g", "sugar_g", "sodium_mg", "calcium_mg", "iron_mg", "potassium_mg", "vitc_mg", "magnesium_mg")
#: The other nutrients of an ingredient.
MORE_NUTRIENTS = ("phosphorus_mg", "zinc_mg", "copper_mcg", "manganese_mg", "selenium_mcg", "thiamin_mg", "riboflavin_mg", "niacin_mg", "vitb6_mg", "folate_mcg", "vitb12_mcg", "vita_mcg", "vite_mg", "vitd2_mcg")
#: Order of a recipe's seven-number nutrition array.
NUTRITION_ARRAY = ("calories", "total_fat", "sugar", "sodium", "protein", "saturated_fat", "carbs")


_TYPES = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP_NTZ": T.TimestampNTZType(), "ARRAY<STRING>": T.ArrayType(T.StringType()), "ARRAY<DOUBLE>": T.ArrayType(T.DoubleType())}


def _struct(spec: str) -> T.StructType:
    """A schema from "name TYPE, ..."; needs no running session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split(" ") for x in spec.split(", "))])


RECIPES_RAW = _struct("id BIGINT, name STRING, minutes BIGINT, contributor_id BIGINT, submitted DATE, tags ARRAY<STRING>, nutrition ARRAY<DOUBLE>, n_steps BIGINT, steps ARRAY<STRING>, description STRING, ingredients ARRAY<STRING>, n_ingredients BIGINT, filters ARRAY<STRING>")
RECIPE_IMAGES = _struct("id BIGINT, image_url STRING")
RECIPE_QUANTITIES = _struct("id BIGINT, serving_size STRING, servings STRING, search_terms ARRAY<STRING>, ingredients_raw_str ARRAY<STRING>")
RECIPES = _struct("id BIGINT, name STRING, minutes BIGINT, contributor_id BIGINT, submitted DATE, tags ARRAY<STRING>, nutrition ARRAY<DOUBLE>, n_steps BIGINT, steps ARRAY<STRING>, description STRING, ingredients ARRAY<STRING>, n_ingredients BIGINT, filters ARRAY<STRING>, has_image BIGINT, image_url STRING, ingredients_raw_str ARRAY<STRING>, serving_size STRING, servings BIGINT, search_terms ARRAY<STRING>")
INGREDIENTS = _struct("ndb_no STRING, descrip STRING, " + ", ".join(f"{n} DOUBLE" for n in NUTRIENTS))
INGREDIENT_QUANTITY = _struct("id BIGINT, ingredients STRING, quantity_raw_str STRING, quantity DOUBLE, unit STRING, qty_ml DOUBLE, qty_g DOUBLE")
INGREDIENT_MATCHING = _struct("recipe_id BIGINT, ingredient STRING, ndb_no STRING")
INGREDIENT_TAGGED = _struct("ndb_no STRING, descrip STRING, foodon_label STRING, is_dairy BOOLEAN, is_gluten BOOLEAN, contains_nuts BOOLEAN, is_vegetarian BOOLEAN, is_vegetable BOOLEAN, is_seafood BOOLEAN, is_sweetener BOOLEAN, is_grain BOOLEAN")
HIST_SEARCH = _struct("conversation_id STRING, user_id STRING, query STRING, total_found BIGINT, execution_time_ms DOUBLE, search_status STRING, search_timestamp TIMESTAMP_NTZ, recipe_id BIGINT, name STRING, minutes DOUBLE, raw_recipe_json STRING")
HIST_TRANSFORMATIONS = _struct("conversation_id STRING, user_id STRING, original_name STRING, transformed_name STRING, success BOOLEAN, message STRING, transform_timestamp TIMESTAMP_NTZ, nutrition_before STRING, nutrition_after STRING, full_response_json STRING")
MESSAGES = _struct("id STRING, conversation_id STRING, role STRING, content STRING, thread_id INT, message_id INT, created_at TIMESTAMP_NTZ")
AGENT_EVENTS = _struct("run_id STRING, seq BIGINT, type STRING, tool_name STRING, tool_use_id STRING, tool_input STRING, content STRING")
JUDGED = _struct("query STRING, doc_id BIGINT, relevance_score DOUBLE, justification STRING")
#: Columns joined to one text for embedding.
EMBEDDING_COLUMNS = ("name", "tags", "ingredients", "description", "steps")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in its order and types; absent ones are null, others are dropped."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*((F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
