"""Recipe-shaped tables derived from the test tables, in SQL that Spark and DuckDB both run.

A recipe is an order, its ingredient lines are the order's lines, an ingredient is a part; logs and
messages come from events and conversations. Every table is a rule over whole tables, so it grows with them.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession

from larder.schemas import MORE_NUTRIENTS, NUTRIENTS

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Factors with many digits, so that no result lies on a border of rounding.
SCALES = [math.sqrt(x) for x in (27, 0.38, 0.1, 0.28, 0.86, 0.17, 0.67, 637, 131, 0.07, 1625, 1.25, 17)]
_nutrients = ", ".join(f"CASE WHEN (p_partkey + {i}) % 13 = 0 THEN NULL ELSE CAST((p_partkey * {i + 3}) % 97 AS DOUBLE) * {scale} END AS {n}" for i, (n, scale) in enumerate(zip(NUTRIENTS, SCALES, strict=True)))

_more = ", ".join(f"CASE WHEN (p_partkey + {i}) % 11 = 0 THEN NULL ELSE CAST((p_partkey * {2 * i + 5}) % 89 AS DOUBLE) * {0.37 * (i + 1)} END AS {n}" for i, n in enumerate(MORE_NUTRIENTS))

#: name: (tables it reads, SELECT)
STAND_INS: dict[str, str] = {
    "recipes": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'abc' ELSE CAST((o_orderkey % 7) * 50 AS STRING) END AS serving_size, CAST(o_orderkey % 5 AS STRING) AS servings, o_orderpriority AS name FROM {orders}",
    "quantity": "SELECT l_orderkey AS id, concat('i', CAST(l_partkey AS STRING)) AS ingredients, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_quantity END AS qty_g FROM {lineitem}",
    "ingredients": f"SELECT CAST(p_partkey AS STRING) AS ndb_no, p_name AS descrip, {_nutrients} FROM {{part}}",
    "wide_ingredients": f"SELECT CAST(p_partkey AS STRING) AS ndb_no, p_name AS descrip, {_nutrients}, {_more} FROM {{part}}",
    "matching": "SELECT DISTINCT l_orderkey AS recipe_id, concat('i', CAST(l_partkey AS STRING)) AS ingredient, CAST(CASE WHEN c = 0 THEN l_partkey ELSE (l_partkey * 7) % 200 + 1 END AS STRING) AS ndb_no FROM {lineitem} CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 AS c) AS two",
    "tagged": "SELECT CAST(p_partkey AS STRING) AS ndb_no, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 5 = 0 END AS is_dairy, p_partkey % 4 = 0 AS is_gluten, p_partkey % 9 = 0 AS contains_nuts, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_partkey % 3 <> 0 END AS is_vegetarian, p_partkey % 2 = 0 AS is_vegetable, p_partkey % 17 = 0 AS is_seafood, p_partkey % 6 = 0 AS is_sweetener, p_partkey % 10 = 0 AS is_grain FROM {part}",
    "dishes": "SELECT p_partkey AS id, CASE WHEN p_partkey % 19 = 0 THEN '  ' ELSE p_name END AS name, CAST(p_size - 2 AS BIGINT) AS minutes, split(concat(p_type, ',', p_brand, ',', CASE WHEN p_size % 3 = 0 THEN 'Vegan' WHEN p_size % 3 = 1 THEN 'no meat' ELSE 'x' END, ',', CASE WHEN p_size % 4 = 0 THEN 'meatless' WHEN p_size % 4 = 1 THEN 'ramadan' ELSE 'low-carb' END), ',') AS tags, split(p_name, ' ') AS ingredients, split(concat('Chop ', p_name, ';Mix ', p_type, ';Serve'), ';') AS steps, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE concat('About ', p_name, ' [\"it''s\"] ,  ', p_brand, ' | Crème!') END AS description, CAST(CASE WHEN p_partkey % 5 = 0 THEN 4 ELSE 3 END AS BIGINT) AS n_steps, CAST(2 AS BIGINT) AS n_ingredients, p_retailprice AS price FROM {part}",
    "dish_quantity": "SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS ingredients, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size * 1.37 END AS qty_g FROM {part} UNION ALL SELECT p_partkey, split_part(p_name, ' ', 2), CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size * 2.41 END FROM {part}",
    "dish_weights": "SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'abc' ELSE CAST((p_partkey % 7) * 50 AS STRING) END AS serving_size, CAST(p_partkey % 5 AS STRING) AS servings FROM {part}",
    "search_log": "SELECT event_id, concat('c', CAST(user_id % 40 AS STRING)) AS conversation_id, CAST(user_id AS STRING) AS user_id, event_type AS query, ts AS search_timestamp, event_id % 500 AS recipe_id, concat('Dish ', CAST(event_id % 50 AS STRING)) AS name, value AS minutes, concat('{{\"id\":', CAST(event_id % 500 AS STRING), ',\"tags\":[\"', event_type, '\",\"course\",\"t', CAST(event_id % 7 AS STRING), '\"],\"nutrition_detailed\":{{\"sugar_g_100g\":', CAST(event_id % 31 AS STRING), '}}}}') AS raw_recipe_json FROM {events} WHERE event_type IN ('view', 'click')",
    "transform_log": "SELECT event_id, concat('c', CAST(user_id % 40 AS STRING)) AS conversation_id, CAST(user_id AS STRING) AS user_id, concat('Dish ', CAST(event_id % 50 AS STRING)) AS original_name, event_type <> 'error' AS success, ts AS transform_timestamp, concat('{{\"calories\":', CAST(event_id % 900 AS STRING), ',\"protein_g\":', CAST(event_id % 37 AS STRING), CASE WHEN event_id % 3 = 0 THEN '' ELSE concat(',\"health_score\":', CAST(event_id % 101 AS STRING)) END, '}}') AS nutrition_before, concat('{{\"calories\":', CAST(event_id % 700 AS STRING), ',\"protein_g\":', CAST(event_id % 41 AS STRING), ',\"health_score\":', CAST(event_id % 97 AS STRING), '}}') AS nutrition_after FROM {events} WHERE event_type IN ('purchase', 'signup', 'error')",
    "messages": "SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn + 1000 AS STRING)) AS id, concat('c', CAST(conv_id % 40 AS STRING)) AS conversation_id, role, text AS content, CASE WHEN turn % 3 = 0 THEN NULL ELSE conv_id END AS thread_id, CASE WHEN turn % 2 = 0 THEN NULL ELSE turn END AS message_id, turn AS created_at FROM {conversations}",
    "agent_events": "SELECT concat('run', CAST(user_id AS STRING)) AS run_id, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'tool_use' ELSE 'tool_result' END AS type, event_type AS tool_name, CASE WHEN event_id % 5 = 3 THEN NULL ELSE concat('u', CAST(floor(event_id / 2) AS STRING)) END AS tool_use_id, CASE WHEN event_id % 2 = 0 THEN concat('{{\"query\":\"q', CAST(event_id AS STRING), '\"}}') END AS tool_input, CASE WHEN event_id % 2 = 0 THEN NULL WHEN event_id % 3 = 0 THEN concat('{{\"results\":[{{\"id\":', CAST(event_id AS STRING), '}},{{\"id\":\"', CAST(event_id % 9 AS STRING), '\"}}],\"total_found\":77}}') WHEN event_id % 3 = 1 THEN concat('broken \"id\": ', CAST(event_id AS STRING), ', \"id\": ', CAST(event_id AS STRING)) ELSE '{{\"results\":[]}}' END AS content, value FROM {events}",
    "judgments": "SELECT concat('q', CAST(q.vec_id AS STRING)) AS query, d.vec_id AS doc_id, CAST(1.0 AS DOUBLE) AS relevance FROM {embeddings} AS q JOIN {embeddings} AS d ON d.label = q.label WHERE q.vec_id % 100 = 0 AND d.vec_id % 3 <> 0 UNION ALL SELECT concat('q', CAST(q.vec_id AS STRING)), d.vec_id, CAST(0.5 AS DOUBLE) FROM {embeddings} AS q JOIN {embeddings} AS d ON d.label = q.label + 1 WHERE q.vec_id % 100 = 0 AND d.vec_id % 3 <> 0",
}


def tables_of(name: str) -> list[str]:
    return re.findall(r"(?<!\{)\{(\w+)\}(?!\})", STAND_INS[name])


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stand_in(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(STAND_INS[name], **{t: base(spark, sf_dir, t) for t in tables_of(name)})


def with_stand_ins(sql: str, *names: str) -> str:
    """DuckDB text: the stand-ins as named subqueries, then the query."""
    parts = [f"{n} AS ({STAND_INS[n].format(**{t: t for t in BASE})})" for n in names]
    if not parts:
        return sql
    body = sql.strip()
    return f"WITH {', '.join(parts)}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {', '.join(parts)} {body}"
