"""Search and transformation logs, KPIs, conversation context and agent events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.exprs import json_number
from larder.functions.text import json_ids, recipe_reference, token_overlap
from larder.operators.filters import time_range

#: Tags that say nothing about a recipe.
NOISE_TAGS = ("preparation", "time-to-make", "course")


def log_search(responses: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per result of each response (none for empty results, unless keep_empty): typed facts and the raw JSON.

    ``responses``: conversation_id, user_id, query, total_found, execution_time_ms, status, ts, results (array of JSON text).
    """
    spread = F.explode_outer if keep_empty else F.explode
    rows = responses.select("conversation_id", "user_id", "query", "total_found", "execution_time_ms", F.col("status").alias("search_status"), F.col("ts").alias("search_timestamp"), spread("results").alias("raw_recipe_json"))
    number = lambda path: json_number(F.col("raw_recipe_json"), path)
    return rows.select(
        *rows.columns[:-1], F.get_json_object("raw_recipe_json", "$.id").try_cast("bigint").alias("recipe_id"), F.get_json_object("raw_recipe_json", "$.name").alias("name"),
        number("$.minutes").alias("minutes"), number("$.n_ingredients").alias("n_ingredients"), number("$.nutrition_detailed.energy_kcal_100g").alias("calories"), number("$.score_health").alias("score_health"), "raw_recipe_json",
    )


def log_transformation(responses: DataFrame) -> DataFrame:
    """One row per response: names, success, message and the nutrition before and after as JSON."""
    part = lambda path: F.get_json_object("response", path)
    return responses.select("conversation_id", "user_id", part("$.original_name").alias("original_name"), part("$.recipe.name").alias("transformed_name"), (part("$.success") == "true").alias("success"), part("$.message").alias("message"), F.col("ts").alias("transform_timestamp"), part("$.nutrition_before").alias("nutrition_before"), part("$.nutrition_after").alias("nutrition_after"), F.col("response").alias("full_response_json"))


def scoped(log: DataFrame, ts: str, as_of: Column, time_name: str = "all", user: str | None = None) -> DataFrame:
    """A log within a named time range, of one user if given."""
    df = log.where(time_range(F.col(ts), time_name, as_of))
    return df if user is None else df.where(F.col("user_id") == user)


def delta(path: str, before: str = "nutrition_before", after: str = "nutrition_after") -> Column:
    return json_number(F.col(before), path) - json_number(F.col(after), path)


def kpi(search_log: DataFrame, transform_log: DataFrame) -> DataFrame:
    """One row over logs that were scoped before: counts, averages (null as 0), conversion and diversity."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ok = transform_log.where("success")
    t = ok.agg(
        F.count(F.lit(1)).alias("transformations"), zero(F.avg(delta("$.calories"))).alias("avg_calories_saved"),
        zero(F.avg(-delta("$.protein_g"))).alias("avg_protein_gained"), zero(F.avg(-delta("$.health_score"))).alias("avg_health_gain"),
    )
    key = F.struct("conversation_id", "query", "search_timestamp")
    s = search_log.agg(F.count(F.lit(1)).alias("result_rows"), F.count_distinct(key).alias("searches"), zero(F.avg("minutes")).alias("avg_minutes"), F.count_distinct("name").alias("distinct_recipes"))
    rate = F.coalesce(F.when(F.col("result_rows") > 0, F.col("transformations") / F.col("result_rows") * 100.0), F.lit(0.0))
    return s.crossJoin(F.broadcast(t)).withColumns({"conversion_rate": rate, "remainder": F.greatest(F.col("result_rows") - F.col("transformations"), F.lit(0))})  # two rows of one


def top_k_exploded(log: DataFrame, array: Column, k: int = 5, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The k most frequent elements of an array column: value, n; ties by value."""
    rows = log.select(F.explode(array).alias("value")).where("value is not null")
    rows = rows.where(~F.col("value").isin(*exclude)) if exclude else rows
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def diversity(log: DataFrame, array: Column, approximate: bool = False) -> DataFrame:
    rows = log.select(F.explode(array).alias("value"))
    return rows.agg((F.approx_count_distinct("value") if approximate else F.count_distinct("value")).alias("diversity"))


def extremes(log: DataFrame, name: str, score: str, k: int = 5) -> DataFrame:
    """The k best and k worst distinct (name, score): side, name, score."""
    rows = log.where(F.col(score).isNotNull()).select(F.col(name).alias("name"), F.col(score).alias("score")).distinct()
    best = rows.orderBy(F.desc("score"), "name").limit(k).withColumn("side", F.lit("best"))
    return best.unionByName(rows.orderBy("score", "name").limit(k).withColumn("side", F.lit("worst")))


def biggest_win(log: DataFrame, name: str, gain: Column) -> DataFrame:
    return log.select(F.col(name).alias("name"), gain.alias("gain")).where("gain is not null").orderBy(F.desc("gain"), "name").limit(1)


def nutrition_profile(log: DataFrame, paths: dict[str, str], json: str = "raw_recipe_json", digits: int = 1) -> DataFrame:
    """Rounded averages of JSON numbers, 0 where none is there."""
    return log.agg(*(F.round(F.coalesce(F.avg(json_number(F.col(json), p)), F.lit(0.0)), digits).alias(n) for n, p in paths.items()))


def conversation_stats(search_log: DataFrame, transform_log: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Per conversation: result_rows, transformations and the summed rounded deltas after - before; a missing number counts as 0."""
    num = lambda c, f: F.coalesce(json_number(F.col(c), f"$.{f}"), F.lit(0.0))
    s = search_log.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("result_rows"))
    t = transform_log.where("success").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("transformations"), *(F.sum(F.round(num("nutrition_after", f) - num("nutrition_before", f), 2)).alias(f"delta_{f}") for f in fields))
    out = s.join(t, "conversation_id", "full_outer")
    return out.select("conversation_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("result_rows", "transformations")), *(F.coalesce(f"delta_{f}", F.lit(0.0)).alias(f"delta_{f}") for f in fields))


# ---- conversations ----------------------------------------------------------------------------


def recent_recipes(search_log: DataFrame, top: int = 3) -> DataFrame:
    """Per conversation and query its newest ``top`` recipes, numbered: conversation_id, query, position, recipe_id, name."""
    order = Window.partitionBy("conversation_id", "query").orderBy(F.desc("search_timestamp"), "recipe_id")
    return search_log.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top).select("conversation_id", "query", "position", "recipe_id", "name")


def last_messages(messages: DataFrame, limit: int = 4, skip: int = 1) -> DataFrame:
    """Messages of each conversation but the newest ``skip``, the ``limit`` before them, oldest first by ``place``."""
    order = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id"))
    picked = messages.withColumn("rn", F.row_number().over(order)).where((F.col("rn") > skip) & (F.col("rn") <= skip + limit))
    return picked.withColumn("place", F.row_number().over(Window.partitionBy("conversation_id").orderBy("created_at", "id"))).drop("rn")


def latest_message(messages: DataFrame, condition: Column | None = None) -> DataFrame:
    """The newest row of each conversation that meets a condition."""
    rows = messages if condition is None else messages.where(condition)
    order = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id"))
    return rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def thread_position(messages: DataFrame) -> DataFrame:
    """Per conversation thread_id and message_id of its newest assistant message with both; else the newest thread with message 0."""
    newest = lambda value, cond: F.max_by(value, F.when(cond, F.struct("created_at", "id")))
    both = (F.col("role") == "assistant") & F.col("thread_id").isNotNull() & F.col("message_id").isNotNull()
    thread = F.col("thread_id").isNotNull()
    got = messages.groupBy("conversation_id").agg(newest(F.struct("thread_id", "message_id"), both).alias("a"), newest(F.col("thread_id"), thread).alias("t"), F.max(both).alias("has"), F.max(thread).alias("some"))
    first = F.when(F.col("has"), F.col("a.thread_id")).when(F.col("some"), F.col("t"))
    return got.select("conversation_id", first.alias("thread_id"), F.when(F.col("has"), F.col("a.message_id")).when(F.col("some"), 0).alias("message_id"))


def conversation_context(messages: DataFrame, search_log: DataFrame) -> DataFrame:
    """Per conversation: searches ("Search for 'q': 1. name (ID: n), ...; ...") and history ("role: text" lines)."""
    item = F.concat(F.col("position"), F.lit(". "), F.coalesce("name", F.lit("")), F.lit(" (ID: "), F.col("recipe_id"), F.lit(")"))
    text = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x["text"])
    per_query = recent_recipes(search_log).withColumn("text", item).groupBy("conversation_id", "query").agg(F.array_join(text(("position", "text")), ", ").alias("list"))
    line = F.concat(F.lit("Search for '"), F.col("query"), F.lit("': "), F.col("list"))
    searches = per_query.withColumn("text", line).groupBy("conversation_id").agg(F.array_join(text(("query", "text")), "; ").alias("searches"))
    said = last_messages(messages).withColumn("text", F.concat(F.col("role"), F.lit(": "), F.col("content"))).groupBy("conversation_id").agg(F.array_join(text(("place", "text")), "\n").alias("history"))
    return searches.join(said, "conversation_id", "full_outer")


def event_metadata(events: DataFrame, limit: int = 10) -> DataFrame:
    """Per run: query, ids (first ``limit``), total_found of the last search that gave ids; else its last query alone.

    A result without tool_use_id belongs to the last call before it.
    """
    known = F.last("tool_use_id", ignorenulls=True).over(Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = events.withColumn("call", F.coalesce("tool_use_id", known))
    query = F.get_json_object("tool_input", "$.query")
    calls = rows.where("type = 'tool_use'").groupBy("run_id", "call").agg(F.max_by(query, "seq").alias("query"), F.max("seq").alias("asked"))
    found = json_ids(F.col("content"))
    total = F.coalesce(F.get_json_object("content", "$.total_found").try_cast("bigint"), F.size(found).cast("bigint"))
    results = rows.where("type = 'tool_result'").groupBy("run_id", "call").agg(F.max_by(found, "seq").alias("ids"), F.max_by(total, "seq").alias("total"))
    both = calls.join(results, ["run_id", "call"], "left").withColumn("hit", F.coalesce(F.size("ids") > 0, F.lit(False)))
    best = both.groupBy("run_id").agg(F.max_by(F.struct("query", "ids", "total", "hit"), F.struct("hit", "asked")).alias("b"))
    return best.select("run_id", "b.query", F.when(F.col("b.hit"), F.slice("b.ids", 1, limit)).alias("ids"), F.when(F.col("b.hit"), F.col("b.total")).alias("total_found"))


def resolve_references(messages: DataFrame, recent: DataFrame, least: float = 0.6) -> DataFrame:
    """id, recipe_id: by the position a message names, else the one recipe whose name it holds best (share >= ``least``, no tie).

    ``recent``: conversation_id, position, recipe_id, name.
    """
    pairs = messages.select("id", "conversation_id", "content").withColumn("wanted", recipe_reference(F.col("content"))).join(recent, "conversation_id")
    scored = pairs.withColumn("score", F.coalesce(token_overlap(F.col("name"), F.col("content")), F.lit(0.0)))
    top = F.max("score").over(Window.partitionBy("id"))
    per = scored.withColumn("top", top).groupBy("id").agg(
        F.max("wanted").alias("wanted"), F.max(F.when(F.col("position") == F.col("wanted"), F.col("recipe_id"))).alias("by_position"),
        F.count_distinct(F.when((F.col("score") == F.col("top")) & (F.col("score") >= least), F.col("recipe_id"))).alias("n_best"),
        F.max(F.when((F.col("score") == F.col("top")) & (F.col("score") >= least), F.col("recipe_id"))).alias("by_name"),
    )
    return per.select("id", F.coalesce("by_position", F.when(F.col("n_best") == 1, F.col("by_name"))).alias("recipe_id"))


def agent_run_report(events: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Per run: tools called in order, their outputs in order, number of events, seconds between first and last.

    ``scores``: run_id, prompt, metric, score of each prompt's judgment; the report then has scores, a map of metric to the mean over
    the run's prompts, and n_prompts. A run without scores has an empty map; null scores count nowhere.
    """
    ordered = lambda cond, value: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("seq", F.col(value).alias("v"))))), lambda x: x["v"])
    report = events.groupBy("run_id").agg(
        ordered(F.col("type") == "tool_use", "tool_name").alias("tools"), ordered(F.col("type") == "tool_result", "content").alias("outputs"), F.count(F.lit(1)).alias("n_events"),
        (F.max("ts").cast("double") - F.min("ts").cast("double")).alias("elapsed_s"),
    )
    if scores is None:
        return report
    known = scores.where("metric is not null and score is not null")
    means = known.groupBy("run_id", "metric").agg(F.avg("score").alias("score"))
    per = means.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "score")))).alias("scores"))
    prompts = scores.groupBy("run_id").agg(F.count_distinct("prompt").alias("n_prompts"))
    out = report.join(per, "run_id", "left").join(prompts, "run_id", "left")
    return out.withColumns({"scores": F.coalesce("scores", F.create_map().cast("map<string,double>")), "n_prompts": F.coalesce("n_prompts", F.lit(0).cast("long"))})
