"""Mergeable states of the search log and of numbers: stored once per day and user, merged for any range instead of reading the log again.

Counts and sums are exact. Distinct counts are HyperLogLog sketches of 2**LG_K registers: relative standard error 1.04 / sqrt(2**LG_K),
1.6 % at 12, and next to exact for a few hundred values. Frequent tags come from states that track ``TRACKED`` values: with no
more values than that, counts are exact. Quantiles are KLL sketches of size ``KLL``: rank error under 1.4 % at 200, whatever the number
of values. The exact ways (``larder.operators.logs``, ``F.median``) stay the default everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, TRACKED, KLL, KLL_RANK_ERROR = 12, 10_000, 200, 0.0133


def daily_states(log: DataFrame, tags: Column, ts: str = "search_timestamp") -> DataFrame:
    """One row per day and user: counts, sums and sketches of the log's rows. Null names, tags and minutes count nowhere."""
    search = F.to_json(F.struct("conversation_id", "query", ts))
    rows = log.select(F.to_date(ts).alias("day"), "user_id", "name", F.col("minutes").cast("double").alias("minutes"), search.alias("search"), F.filter(tags, lambda t: t.isNotNull()).alias("tags"))
    hll = lambda c: F.hll_sketch_agg(c, LG_K)
    per = rows.groupBy("day", "user_id").agg(
        F.count(F.lit(1)).alias("result_rows"), F.sum("minutes").alias("minutes"), F.count("minutes").alias("n_minutes"),
        hll("name").alias("names"), hll("search").alias("searches"), F.kll_sketch_agg_double("minutes", KLL).alias("minute_ranks"),
    )
    spread = rows.select("day", "user_id", F.explode("tags").alias("tag")).groupBy("day", "user_id")
    spread = spread.agg(hll("tag").alias("tags"), F.expr(f"approx_top_k_accumulate(tag, {TRACKED})").alias("top_tags"))
    same = per["day"].eqNullSafe(spread["day"]) & per["user_id"].eqNullSafe(spread["user_id"])
    return per.join(spread, same, "left").select(per["*"], spread["tags"], spread["top_tags"])


def merge_states(states: DataFrame, until: Column, days: int, user_id: str | None = None) -> DataFrame:
    """One row: the measures of the ``days`` days that end with ``until`` (a date), of one user or of all."""
    own = states.where((F.col("day") > F.date_sub(until, days)) & (F.col("day") <= until))
    own = own.where(F.col("user_id") == user_id) if user_id is not None else own
    zero = lambda c: F.coalesce(c, F.lit(0))
    size = lambda c: zero(F.hll_sketch_estimate(F.hll_union_agg(c)))
    return own.agg(
        zero(F.sum("result_rows")).alias("result_rows"), F.coalesce(F.sum("minutes") / F.sum("n_minutes"), F.lit(0.0)).alias("avg_minutes"),
        size("names").alias("distinct_recipes"), size("searches").alias("searches"), size("tags").alias("tag_diversity"),
    )


def merged_tags(states: DataFrame, until: Column, days: int, k: int = 5) -> DataFrame:
    """value, n of the k most frequent tags of a range; ties by value."""
    own = states.where((F.col("day") > F.date_sub(until, days)) & (F.col("day") <= until) & F.col("top_tags").isNotNull())
    # all tracked values come back, so that ties at the k-th place go by value
    # grouped by a constant, as no states at all give no group
    found = own.groupBy(F.lit(1)).agg(F.expr(f"approx_top_k_combine(top_tags, {TRACKED})").alias("s")).select(F.explode(F.expr(f"approx_top_k_estimate(s, {TRACKED})")).alias("t"))
    return found.select(F.col("t.item").alias("value"), F.col("t.count").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def quantiles(df: DataFrame, col: str, at: Sequence[float], exact: bool = True, size: int = KLL, by: Sequence[str] = ()) -> DataFrame:
    """``by`` columns, quantiles (array, in the order of ``at``). With ``exact`` false from KLL sketches, which combine in each task and
    never hold the distinct values; their quantiles are values of the column, with a rank error of ``KLL_RANK_ERROR`` at size 200."""
    value = F.col(col).cast("double")
    if exact:
        return df.groupBy(*by).agg(F.percentile(value, [float(q) for q in at]).alias("quantiles"))
    sketch = df.groupBy(*by).agg(F.kll_sketch_agg_double(value, size).alias("s"))
    return sketch.select(*by, F.array(*(F.kll_sketch_get_quantile_double("s", F.lit(float(q))) for q in at)).alias("quantiles"))
