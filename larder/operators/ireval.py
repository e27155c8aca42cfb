"""Graded retrieval metrics, model ranking and judge agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.search import small
from larder.sources.workdir import materialize

METRICS = ("precision", "recall", "map", "ndcg", "mrr")
#: Weights of the combined metrics, by (metric, k).
COMBINED = {"combined": {("precision", 1): 0.25, ("precision", 3): 0.2, ("precision", 5): 0.15, ("ndcg", 3): 0.15, ("ndcg", 5): 0.15, ("ndcg", 10): 0.1}, "combined_recall": {("recall", 10): 0.4, ("recall", 20): 0.6}}


def attach_relevance(retrieved: DataFrame, judgments: DataFrame) -> DataFrame:
    """retrieved (query, doc_id, ...) with its relevance, 0 where no judgment is. Only judgments of retrieved documents are compared."""
    asked = judgments.join(small(retrieved.select("query", "doc_id").distinct()), ["query", "doc_id"], "left_semi")
    judged = asked.groupBy("query", "doc_id").agg(F.max("relevance").alias("relevance"))
    return retrieved.join(judged, ["query", "doc_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))


def retrieval_metrics(retrieved: DataFrame, judgments: DataFrame, ks: Sequence[int], groups: Sequence[str] = (), unique: bool = False, pool: DataFrame | None = None) -> DataFrame:
    """groups, query, k, and for each query and cut-off:

    precision: graded sum / k; recall: graded sum / graded sum of the query's whole pool; map: precision at each
    rank of a grade above 0.5, over the graded sum of the list; ndcg: against the best order of the retrieved
    list; mrr: first rank with grade 1. Divisions by nothing give 0.

    ``unique`` says that a document is judged once for a query, so that pools add up without telling documents apart. ``pool``: query,
    pool, where the graded sums are known; ``judgments`` then need only hold those of retrieved documents.
    """
    rel = attach_relevance(materialize(retrieved, "retrieved"), judgments)
    keys = [*groups, "query"]
    cut = rel.select("*", F.explode(F.array(*map(F.lit, ks))).alias("k")).where("rank <= k")
    by_rank = Window.partitionBy(*keys, "k").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = Window.partitionBy(*keys, "k").orderBy(F.desc("relevance"), "rank")
    seen = cut.withColumns({"running": F.sum("relevance").over(by_rank), "place": F.row_number().over(best)})
    gain = lambda at: F.col("relevance") / F.log2(F.col(at) + 1.0)
    sums = seen.groupBy(*keys, "k").agg(
        F.sum("relevance").alias("s"), F.sum(F.when(F.col("relevance") > 0.5, F.col("running") / F.col("rank")).otherwise(0.0)).alias("ap"),
        F.sum(gain("rank")).alias("dcg"), F.sum(gain("place")).alias("ideal"), F.min(F.when(F.col("relevance") == 1, F.col("rank"))).alias("first"),
    )
    if pool is None:
        once = judgments if unique else judgments.groupBy("query", "doc_id").agg(F.max("relevance").alias("relevance"))
        pool = once.groupBy("query").agg(F.sum("relevance").alias("pool"))
    div = lambda a, b: F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0))
    return sums.join(pool, "query", "left").select(*keys, "k", (F.col("s") / F.col("k")).alias("precision"), div("s", "pool").alias("recall"), div("ap", "s").alias("map"), div("dcg", "ideal").alias("ndcg"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def roll_up(metrics: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Mean of each metric by the groups."""
    return metrics.groupBy(*groups).agg(*(F.avg(m).alias(m) for m in METRICS))


def combined_metrics(per_k: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Weighted mixes of metrics at several cut-offs, to 4 places; null where a cut-off is missing."""
    at = lambda m, k: F.max(F.when(F.col("k") == k, F.col(m)))
    mix = {name: sum((w * at(m, k) for (m, k), w in list(parts.items())[1:]), next(iter(parts.values())) * at(*next(iter(parts)))) for name, parts in COMBINED.items()}
    return per_k.groupBy(*groups).agg(*(F.round(c, 4).alias(n) for n, c in mix.items()))


def rank_models(per_k: DataFrame, model: str = "model") -> DataFrame:
    """metric, k, model, value and its rank among models."""
    long = per_k.unpivot([model, "k"], list(METRICS), "metric", "value")
    return long.withColumn("rank", F.rank().over(Window.partitionBy("metric", "k").orderBy(F.desc("value"))))


def evaluate_grid(runs: dict[str, DataFrame], judgments: DataFrame, ks: Sequence[int], **known: bool | DataFrame) -> DataFrame:
    """Metrics of several retrieved lists (model -> query, doc_id, rank), each retrieved once at the largest k. ``known``: as in retrieval_metrics."""
    out = None
    for model, hits in runs.items():
        one = hits.select(F.lit(model).alias("model"), "query", "doc_id", "rank")
        out = one if out is None else out.unionByName(one)
    return retrieval_metrics(out, judgments, ks, ["model"], **known)


def judge_agreement(truth: DataFrame, judged: DataFrame) -> DataFrame:
    """One row: agreement, the mean over truth's queries of the mean of 1 - |difference| on shared documents (none: 0)."""
    both = truth.select("query", "doc_id", F.col("relevance").alias("a")).join(judged.select("query", "doc_id", F.col("relevance").alias("b")), ["query", "doc_id"])
    per = both.groupBy("query").agg(F.avg(1.0 - F.abs(F.col("a") - F.col("b"))).alias("score"))
    every = truth.select("query").distinct().join(per, "query", "left")
    return every.agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("agreement"))


def merge_judgments(df: DataFrame) -> DataFrame:
    """List-valued judgments of several rows joined per query, in the order of ``part``."""
    return df.groupBy("query").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "judgments"))), lambda x: x["judgments"])).alias("judgments"))


def batches(df: DataFrame, size: int, key: str = "query", order: str = "rank") -> DataFrame:
    """Documents of each key in lists of ``size``: key, batch, doc_ids."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    numbered = df.withColumns({"_place": place}).withColumn("batch", F.floor(F.col("_place") / size))
    return numbered.groupBy(key, "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))
