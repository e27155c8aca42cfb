"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line, median of three runs after one warm-up.

``bm25_index`` builds and stores the index; ``bm25_search`` and ``hybrid_search`` ask one that was stored before.
The ``_topk`` queries build their own, as in round 1.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import search
from larder.plans import queries as plans
from larder.sources.workdir import shared_dir

HEADLINE = ("recipe_nutrition_100g", "bm25_topk", "vector_topk", "hybrid_topk", "kpi_all", "retrieval_metrics")


def searches(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    """Index and search apart, over an index that is stored once."""
    docs = plans.base(spark, sf_dir, "documents")
    build = lambda: search.bm25_index(docs, "doc_id", plans.WEIGHTS, path=shared_dir(spark, "bm25"))
    stored = build()
    asked = plans._bench_queries(spark, sf_dir).limit(32)
    both = plans._vector_queries(spark, sf_dir).join(docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")), "query_id").limit(32)
    return {
        "bm25_index": lambda: build().term_stats,
        "bm25_search": lambda: search.bm25_search(stored, asked, 10),
        "hybrid_search": lambda: search.hybrid_search(stored, plans._vectors(spark, sf_dir), both, 10),
    }


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    timed = {name: (lambda f=plans.QUERIES[name]: f(spark, sf_dir)) for name in HEADLINE} | searches(spark, sf_dir)
    took: dict[str, float] = {}
    for name, query in timed.items():
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir), "cpus": int(cpus), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
