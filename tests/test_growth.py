"""What a step holds or makes does not grow with the input: memory of a worker, rows that move, work of one task."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.operators import ireval, nearest, search, segments
from larder.operators import nutrition as recipes
from larder.plans import queries
from larder.plans.stand_ins import stand_in
from larder.schemas import NUTRIENTS


def test_nearest_compares_a_bounded_number_of_pairs_at_once(spark):
    rng = np.random.default_rng(1)
    rows = np.round(rng.normal(size=(2_500, 4)), 1)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "doc_id long, v array<double>").coalesce(1)
    asked = df.select(F.col("doc_id").alias("query_id"), "v", F.col("doc_id").alias("own"))

    def score(a, b):
        if a.shape[0] * b.shape[0] > 600_000:
            raise ValueError(f"{a.shape[0]} x {b.shape[0]} pairs at once")
        return np.round(a @ b.T, 9)

    got = {}
    for r in nearest.nearest(df, asked, 3, score).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.doc_id))
    whole = np.round(rows @ rows.T, 9)
    np.fill_diagonal(whole, -np.inf)
    for q in range(0, 2_500, 50):
        assert sorted(got[q]) == sorted((-whole[q, d], d) for d in np.lexsort((np.arange(2_500), -whole[q]))[:3])


@pytest.mark.parametrize("own", [False, True])
def test_best_keeps_the_first_k_over_many_offers(own):
    rng = np.random.default_rng(2)
    scores = rng.integers(0, 30, (7, 400)).astype(float)
    scores[rng.random(scores.shape) < 0.1] = np.nan
    best = nearest.Best(7, 5)
    best.most = 40  # sorts in after every few candidates
    names = np.arange(400)
    for s in range(0, 400, 50):
        best.offer(np.arange(7), scores[:, s : s + 50].copy(), names[s : s + 50], np.arange(7) if own else None)
    list(best.batch(pa.array(range(7)), pa.int64()))
    for q in range(7):
        valid = [d for d in range(400) if not np.isnan(scores[q, d]) and not (own and d == q)]
        assert best.doc[best.row == q].tolist() == sorted(valid, key=lambda d: (-scores[q, d], d))[:5]


def test_bm25_moves_no_pairs_and_takes_any_number_of_queries(spark, monkeypatch):
    words = [f"w{i:02d}" for i in range(30)]
    texts = [(i, " ".join(words[(i * j) % 30] for j in range(1, 3 + i % 9))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, body string")
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in texts[:20]], "query_id string, query string")
    index = search.bm25_index(docs, "doc_id", {"body": 1})
    found = search.bm25_search(index, queries, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and not re.search(r"hashpartitioning\(query_id#\d+, doc_id", plan)
    whole = sorted(map(tuple, found.collect()))
    for name, value in (("QUERY_ENTRIES", 7), ("BAG_ROWS", 5), ("HITS", 3), ("CELLS", 40)):
        monkeypatch.setattr(search, name, value)
    assert whole == sorted(map(tuple, search.bm25_search(search.bm25_index(docs, "doc_id", {"body": 1}), queries, 4).collect())) and len(whole) > 60


@pytest.mark.parametrize("kind", ["long", "string"])
def test_segments_are_read_once_and_in_bounded_parts(spark, tmp_path, monkeypatch, kind):
    words = [f"w{i:02d}" for i in range(30)]
    texts = [(f"{i:03d}" if kind == "string" else i, " ".join(words[(i * j) % 30] for j in range(1, 3 + i % 9))) for i in range(90)]
    docs = spark.createDataFrame(texts, f"doc_id {kind}, body string")
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in texts[:20]], "query_id string, query string")
    written, plain = [], segments.materialize
    monkeypatch.setattr(segments, "materialize", lambda df, name: written.append(name) or plain(df, name))
    for name, value in (("RANGE", 4), ("BAG_ROWS", 5), ("HITS", 3), ("CELLS", 160), ("QUERY_ENTRIES", 60)):
        monkeypatch.setattr(segments, name, value)
    index = segments.SegmentIndex.create(docs, "doc_id", {"body": 1}, str(tmp_path / "i"))
    index = index.delete(docs.where("cast(doc_id as int) % 7 = 0"))
    live = docs.where("cast(doc_id as int) % 7 <> 0")
    whole = sorted(map(tuple, search.bm25_search(search.bm25_index(live, "doc_id", {"body": 1}), queries, 4).collect()))
    for some in (index, index.compact()):
        written.clear()
        found = some.search(queries, 4, first=1)
        assert sorted(map(tuple, found.hits.collect())) == whole and len(whole) > 60 and found.read < found.blocks
        assert written.count("found") == len(written) - 1 == 2  # a pass per block of queries, and no rounds over the index


def test_compaction_counts_no_term_again(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a{i % 3} b{i % 5}") for i in range(30)], "doc_id long, body string")
    index = segments.SegmentIndex.create(docs, "doc_id", {"body": 1}, str(tmp_path / "i")).delete(docs.where("doc_id % 5 = 1"))
    packed = index.compact()
    assert packed.state["stats"] == index.state["stats"] and packed.state["tokens"] == index.state["tokens"] == 48
    assert {r.term: r.df for r in packed.term_stats().collect()} == {"a0": 8, "a1": 8, "a2": 8, "b0": 6, "b2": 6, "b3": 6, "b4": 6}


def test_metrics_need_no_row_per_judgment(spark):
    judged = spark.createDataFrame([("a", i, 1.0 if i % 2 else 0.5) for i in range(9)] + [("b", 3, 1.0)], "query string, doc_id long, relevance double")
    hits = spark.createDataFrame([("a", 1, 1), ("a", 40, 2), ("a", 4, 3), ("b", 5, 1)], "query string, doc_id long, rank int")
    plain = sorted(map(tuple, ireval.retrieval_metrics(hits, judged, [1, 3]).collect()))
    once = ireval.retrieval_metrics(hits, judged, [1, 3], unique=True)
    assert sorted(map(tuple, once.collect())) == plain
    maxima = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("max(relevance")
    assert maxima(once) == 1 and maxima(ireval.retrieval_metrics(hits, judged, [1, 3])) == 2  # of what was retrieved, not of all judgments
    pool = judged.groupBy("query").agg(F.sum("relevance").alias("pool"))
    known = ireval.retrieval_metrics(hits, judged.where("doc_id in (1, 4)"), [1, 3], pool=pool)
    assert sorted(map(tuple, known.collect())) == plain


def test_judgments_of_one_label_are_dealt_out(spark, tmp_path):
    rows = spark.createDataFrame([(i, [1.0], 3 if i else 2) for i in range(400)], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries._judgments(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, stand_in(spark, str(tmp_path), "judgments").collect()))
    assert len({r.p for r in found.select(F.spark_partition_id().alias("p")).distinct().collect()}) > 1


def test_shared_lines_move_once_and_matches_without_nutrients(spark):
    nutrients = spark.createDataFrame([("1", *[float(i) for i in range(13)]), ("2", *[2.0] * 13)], "ndb_no string, " + ", ".join(f"{n} double" for n in NUTRIENTS))
    known = recipes.ingredient_health(nutrients)
    quantity = spark.createDataFrame([(1, "a", 10.0), (1, "b", None), (2, "a", 5.0)], "id int, ingredients string, qty_g double")
    weights = spark.createDataFrame([(1, "100", "1"), (2, "abc", "1")], "id int, serving_size string, servings string")
    matching = spark.createDataFrame([(1, "a", "1"), (1, "b", "2"), (2, "a", "1")], "recipe_id int, ingredient string, ndb_no string")
    edited = spark.createDataFrame([("all", 1, ["a", "b"]), ("one", 1, ["b", "b"]), ("all", 2, ["a", "x"])], "variant string, id int, ingredients array<string>")
    got = recipes.what_if_nutrition(edited, quantity, weights, matching, known)
    extra = edited.withColumns({"replaced_qty": F.create_map().cast("map<string,double>"), "replaced_ndb": F.create_map().cast("map<string,string>")})
    rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*got.columns).collect())
    assert rounded(got) == rounded(recipes.what_if_nutrition(extra, quantity, weights, matching, known))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [sum" not in plan and "collect_list" in plan
    whole = recipes.recipe_nutrition_100g(quantity, weights, matching, known)._jdf.queryExecution().optimizedPlan().toString()
    below = whole[whole.index("row_number") :]
    assert "energy_kcal" not in below.split("\n")[0] and below.count("Window") >= 1


def test_a_candidate_is_weighed_from_sums(spark):
    facts = spark.createDataFrame([(str(i), *[float(3 * i + j) if (i + j) % 5 else None for j in range(13)]) for i in range(4)], "ndb_no string, " + ", ".join(f"{n} double" for n in NUTRIENTS))
    rows = [(1, "0", 10.0, 90.0), (1, "1", None, 90.0), (2, "1", 5.0, None), (2, "9", None, None)]
    lines = spark.createDataFrame(rows, "id int, ndb_no string, qty_g double, total_weight double")
    values = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("id", *NUTRIENTS, "score_sante").collect())
    cand = recipes.per_gram(facts.where("ndb_no = '3'"), "candidate")
    swapped = lines.withColumns({"ndb_no": F.when(F.col("ndb_no") == "1", "3").otherwise(F.col("ndb_no")), "variant": F.lit("")})
    sums = recipes.line_sums(lines, facts, "id", own=F.coalesce(F.col("ndb_no") == "1", F.lit(False)))
    assert values(recipes.per_100g(sums.crossJoin(cand), "id", of=True)) == values(recipes.nutrition_of_lines(swapped, facts))
    more = spark.createDataFrame([(1, "3", None, 90.0), (2, "3", None, None)], lines.schema)
    sums = recipes.line_sums(lines, facts, "id", open_lines=1)
    assert values(recipes.per_100g(sums.crossJoin(cand), "id", of=True)) == values(recipes.nutrition_of_lines(lines.unionByName(more).withColumn("variant", F.lit("")), facts))
