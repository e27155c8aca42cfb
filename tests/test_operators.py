"""Edge rows of the composite operators, and properties that hold on any rows."""

from __future__ import annotations

import datetime
import math

import pytest
from pyspark.sql import functions as F

from larder.operators import filters, ireval, logs, nutrition, search, substitute
from larder.schemas import NUTRIENTS
from larder.sources import io
from larder.streaming import jobs


def test_imputation(spark):
    quantity = spark.createDataFrame([(1, "a", 10.0), (1, "b", None), (1, "c", None), (2, "a", 10.0), (3, "a", None), (4, "a", 90.0), (4, "b", None), (5, "a", None)], "id long, ingredients string, qty_g double")
    recipes = spark.createDataFrame([(1, "50", "2"), (2, "5", "1"), (3, "20", "2"), (4, "10", "1"), (5, "abc", "2")], "id long, serving_size string, servings string")
    got = {(r.id, r.ingredients): r.filled_qty_g for r in nutrition.impute_quantities(quantity, recipes).collect()}
    assert got == {(1, "a"): 10.0, (1, "b"): 22.5, (1, "c"): 22.5, (2, "a"): 10.0, (3, "a"): 20.0, (4, "a"): 90.0, (4, "b"): 0.0, (5, "a"): None}


def test_merge_overwrites_with_null_and_keeps_unmatched(spark):
    target = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 0.0)], "id long, x double")
    source = spark.createDataFrame([(1, 5.0), (2, None)], "id long, x double")
    assert {r.id: r.x for r in io.merge_update(target, source, "id", ["x"]).collect()} == {1: 5.0, 2: None, 3: 0.0}


def test_recipe_health_rules(spark):
    rows = [(i, *(v for _ in NUTRIENTS)) for i, v in ((1, 0.0), (2, None))]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n}_100g double" for n in NUTRIENTS))
    score = lambda **k: {r.id: r.score_sante for r in nutrition.recipe_health(df, **k).collect()}
    assert score()[1] == 0.0 and math.isclose(score()[2], 40.0)
    assert score(null_energy="null")[2] is None


def test_filters(spark):
    df = spark.createDataFrame([(1, ["Red Beans", "salt"], ["vegan"], 10), (2, ["it's"], ["vegan", "low_fat"], 20), (3, None, None, 30)], "id int, ingredients array<string>, filters array<string>, minutes int")
    ids = lambda **k: [r.id for r in filters.apply_filters(df, filters.SearchFilters(**k)).orderBy("id").collect()]
    assert ids() == [1, 2, 3]
    assert ids(include_ingredients=["BEAN"]) == [1] and ids(include_ingredients=["it's"]) == [2]
    assert ids(exclude_ingredients=["bean"]) == [2]  # a null array is dropped
    assert ids(include_ingredients=["bean"], exclude_ingredients=["bean"]) == []
    assert ids(any_ingredients=["bean", "it"]) == [1, 2] and ids(dietary_filters=["vegan", "low_fat"]) == [2]
    assert ids(numeric_filters=[filters.NumericFilter("minutes", ">", 10)]) == [2, 3]
    for bad in ({"numeric_filters": [filters.NumericFilter("minutes", "!", 1)]}, {"numeric_filters": [filters.NumericFilter("x; drop", ">", 1)]}, {"dietary_filters": ["zzz"]}):
        with pytest.raises(ValueError):
            ids(**bad)
    with pytest.raises(ValueError):
        filters.time_range(F.lit(1), "5d", F.lit(1))


def brute_bm25(docs, query, k1=1.5, b=0.75):
    tf = {d: {t: ws.count(t) for t in ws} for d, ws in docs.items() if ws}
    n, avg = len(tf), sum(sum(x.values()) for x in tf.values()) / len(tf)
    df = {}
    for x in tf.values():
        for t in x:
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    idf = {t: r if r >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, r in raw.items()}
    score = {d: sum(idf[t] * x[t] * (k1 + 1) / (x[t] + k1 * (1 - b + b * sum(x.values()) / avg)) for t in query if t in x) for d, x in tf.items()}
    return sorted(((-round(s, 9), d) for d, s in score.items() if s > 0))


def test_bm25_equals_brute_force(spark):
    docs = {1: "red bean soup soup", 2: "green bean", 3: "bean stew red", 4: "", 5: "cake sugar sugar", 6: "bean bean bean"}
    df = spark.createDataFrame([*((i, t) for i, t in docs.items()), (7, None)], "doc_id long, body string")
    index = search.bm25_index(df, "doc_id", {"body": 1})
    queries = spark.createDataFrame([(1, "red bean"), (2, "sugar sugar"), (3, ""), (4, "zzz"), (5, "the of")], "query_id long, query string")
    hits = search.bm25_search(index, queries, 10).collect()
    words = {i: t.split() for i, t in docs.items()}
    for q, terms in ((1, ["red", "bean"]), (2, ["sugar", "sugar"])):
        want = brute_bm25(words, terms)
        got = sorted(((-r.score, r.doc_id) for r in hits if r.query_id == q))
        assert [d for _, d in got] == [d for _, d in want] and all(math.isclose(a, b, abs_tol=1e-8) for (a, _), (b, _) in zip(got, want, strict=True))
    assert {r.query_id for r in hits} == {1, 2}
    keep = spark.createDataFrame([(1,), (2,)], "doc_id long")
    filtered = {(r.query_id, r.doc_id) for r in search.bm25_search(index, queries, 10, keep).collect()}
    assert filtered == {(r.query_id, r.doc_id) for r in hits if r.doc_id in (1, 2)}


def test_index_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "red bean"), (2, "bean")], "doc_id long, body string")
    index = search.bm25_index(df, "doc_id", {"body": 2})
    search.write_index(index, str(tmp_path / "index"))
    assert search.read_index(spark, str(tmp_path / "index")).postings.count() == index.postings.count() == 3


def test_vector_search_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [2.0, 0.0]), (5, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(9, [1.0, 0.0]), (8, [0.0, 0.0])], "query_id long, vector array<float>")
    for f in (search.vector_search, search.vector_search_sql):
        assert [(r.query_id, r.doc_id, r["rank"]) for r in f(df, queries, 3).orderBy("rank").collect()] == [(9, 1, 1), (9, 4, 2), (9, 5, 3)]


def test_fusion(spark):
    ranks = lambda xs: spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(xs)], "query_id long, doc_id long, rank int")
    fused = lambda a, b, **k: [(r.doc_id, r.rrf_score) for r in search.rrf_fuse(ranks(a), ranks(b), 10, **k).orderBy("rank").collect()]
    assert fused([1, 2], [2, 3]) == [(2, round((0.7 / 62 + 0.3 / 61) * 1.15, 6)), (1, round(0.7 / 61, 6)), (3, round(0.3 / 62, 6))]
    assert fused([1, 2], [2, 3], vector_weight=7.0, text_weight=3.0) == fused([1, 2], [2, 3])
    assert fused([], []) == [] and [d for d, _ in fused([5, 6], [5, 6])] == [5, 6]
    with pytest.raises(ValueError):
        fused([1], [1], vector_weight=0.0, text_weight=0.0)


def test_metrics_against_lists(spark):
    truth = {"a": {1: 1.0, 2: 0.5, 9: 1.0}, "b": {7: 0.5}}
    lists = {"a": [2, 1, 5], "b": [4, 3]}
    retrieved = spark.createDataFrame([(q, d, i + 1) for q, ds in lists.items() for i, d in enumerate(ds)], "query string, doc_id long, rank int")
    judged = spark.createDataFrame([(q, d, r) for q, x in truth.items() for d, r in x.items()], "query string, doc_id long, relevance double")
    got = {(r.query, r.k): r for r in ireval.retrieval_metrics(retrieved, judged, [1, 3, 5]).collect()}
    a = got["a", 3]
    assert a.precision == pytest.approx(1.5 / 3) and a.recall == pytest.approx(1.5 / 2.5) and a.mrr == pytest.approx(0.5)
    assert a.map == pytest.approx((1.5 / 2) / 1.5)
    assert a.ndcg == pytest.approx((0.5 + 1 / math.log2(3)) / (1 + 0.5 / math.log2(3)))
    b = got["b", 5]
    assert (b.precision, b.recall, b.map, b.ndcg, b.mrr) == (0.0, 0.0, 0.0, 0.0, 0.0)


def test_substitution_edges(spark):
    rows = [("1", "Red bean", [0.0], [0.0], 0), ("2", "Red bean, dried", [0.1], [0.0], 0), ("3", "Lentil", [0.5], [0.0], 0), ("4", "Wheat flour", [0.2], [0.0], 1)]
    catalogue = spark.createDataFrame(rows, "ndb_no string, descrip string, macro array<double>, micro array<double>, is_gluten int")
    targets = spark.createDataFrame([("red bean",), ("absent",)], "target string")
    got = substitute.substitutes(targets, catalogue, substitute.constraint_struct(["no_gluten"])).collect()
    assert [(r.target, r.ndb_no) for r in got] == [("red bean", "3")]
    with pytest.raises(ValueError):
        substitute.constraint_struct(["zzz"])


def test_removal_limits(spark):
    schema = "id int, pos int, ingredient string, is_dairy boolean, qty_g double, sugar_g double, has_nutrition boolean"
    lines = spark.createDataFrame([(1, i, f"x{i}", i < 4 or None, 10.0 * (i > 0) or None, float(i), True) for i in range(6)], schema)
    names = lambda *c: [r.ingredient for r in substitute.ingredients_to_remove(lines, substitute.constraint_struct(c)).orderBy("place").collect()]
    assert names("no_lactose") == ["x0", "x1", "x2"]
    assert names("decrease_sugar") == ["x5"] and names() == []
    few = lines.where("pos > 2")
    assert [r.ingredient for r in substitute.ingredients_to_remove(few, substitute.constraint_struct(["no_lactose", "decrease_sugar"])).orderBy("place").collect()] == ["x3", "x5", "x4"]


def test_empty_logs(spark):
    s = spark.createDataFrame([], "conversation_id string, query string, search_timestamp timestamp, name string, minutes double, user_id string")
    t = spark.createDataFrame([], "success boolean, nutrition_before string, nutrition_after string")
    row = logs.kpi(s, t).first()
    assert row.result_rows == row.searches == row.transformations == 0 and row.conversion_rate == row.avg_minutes == 0.0


def test_log_search_drops_empty_results(spark):
    rows = [("c", "u", "q", 1, 2.0, "success", datetime.datetime(2024, 1, 1), ['{"id":1,"name":"x","minutes":5}']), ("c", "u", "r", 0, 2.0, "success", datetime.datetime(2024, 1, 1), [])]
    df = spark.createDataFrame(rows, "conversation_id string, user_id string, query string, total_found long, execution_time_ms double, status string, ts timestamp, results array<string>")
    assert [(r.query, r.recipe_id, r.minutes) for r in logs.log_search(df).collect()] == [("q", 1, 5.0)]
    assert logs.log_search(df, keep_empty=True).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(hours=7 * i), float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "search_timestamp timestamp, minutes double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    jobs.write_windows(jobs.windowed_kpi(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.window_start: (r.result_rows, r.avg_minutes) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.window_start: (r.result_rows, r.avg_minutes) for r in jobs.windowed_kpi(df).collect()}
    closed = max(r[0] for r in rows) - datetime.timedelta(hours=1)
    assert got == {k: v for k, v in want.items() if k + datetime.timedelta(days=1) <= closed}


def test_stream_log_and_embeddings_append_once(spark, tmp_path):
    schema = "conversation_id string, user_id string, query string, total_found long, execution_time_ms double, status string, ts timestamp, results array<string>"
    row = lambda q: ("c", "u", q, 1, 2.0, "success", datetime.datetime(2024, 1, 1), ['{"id":1}', '{"id":2}'])
    source = str(tmp_path / "in")
    spark.createDataFrame([row("a")], schema).write.parquet(source)
    run = lambda: jobs.stream_search_log(spark.readStream.schema(schema).parquet(source), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([row("b")], schema).write.mode("append").parquet(source)
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    make = lambda b: search.hashing_embeddings(b.select("query"), F.col("query"), 8)
    jobs.stream_embed(spark.readStream.schema(schema).parquet(source), str(tmp_path / "emb"), str(tmp_path / "cp2"), make).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "emb")).count() == 2


def test_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame([("0", 'a "quoted"\nline', "5,5")], "index string, name string, n string")
    io.write_csv_table(df, str(tmp_path / "csv"), sep=";")
    back = io.read_csv_table(spark, str(tmp_path / "csv"), sep=";", drop=["index"], nrows=5, line_breaks=True)
    assert back.first().asDict() == {"name": 'a "quoted"\nline', "n": "5,5"}
    (tmp_path / "truth.json").write_text('{"q": {"3": 0.5, "4": 1.0}}')
    assert sorted(map(tuple, io.read_json_map(spark, str(tmp_path / "truth.json")).collect())) == [("q", 3, 0.5), ("q", 4, 1.0)]
    (tmp_path / "list.json").write_text('["x", "y"]')
    assert [tuple(r) for r in io.read_query_list(spark, str(tmp_path / "list.json")).collect()] == [(0, "x"), (1, "y")]


def test_encoder_keeps_nulls(spark):
    import numpy as np

    df = spark.createDataFrame([("ab",), (None,), ("",)], "t string")
    got = [r.embedding for r in search.embed(df.coalesce(1), "t", lambda: lambda ts: np.array([[len(t), 1.0] for t in ts])).collect()]
    assert got == [[2.0, 1.0], None, [0.0, 1.0]]


def test_transform_response_and_log(spark):
    cols = "id int, name string, score_sante double, " + ", ".join(f"{n} double" for n in NUTRIENTS)
    before = spark.createDataFrame([(i, n, s, *(float(x) for x in range(13))) for i, n, s in ((1, "a", 1.0), (2, "b", 2.0))], cols)
    after = before.where("id = 1").withColumn("name", F.lit("a2"))
    rows = {r.id: r for r in substitute.transform_response(before, after, "done").collect()}
    assert rows[1].success and rows[1].transformed_name == "a2" and not rows[2].success and rows[2].nutrition_after is None
    response = '{"original_name":"a","recipe":{"name":"b"},"success":true,"message":"m","nutrition_before":{"calories":5},"nutrition_after":{"calories":4}}'
    log = logs.log_transformation(spark.createDataFrame([("c", "u", datetime.datetime(2024, 1, 1), response), ("c", "u", datetime.datetime(2024, 1, 1), "broken")], "conversation_id string, user_id string, ts timestamp, response string")).collect()
    assert (log[0].original_name, log[0].transformed_name, log[0].success) == ("a", "b", True) and log[1].success is None
    assert logs.conversation_stats(spark.createDataFrame([("c",)], "conversation_id string"), spark.createDataFrame(log[:1]), ("calories",)).first().delta_calories == -1.0
