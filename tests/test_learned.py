"""Needles in texts, latent vectors, axes by the knee, typed functions, encoders per worker, agents' scores."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.functions import udfs
from larder.operators import cluster, logs, search
from larder.operators.latent import LatentEncoder, weigh
from larder.operators.matching import least_holding


@pytest.mark.parametrize("block_letters", [1_000_000, 40])
def test_least_holding_equals_brute_force(spark, block_letters):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcé🙂") for _ in range(n))
    texts = [(word(r.randint(0, 12)) + "shared", (r.choice(["x", "é", "z", None]), str(i % 40))) for i in range(300)] + [(None, ("a", "0")), ("", ("a", "1"))]
    needles = sorted({word(r.randint(1, 4)) for _ in range(60)} | {"a", "s", "shared", "share", "absent", "🙂"})
    side = spark.createDataFrame([(t, v) for t, v in texts], "low string, value struct<descrip:string,ndb_no:string>").repartition(4)
    wanted = spark.createDataFrame([(n,) for n in needles] + [("",), (None,), ("a",)], "needle string")
    order = lambda v: tuple((x is not None, (x or "").encode()) for x in v)
    want = {n: min((v for t, v in texts if t is not None and n in t), key=order) for n in needles if any(t and n in t for t, _ in texts)}
    assert {x.needle: tuple(x.best) for x in least_holding(wanted, side, block_letters).collect()} == want
    assert least_holding(wanted.limit(0), side).count() == 0 and least_holding(wanted, side.limit(0)).count() == 0


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(1)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(6)]
    rows = [(i, " ".join(r.choices(topics[i % 6], k=r.randint(3, 40)) + r.choices([f"c{j}" for j in range(20)], k=5))) for i in range(240)]
    return spark.createDataFrame([*rows, (900, None), (901, ""), (902, rows[0][1])], "id long, text string").repartition(4)


def test_latent_vectors_span_the_exact_singular_directions(spark, texts):
    from larder.operators.latent import term_ids
    import pyarrow as pa

    made = LatentEncoder.fit(texts, F.col("text"), 6, 512)
    rows = texts.select("id", term_ids(F.col("text"), 512).alias("ids")).orderBy("id").collect()
    row, feature, weight = weigh(pa.array([x.ids for x in rows], pa.list_(pa.int32())), made.idf)
    a = np.zeros((len(rows), 512))
    a[row, feature] = weight
    df_of = (a > 0).sum(axis=0)
    assert made.idf == pytest.approx(np.log((1 + len(rows)) / (1 + df_of)) + 1)
    assert np.linalg.norm(a, axis=1)[:240] == pytest.approx(np.ones(240))
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert made.singular == pytest.approx(s[:6], rel=0.02)
    inside = np.linalg.norm(vt[:6] @ made.projection @ made.projection.T, axis=1)
    assert all(inside > 0.97)  # each exact direction lies in the found ones
    got = {x.id: x.embedding for x in made.encode(texts, F.col("text")).collect()}
    low = a @ made.projection
    assert np.array(got[5]) == pytest.approx(low[5] / np.linalg.norm(low[5]), abs=1e-5)
    assert got[900] is None and set(got[901]) == {0.0} and got[902] == got[0]


def test_latent_vectors_find_texts_of_one_topic(spark, texts):
    made = LatentEncoder.fit(texts, F.col("text"), 6, 512)
    kept = made.encode(texts.where("id < 240"), F.col("text")).select(F.col("id").alias("doc_id"), "embedding")
    asked = kept.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = search.vector_search(kept, asked, 10, exclude_self=True).collect()
    assert sum(h.query_id % 6 == h.doc_id % 6 for h in hits) > 0.9 * len(hits)


def test_latent_encoder_of_nothing(spark, texts):
    made = LatentEncoder.fit(texts.limit(0), F.col("text"), 6, 512)
    assert set(made.encode(texts, F.col("text")).where("id = 3").first().embedding) == {0.0}


def test_knee():
    assert cluster.knee([]) == 0 and cluster.knee([1.0]) == 1
    assert cluster.knee([0.4, 0.3, 0.2, 0.02, 0.02, 0.02, 0.02, 0.02]) == 3
    assert cluster.knee([0.25] * 4) == 1


def test_axes_by_the_knee(spark):
    r = np.random.default_rng(0)
    low = r.normal(size=(300, 3)) * [9, 7, 5]
    x = low @ np.linalg.qr(r.normal(size=(12, 12)))[0][:3] + 0.05 * r.normal(size=(300, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, embedding array<double>")
    rows, table = cluster.recipe_clusters(df, ks=(2, 3))
    assert {t.axes for t in table.collect()} == {3} and rows.count() == 300 and table.count() == 2


def test_functions_get_what_their_hints_say(spark):
    def kind(a: float, b: str, c: list[float] | None, d: int | None) -> str:
        return ",".join(type(x).__name__ for x in (a, b, *(c or [None]), d))

    udfs.register(spark, "larder_kind", kind)
    got = spark.sql("SELECT larder_kind(1, 2, array(3, 4), 5L) AS a, larder_kind(1.5D, 'x', NULL, NULL) AS b").first()
    assert tuple(got) == ("float,str,float,float,int", "float,str,NoneType,NoneType")


def test_an_encoder_is_made_once_per_worker(spark, tmp_path):
    made = str(tmp_path / "made")

    def make():
        import os
        import uuid

        os.makedirs(made, exist_ok=True)
        open(f"{made}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: np.array([[len(t), len(texts)] for t in texts], dtype=float)

    df = spark.range(60).select("id", F.when(F.col("id") % 10 > 0, F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("t")).repartition(24)
    for _ in range(2):
        got = {r.id: r.embedding for r in search.embed(df, "t", make, batch=2, name=made).collect()}
    assert all(got[i] is None if i % 10 == 0 else got[i][0] == i and got[i][1] <= 2 for i in range(60))
    import os

    names = [n.split("-")[0] for n in os.listdir(made)]
    assert len(names) == len(set(names))


def test_scores_in_the_agent_report(spark):
    events = spark.createDataFrame([("r", 1, "tool_use", "search", None, 10.0), ("r", 2, "tool_result", None, "out", 12.5), ("s", 3, "text", None, None, 1.0)], "run_id string, seq long, type string, tool_name string, content string, ts double").withColumn("ts", F.timestamp_seconds("ts"))
    scores = spark.createDataFrame([("r", "p1", "style", 1.0), ("r", "p2", "style", 0.0), ("r", "p2", "fit", None), ("r", "p3", None, 1.0), ("x", "p", "style", 1.0)], "run_id string, prompt string, metric string, score double")
    got = {r.run_id: r for r in logs.agent_run_report(events, scores).collect()}
    assert got["r"].scores == {"style": 0.5} and got["r"].n_prompts == 3 and got["r"].outputs == ["out"] and got["r"].elapsed_s == 2.5
    assert got["s"].scores == {} and got["s"].n_prompts == 0
