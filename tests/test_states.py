"""Streams with state, sketches and the index of vectors."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import logs, search, sketches
from larder.operators.vector_index import VectorIndex, centroids
from larder.streaming import jobs

DAY = datetime(2024, 3, 1)


def log_rows(spark, rows):
    """rows: (hours after the first day, tags)."""
    return spark.createDataFrame([(DAY + timedelta(hours=h), t) for h, t in rows], "search_timestamp timestamp, tags array<string>")


@pytest.fixture
def rocks(spark):
    spark.conf.set(*jobs.STATE_STORE)
    yield
    spark.conf.unset(jobs.STATE_STORE[0])


def run(spark, folder):
    source = spark.readStream.schema("search_timestamp timestamp, tags array<string>").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    jobs.write_windows(jobs.top_tags_stream(source, F.col("tags"), 2, shards=3), f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    rows = jobs.top_of_shards(spark.read.parquet(f"{folder}/rows"), 2).collect()
    return sorted((r.window_start, r["rank"], r.tag, r.n) for r in rows)


def test_top_tags_go_on_from_their_checkpoint(spark, tmp_path, rocks):
    folder = str(tmp_path)
    first = [(1, ["a", "b", None]), (2, ["b", "c"]), (3, ["c", "a"]), (4, None), (5, ["d"])]
    log_rows(spark, first).coalesce(1).write.parquet(f"{folder}/in")
    assert run(spark, folder) == []  # the day is open
    log_rows(spark, [(6, ["b", "b"]), (26, ["z"])]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    got = run(spark, folder)  # counts from before the stop are there; ties go by tag
    assert got == [(DAY, 1, "b", 4), (DAY, 2, "a", 2)]
    log_rows(spark, [(7, ["late"] * 9), (60, ["y"])]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    assert run(spark, folder) == [*got, (DAY + timedelta(days=1), 1, "z", 1)]  # what comes after its day has closed is dropped


def test_repeats_within_the_time_are_dropped(spark, tmp_path):
    schema = "conversation_id string, user_id string, query string, total_found long, execution_time_ms double, status string, ts timestamp, results array<string>"
    row = lambda c, h: (c, "u", "q", 1, 1.0, "success", DAY + timedelta(hours=h), ['{"id": 1, "name": "n"}'])
    for part in ([row("a", 0), row("b", 1)], [row("a", 0), row("a", 2)], [row("b", 1), row("c", 3)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.stream_search_log(source, str(tmp_path / "rows"), str(tmp_path / "cp"), ["conversation_id", "query", "ts"]).awaitTermination()
    assert sorted(r.conversation_id for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == ["a", "a", "b", "c"]


@pytest.fixture(scope="module")
def states(spark):
    r = np.random.default_rng(5)
    rows = [
        (f"c{i % 50}", f"u{i % 3}" if i % 11 else None, f"q{i}", DAY + timedelta(days=int(i % 40)), f"name {r.integers(20_000)}" if i % 7 else None, float(r.integers(100)) if i % 5 else None, [f"t{min(r.geometric(0.1), 60)}" for _ in range(i % 4)])
        for i in range(12_000)
    ]
    schema = "conversation_id string, user_id string, query string, search_timestamp timestamp, name string, minutes double, tags array<string>"
    log = spark.createDataFrame(rows, schema).persist()
    return log, sketches.daily_states(log, F.col("tags")).persist()


@pytest.mark.parametrize(("days", "user"), [(7, None), (30, "u1"), (90, None)])
def test_merged_states_against_the_log(spark, states, days, user):
    log, kept = states
    last = (DAY + timedelta(days=39)).date()
    own = log.where(F.to_date("search_timestamp") > F.date_sub(F.lit(last), days))
    own = own.where(F.col("user_id") == user) if user else own
    exact = own.agg(F.count(F.lit(1)), F.avg("minutes"), F.count_distinct("name"), F.count_distinct("conversation_id", "query", "search_timestamp"), F.lit(0)).first()
    got = sketches.merge_states(kept, F.lit(last), days, user).first()
    error = 3 * 1.04 / 2 ** (sketches.LG_K / 2)
    assert got.result_rows == exact[0] and got.avg_minutes == pytest.approx(exact[1])
    assert abs(got.distinct_recipes / exact[2] - 1) < error and abs(got.searches / exact[3] - 1) < error
    assert got.tag_diversity == own.select(F.explode("tags")).distinct().count()
    if not user:
        want = [tuple(r) for r in logs.top_k_exploded(own, F.col("tags"), 5).collect()]
        assert [tuple(r) for r in sketches.merged_tags(kept, F.lit(last), days).collect()] == want


def test_no_states(spark, states):
    log, _ = states
    none = sketches.daily_states(log.where("false"), F.col("tags"))
    assert tuple(sketches.merge_states(none, F.lit(DAY.date()), 7).first()) == (0, 0.0, 0, 0, 0)
    assert sketches.merged_tags(none, F.lit(DAY.date()), 7).count() == 0


def test_quantiles_within_their_rank_error(spark):
    df = spark.range(200_000).select((F.xxhash64("id") % 1_000_003).alias("v"), (F.col("id") % 2).alias("g"))
    at = (0.01, 0.25, 0.5, 0.75, 0.99)
    exact = {r.g: r.quantiles for r in sketches.quantiles(df, "v", at, by=["g"]).collect()}
    near = {r.g: r.quantiles for r in sketches.quantiles(df, "v", at, exact=False, by=["g"]).collect()}
    values = {g: np.sort([r.v for r in df.where(F.col("g") == g).collect()]) for g in (0, 1)}
    for g in (0, 1):
        assert exact[g] == pytest.approx(np.quantile(values[g], at))
        ranks = [np.searchsorted(values[g], v) / len(values[g]) for v in near[g]]
        assert all(abs(a - b) < 3 * sketches.KLL_RANK_ERROR for a, b in zip(ranks, at, strict=True))


# ---- vectors by cells -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(3)
    centre = r.normal(size=(12, 16))
    rows = [(i, (centre[i % 12] + 0.3 * r.normal(size=16)).tolist()) for i in range(1_500)]
    rows += [(5000 + i, rows[3][1]) for i in range(40)] + [(6000, [0.0] * 16), (6001, None), (None, rows[1][1])]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(3).persist()
    asked = vectors.where("doc_id % 50 = 0 or doc_id = 6000").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors, asked


def found(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_exact_search_of_cells_equals_the_exact_search_of_rows(spark, clustered, tmp_path):
    vectors, asked = clustered
    index = VectorIndex.build(vectors, str(tmp_path / "i"), 20)
    for k, self_too, block in ((10, False, 64_000_000), (60, True, 4_000), (3, True, 64_000_000)):
        want = found(search.vector_search(vectors.where("doc_id is not null"), asked, k, exclude_self=self_too))
        assert found(index.search(asked, k, exclude_self=self_too, block_bytes=block)) == want
    assert found(VectorIndex.open(spark, index.path).search(asked, 5, probes=len(index.cells))) == found(search.vector_search(vectors.where("doc_id is not null"), asked, 5))


def test_few_cells_reach_the_recall_and_read_few_files(spark, clustered, tmp_path):
    vectors, asked = clustered
    index = VectorIndex.build(vectors, str(tmp_path / "i"), 20)
    probes, recall = index.probes_for(vectors.where("doc_id is not null"), asked, 10)
    assert recall >= 0.9 and probes <= 4
    one = index._probed(np.array([asked.where("query_id = 0").first().vector]), 10, probes, None)
    read, every = index.files(one)
    assert read <= every * probes / 10


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, embedding array<double>")
    index = VectorIndex.build(none, str(tmp_path / "e"))
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<double>")
    assert index.search(asked, 3, probes=2).count() == 0 and index.search(asked, 3).count() == 0


def test_centroids_keep_their_number():
    at = centroids(np.tile([[1.0, 0.0]], (9, 1)), 4)
    assert at.shape == (4, 2) and np.allclose(np.linalg.norm(at, axis=1), 1)
