"""Operators without an SQL twin against brute force: hashed vectors, clusters, nearest rows; tables of the catalog."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import cluster, nearest, search, substitute
from larder.sources import io


def murmur3(data: bytes, seed: int = 42) -> int:
    """The 32-bit hash that term hashing uses, as a signed number."""
    mask, rot = 0xFFFFFFFF, lambda x, n: (x << n | x >> (32 - n)) & 0xFFFFFFFF
    h = seed
    for i in range(0, len(data) - len(data) % 4, 4):
        k = rot(int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
        h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & mask
    if rest := data[len(data) - len(data) % 4 :]:
        h ^= rot(int.from_bytes(rest, "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & mask
    return h - (1 << 32) if h >> 31 else h


def brute_embeddings(bags, dim):
    counts = np.zeros((len(bags), dim))
    for row, bag in zip(counts, bags, strict=True):
        for w in bag:
            row[murmur3(w.encode()) % dim] += 1
    idf = np.log((len(bags) + 1) / ((counts > 0).sum(axis=0) + 1))
    v = counts * idf
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def test_hashed_embeddings(spark):
    texts = ["red bean soup", "Crème brûlée", "red red beans", None, "", "the of", "日本 soup"]
    bags = [["red", "bean", "soup"], ["crème", "brûlée"], ["red", "red", "beans"], [], [], [], ["日本", "soup"]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.embedding for r in search.build_embeddings_table(df, ["text"], "id", 16).collect()}
    want = brute_embeddings(bags, 16)
    assert all(np.allclose(got[i], want[i], atol=1e-6) for i in got) and len(got) == len(texts)


def test_chunk_embeddings(spark):
    body = " ".join(f"word{i} bean" for i in range(60))
    df = spark.createDataFrame([(1, body, "meta"), (2, "", "meta"), (3, None, None), (4, "short", None)], "id int, text string, m string")
    rows = search.chunk_and_embed(df, "id", "text", ["m"], 100, 20, 32).orderBy("id", "chunk_index").collect()
    assert {r.id for r in rows} == {1, 4} and [r.chunk_index for r in rows if r.id == 1] == list(range(sum(r.id == 1 for r in rows)))
    assert all(r.chunk.startswith("meta ") for r in rows if r.id == 1)
    want = brute_embeddings([[w for w in r.chunk.lower().split() if len(w) > 1] for r in rows], 32)
    assert np.allclose([r.embedding for r in rows], want, atol=1e-6)


def blobs(spark, centers, each=40, seed=0):
    r = np.random.default_rng(seed)
    rows = [(i, *map(float, c + r.normal(size=len(c)) * 0.05)) for i, c in enumerate(np.repeat(np.array(centers, dtype=float), each, axis=0))]
    cols = [f"c{j}" for j in range(len(centers[0]))]
    return spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in cols)), cols


@pytest.mark.parametrize(("kind", "axes"), [("macro", 3), ("micro", 2), ("total", 2)])
def test_clusters_against_brute_force(spark, kind, axes):
    """Planted groups come back; axes are those of numpy's projection up to their sign; each centre is the mean of its members and no other is nearer."""
    centers = [[0, 0, 9, 1], [5, 1, 0, 0], [1, 8, 2, 7], [9, 9, 9, 9]][: 4 if kind == "micro" else 3]
    df, cols = blobs(spark, centers)
    make = {"macro": lambda: cluster.macro_clusters(df, cols, axes, 3), "micro": lambda: cluster.micro_clusters(df, cols, axes, 4), "total": lambda: cluster.total_clusters(df, cols, axes, 3)}[kind]
    rows = sorted(make().collect(), key=lambda r: r.id)
    x = np.array([[r[c] for c in cols] for r in rows])
    z = (x - x.mean(axis=0) * (kind != "total")) / x.std(axis=0, ddof=1)
    got = np.array([[r[f"pca_{kind}_{i + 1}"] for i in range(axes)] for r in rows])
    _, _, vt = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(z @ vt[:axes].T), atol=1e-6)
    labels = np.array([r[f"cluster_{kind}"] for r in rows])
    planted = np.repeat(np.arange(len(centers)), 40)
    assert len({(a, b) for a, b in zip(labels, planted, strict=True)}) == len(centers)  # equal up to names
    means = np.array([got[labels == k].mean(axis=0) for k in range(len(centers))])
    distance = np.linalg.norm(got[:, None] - means[None], axis=2)
    assert (distance.argmin(axis=1) == labels).all()
    assert np.allclose([r[f"dist_{kind}_centroid"] for r in rows], distance.min(axis=1), atol=1e-6)
    profile = {r[f"cluster_{kind}"]: r for r in cluster.cluster_profile(make(), f"cluster_{kind}", cols).collect()}
    assert all(np.isclose(profile[k][c], x[labels == k][:, j].mean()) for k in profile for j, c in enumerate(cols)) and sum(r.n for r in profile.values()) == len(rows)


def test_recipe_clusters_take_the_best_silhouette(spark):
    df, cols = blobs(spark, [[0, 0, 9, 1], [5, 1, 0, 0], [1, 8, 2, 7], [9, 9, 9, 9]])
    rows, table = cluster.recipe_clusters(df.select("id", F.array(*cols).alias("embedding")), axes=3, ks=(2, 3, 4, 5))
    got = sorted(rows.collect(), key=lambda r: r.id)
    x, labels = np.array([r.embedding for r in got]), np.array([r.cluster_km for r in got])
    scores = {r.k: r.silhouette for r in table.collect()}
    assert max(scores, key=scores.get) == 4 and len(set(zip(labels, np.repeat(range(4), 40), strict=True))) == 4
    z = x @ np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:3].T
    square = ((z[:, None] - z[None]) ** 2).sum(axis=2)
    own = np.array([square[i, labels == labels[i]].sum() / ((labels == labels[i]).sum() - 1) for i in range(len(z))])
    other = np.array([min(square[i, labels == k].mean() for k in set(labels) - {labels[i]}) for i in range(len(z))])
    assert math.isclose(scores[4], ((other - own) / np.maximum(own, other)).mean(), rel_tol=0.02)
    assert np.allclose(np.abs([[r.x, r.y] for r in got]), np.abs(z[:, :2]), atol=1e-6)


@pytest.mark.parametrize("ids", ["number", "text"])
@pytest.mark.parametrize("block", [64_000_000, 400])
def test_nearest_rows(spark, monkeypatch, ids, block):
    """The k best with ties by id, in blocks of queries or one, for ids of either kind, over several tasks and small batches."""
    monkeypatch.setattr(nearest, "BLOCK_BYTES", block)
    monkeypatch.setattr(nearest, "CELLS", 40)
    r = random.Random(1)
    name = (lambda i: i) if ids == "number" else (lambda i: f"d{i:03}")
    kind = "long" if ids == "number" else "string"
    rows = [(name(i), [r.choice([0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(90)] + [(name(90), None), (name(91), [0.0, 0.0, 0.0]), (name(92), [1.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, f"doc_id {kind}, embedding array<float>").repartition(5)
    asked = [(name(i), rows[i][1]) for i in range(0, 90, 7)]
    queries = spark.createDataFrame(asked, f"query_id {kind}, vector array<float>")
    for own in (False, True):
        got = {}
        for x in search.vector_search(df, queries, 4, exclude_self=own).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append((x.doc_id, x.score))
        for q, v in asked:
            cos = lambda w: round(float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), 9)  # noqa: E731, B023
            want = sorted(((-cos(w), d) for d, w in rows if d is not None and w and len(w) == 3 and any(w) and any(v) and not (own and d == q)))[:4]
            assert [d for d, _ in got.get(q, [])] == [d for _, d in want]
    assert search.vector_search(df, queries.limit(0), 4).count() == 0 and search.vector_search(df.limit(0), queries, 4).count() == 0


def test_names_meet_descriptions_without_each_with_each(spark):
    r = random.Random(2)
    words = ["red", "redder", "bean", "beans", "a", "ab", "oil", "soy", "no"]
    descriptions = [" ".join(r.choice(words) for _ in range(r.randint(1, 3))).title() for _ in range(40)] + [None, ""]
    candidates = spark.createDataFrame([(f"{i:02}", d) for i, d in enumerate(descriptions)], "ndb_no string, descrip string")
    names = [" ".join(p) for p in itertools.product(words, repeat=2)] + ["x", "zz a", "  Red ", "", "soy\tOil"]
    got = {x.name: (x.descrip, x.ndb_no) for x in substitute.match_ingredients(spark.createDataFrame([(n,) for n in names], "name string"), candidates).collect()}
    for name in names:
        key, side = name.strip().lower() if name.strip(" ") else "", [(d, f"{i:02}") for i, d in enumerate(descriptions) if d is not None]
        key = name.strip(" ").lower()
        exact = sorted(x for x in side if x[0].lower() == key)
        partial = sorted(x for x in side if any(p in x[0].lower() for p in key.split()))
        assert got[name] == ((exact or partial or [(None, None)])[0]), name
    plan = substitute.match_ingredients(spark.createDataFrame([("a",)], "name string"), candidates)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Cartesian" not in plan


def test_search_moves_no_postings_beyond_the_terms(spark, tmp_path):
    """With a filter the terms come first: the semi-join's left side is what the query's terms found."""
    docs = spark.createDataFrame([(i, f"word{i % 7} bean{i % 3}") for i in range(50)], "doc_id long, body string")
    index = search.bm25_index(docs, "doc_id", {"body": 1}, path=str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "word1 bean2")], "query_id long, query string")
    plan = search.bm25_search(index, queries, 5, docs.where("doc_id > 3"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("postings" if "postings" in plan else "Relation [term") and "doc_stats" not in plan
    lengths = {(r.term, r.doc_id): r.dl for r in index.postings.collect()}
    assert set(lengths.values()) == {2} and len(lengths) == 100


def test_tables_of_the_catalog(spark):
    name = "larder_test_nations"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df = spark.range(5).withColumn("x", F.lit("a"))
    assert not io.table_exists(spark, name)
    try:
        io.write_table(df, name)  # CREATE TABLE AS SELECT
        io.write_table(df.where("id > 2"), name)  # INSERT ... SELECT
        assert io.table_exists(spark, name) and io.read_table(spark, name).count() == 7
        io.write_table(df, name, "ignore")
        assert io.read_table(spark, name).count() == 7
        io.write_table(df.limit(1), name, "overwrite")  # CREATE OR REPLACE
        assert [tuple(r) for r in io.read_table(spark, name).collect()] == [(0, "a")]
        with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
            io.write_table(df, name, "error")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
