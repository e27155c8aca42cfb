from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import negatives
from larder.llm.queries import op13_hard_negatives

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, anchors):
    """Windows of every anchor by scores of all pairs. rows: (vec_id, label, whole numbers)."""
    rows = [r for r in rows if None not in r and None not in r[2]]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, label, v in rows:
        if not anchors(i):
            continue
        others = [(-score(v, w), j, m) for j, m, w in rows if j != i]
        for p, j, _ in sorted(o for o in others if o[2] == label)[:5]:
            window = sorted((s, k) for s, k, m in others if m != label and 80 * -p <= 100 * -s <= 100 * -p)[:5]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(window, 1)]
    return sorted(out)


def table(spark, rows):
    names = ["slot", "score", "rank", "own", "is_anchor"]
    schema = "vec_id long, label int, v array<bigint>" + "".join(f", {c} int" for c in names)
    return spark.createDataFrame([(*r, *range(len(names))) for r in rows], schema)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def vectors(seed, n, dim, labels, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(labels, dim)) * spread
    y = r.integers(0, labels, n)
    return [(int(i), int(c), (np.floor((centres[c] * 0.5 + r.normal(size=dim)) * 40 * np.linspace(2, 0.2, dim))).astype(int).tolist()) for i, c in enumerate(y)]


@pytest.fixture(scope="module")
def hard_rows():
    rows = vectors(1, 900, 20, 4)
    r = random.Random(2)
    one = rows[10][2]
    rows += [(2000 + k, r.randrange(4), one) for k in range(300)]  # a third are one vector: ties by id
    rows += [(3000, 7, one), (3010, 8, [0] * 20), (3020, 9, one), (3021, 9, [-x for x in one])]  # no positive, zero vector, positive below zero
    rows += [(3030, 1, one[:5]), (3031, 1, []), (3032, 2, one + one)]  # unequal lengths
    rows += [(3040, None, one), (3050, 1, None), (3060, 1, [None, 1, 2]), (None, 1, one)]
    rows += [rows[30], rows[31], (30, 3, [5] * 20)]  # repeated rows and ids
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_bytes", [negatives.BLOCK_BYTES, 30_000])
def test_windows_equal_brute_force(spark, hard_rows, block_bytes, monkeypatch):
    monkeypatch.setattr(negatives, "SAMPLE_ROWS", 60 if block_bytes == 30_000 else 4096)  # few rows to guess from: thresholds are lowered
    df = table(spark, hard_rows).repartition(5)
    assert found(negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, block_bytes=block_bytes)) == brute(hard_rows, lambda i: i % 10 == 0)


@pytest.mark.parametrize("scale", [1, 2_000_000])
def test_exact_beyond_doubles(spark, scale):
    rows = [(i, y, [x * scale + i % 3 for x in v]) for i, y, v in vectors(5, 200, 9, 3)]
    assert found(negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 20 == 0)) == brute(rows, lambda i: i % 20 == 0)


def test_scores_beyond_64_bits_raise(spark):
    with pytest.raises(ValueError, match="64 bits"):
        negatives.hard_negatives(table(spark, [(0, 1, [2**40]), (1, 1, [2**40])]), F.col("vec_id") == 0)


def test_empty(spark):
    assert negatives.hard_negatives(table(spark, []), F.col("vec_id") == 0).count() == 0
    assert negatives.hard_negatives(table(spark, [(0, 1, [1, 2]), (1, 2, [1, 2])]), F.col("vec_id") == 0).count() == 0
    assert negatives.hard_negatives(table(spark, [(0, 1, []), (1, 1, []), (2, 2, [])]), F.col("vec_id") == 0).count() == 1


@pytest.mark.parametrize("threshold", [-50_000.0, 0.0, 3_000.0, 20_000.0, 90_000.0])
def test_pruning_loses_no_pair(threshold):
    rows = vectors(8, 400, 30, 3)
    x = np.array([v for _, _, v in rows], dtype=float)
    x[::50] = 0
    asked = negatives.Anchors(np.arange(40), np.zeros(40), x[:40], np.zeros((40, 1)), np.zeros((40, 1)))
    at = np.full(40, threshold)
    i, j, score = negatives.pairs_above(asked, at, x, None)
    s = x[:40] @ x.T
    wanted = {(a, b, s[a, b]) for a, b in zip(*np.nonzero(s >= threshold), strict=True)}
    assert set(zip(i.tolist(), j.tolist(), score.tolist(), strict=True)) == wanted


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_and_sql(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    sql = con.execute(negatives.ORACLE).fetchall()
    assert [d[0] for d in con.description] == COLUMNS
    got = found(op13_hard_negatives(spark, f"/root/testdata/{sf}"))
    assert got == sorted(sql) and got
    if sf == "sf0.001":
        moved = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, np.floor(256 * np.array(r.embedding, dtype=float)).astype(int).tolist()) for r in rows]
        assert got == brute(moved, lambda i: i % 100 == 0)


def test_query_leaves_out_what_is_not_finite(spark, tmp_path):
    v = [0.5, 0.25]
    rows = [(0, 1, v), (1, 1, v), (2, 2, v), (3, 2, [float("nan"), 1.0]), (4, 2, [float("inf"), 1.0]), (5, 2, [-float("inf"), 1.0]), (6, 2, [None, 1.0]), (8, None, v), (9, 2, None)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = found(op13_hard_negatives(spark, str(tmp_path)))
    assert rows == [(0, 2, 1, 1, 128 * 128 + 64 * 64, 128 * 128 + 64 * 64)]  # row 0 is moved to label 2, where row 2 is its positive and row 1 its negative
