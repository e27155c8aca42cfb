"""Null rules and edge rows of the scalar functions."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from larder.functions import exprs, nutrition, text, udfs, vectors
from larder.schemas import NUTRIENTS, RECIPES, conform
from larder.sources import io


def one(spark, column, **values):
    """The value of a column expression over one row of literals."""
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


def plain_index(v):
    if any(v[n] is None for n in [*nutrition.RISKS, *nutrition.MICROS, "protein_g", "fiber_g"]):
        return None
    risk = sum(max(1 - v[n] / t if v[n] <= t else -a * (v[n] / t - 1), 0) for n, (t, a) in nutrition.RISKS.items()) / 3
    benefit = (min(v["protein_g"] / 50, 1) + min(v["fiber_g"] / 30, 1)) / 2
    micro = sum(min(v[n] / t, 1) for n, t in nutrition.MICROS.items()) / 5
    return max(0.0, 0.4 * risk + 0.4 * benefit + 0.2 * micro) * 100


def test_health_index(spark):
    r = random.Random(1)
    refs = {"sugar_g": 50.0, "saturated_fats_g": 20.0, "sodium_mg": 2000.0, "protein_g": 50.0, "fiber_g": 30.0} | nutrition.MICROS
    rows = [dict.fromkeys(NUTRIENTS, 0.0), {n: refs.get(n, 1.0) for n in NUTRIENTS}, {n: -1.0 for n in NUTRIENTS}]
    rows += [{n: refs.get(n, 1.0) * (f if n == k else 1.0) for n in NUTRIENTS} for k in nutrition.RISKS for f in (1.0001, 5.0)]
    rows += [{n: None if n == k else 1.0 for n in NUTRIENTS} for k in NUTRIENTS]
    rows += [{n: r.choice([None] * (r.random() < 0.05) + [r.uniform(0, 2 * refs.get(n, 100.0))]) for n in NUTRIENTS} for _ in range(200)]
    df = spark.createDataFrame([(i, *(x[n] for n in NUTRIENTS)) for i, x in enumerate(rows)], "i int, " + ", ".join(f"{n} double" for n in NUTRIENTS))
    got = {x.i: x.s for x in df.select("i", nutrition.health_index().alias("s")).collect()}
    for i, x in enumerate(rows):
        want = plain_index(x)
        assert (got[i] is None) == (want is None) and (want is None or math.isclose(got[i], want, abs_tol=1e-9))


def test_null_strict_extrema(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, exprs.null_least(a, b), a=("double", None), b=("double", 1.0)) is None
    assert one(spark, exprs.null_greatest(a, b), a=("double", 2.0), b=("double", 1.0)) == 2.0
    assert one(spark, exprs.clamp(a, 0, 1), a=("double", 7.0)) == 1.0


@pytest.mark.parametrize(("raw", "want"), [('["a", "b"]', ["a", "b"]), ("['a', 'b']", ["a", "b"]), ("[10, 2]", ["10", "2"]), ("plain", ["plain"]), ("", None), (None, None), ("[]", [])])
def test_parse_list(spark, raw, want):
    assert one(spark, io.parse_list(F.col("a")), a=("string", raw)) == want


def test_parse_numbers(spark):
    assert one(spark, io.parse_number_list(F.col("a")), a=("string", "[1e3, x, 2.5]")) == [1000.0, None, 2.5]
    assert one(spark, exprs.try_number(F.col("a")), a=("string", "0,33 0.83")) == 0.33
    assert one(spark, exprs.try_number(F.col("a")), a=("string", "abc")) is None
    assert one(spark, vectors.parse_vector(F.col("a")), a=("string", "[0.5  1 -2]")) == [0.5, 1.0, -2.0]


def test_tokenize(spark):
    tokens = lambda s: one(spark, text.tokenize(F.col("a"), ["name"]), a=("string", s))
    assert tokens("Crème brûlée, don't NAME 42 x the") == ["crème", "brûlée", "don", "42"]
    assert tokens(None) == [] and tokens("the a of") == [] and tokens("") == []


def test_tag_filters(spark):
    f = lambda v: one(spark, text.tag_filters(F.col("a")), a=("array<string>", v))
    assert f(["VEGGIE", "low-carb", "no meat", "zzz"]) == ["vegetarian", "low_carb"]
    assert f([]) == [] and f(None) == []


@pytest.mark.parametrize("n", [0, 299, 300, 301, 536, 537, 2000])
def test_chunks_cover_text(spark, n):
    body = ("word " * n)[:n]
    got = one(spark, text.chunks(F.col("a")), a=("string", body))
    assert (got == []) == (n == 0)
    assert all(len(c) <= 300 for c in got) and (n == 0 or n > 300 or got == [body])
    if n > 300:
        assert body.startswith(got[0]) and body.rstrip().endswith(got[-1].rstrip())


def test_chunk_bounds():
    with pytest.raises(ValueError):
        text.chunks(None, 10, 10)


@pytest.mark.parametrize(("message", "want"), [("the second one", 2), ("2nd please", 2), ("see #4", 4), ("recipe number 5", 5), ("number 12", 12), ("recipe 7", 7), ("none", None), (None, None), ("tenth or first", 1)])
def test_references(spark, message, want):
    assert one(spark, text.recipe_reference(F.col("a")), a=("string", message)) == want


def test_json_ids(spark):
    ids = lambda s: one(spark, text.json_ids(F.col("a")), a=("string", s))
    assert ids('{"results":[{"id":3},{"id":"4"},{"id":3}]}') == [3, 4]
    assert ids('{"result":"{\\"results\\":[{\\"id\\":9}]}"}') == [9]
    assert ids('{"results":[{"id": 5}, {"id": 6') == [5, 6]
    assert ids(None) == [] and ids("x") == []


def test_title_and_overlap(spark):
    title = lambda s: one(spark, text.conversation_title(F.col("a")), a=("string", s))
    assert title("find me a quick pasta recipe with basil") == "find me a quick pasta..."
    assert title("hello") == "New Conversation..." and title(None) is None
    share = lambda n, m: one(spark, text.token_overlap(F.col("a"), F.col("b")), a=("string", n), b=("string", m))
    assert share("The red bean soup", "soup of red things") == pytest.approx(2 / 3) and share("the of", "x") is None


def test_vectors(spark):
    cos = lambda a, b: one(spark, vectors.cosine(F.col("a"), F.col("b")), a=("array<float>", a), b=("array<float>", b))
    assert cos([1.0, 0.0], [0.0, 0.0]) is None and cos(None, [1.0]) is None and cos([2.0, 0.0], [5.0, 0.0]) == 1.0
    assert one(spark, vectors.l2_normalize(F.col("a")), a=("array<float>", [0.0, 0.0])) == [0.0, 0.0]


def test_levels_and_slices(spark):
    assert one(spark, exprs.health_level(F.col("a"), F.lit("fat")), a=("double", 30.0)) == "orange"
    assert one(spark, exprs.health_level(F.col("a"), F.lit("fat")), a=("double", None)) is None
    assert one(spark, exprs.slice_text(F.col("a"), 3, -3), a=("string", "1 (155 g)")) == "155"
    assert one(spark, exprs.json_text(F.col("a")), a=("string", '```json\n{"a": 1}\n```')) == '{"a": 1}'
    assert one(spark, exprs.safe_quotient(F.lit(1), F.lit(0))) is None and one(spark, exprs.safe_sqrt(F.lit(-1.0))) is None


def test_registered_functions(spark):
    def total(xs: list[float], scale: int) -> float | None:
        return sum(xs) * scale if xs else None

    udfs.register(spark, "total", total)
    assert spark.sql("SELECT total(array(1.0D, 2.0D), 3L) AS r").first().r == 9.0
    with pytest.raises(TypeError):
        udfs.signature(lambda x: x)


def test_conform(spark):
    got = conform(spark.createDataFrame([(1, "a", 5)], "ID int, Name string, other int"), RECIPES)
    assert got.schema == RECIPES and got.first().name == "a" and got.first().tags is None


def test_shared_folder_is_never_local_on_a_cluster():
    from types import SimpleNamespace

    from larder.sources.workdir import shared_dir

    def session(master, **conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d), set=lambda k, v: conf.__setitem__(k.replace(".", "_"), v)), sparkContext=SimpleNamespace(master=master))

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            shared_dir(session(master), "a")
        assert shared_dir(session(master, spark_checkpoint_dir="file:///shared/"), "a").startswith("file:///shared/a-")
    local = session("local[2]")
    assert shared_dir(local, "a").rsplit("/", 1)[0] == shared_dir(local, "b").rsplit("/", 1)[0]
