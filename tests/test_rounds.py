"""Substitution one removal after another, against a step-by-step reading of the same rules."""

from __future__ import annotations

import random

import pytest

from larder.operators import transform
from larder.operators.nutrition import nutrition_of_lines
from larder.operators.substitute import constraint_struct, substitutes
from larder.operators.transform import Kitchen
from larder.schemas import NUTRIENTS

FLAGS = ["is_lactose", "is_gluten", "contains_nuts", "is_vegetarian", "is_vegetable"]
TAGS = ["is_dairy", "is_gluten", "contains_nuts", "is_vegetarian", "is_vegetable", "is_seafood", "is_sweetener", "is_grain"]


@pytest.fixture(scope="module")
def kitchen(spark):
    r = random.Random(12)
    names = [f"{a}{b}" for a in ("al", "bo", "cu", "de", "fi", "go", "hu") for b in ("ras", "net", "lim", "pod", "kex", "vum")]
    rows = [(str(i), n, *(float(r.randint(0, 60)) for _ in NUTRIENTS), *(r.randint(0, 1) for _ in FLAGS), [r.random() for _ in range(3)], [r.random() for _ in range(2)]) for i, n in enumerate(names)]
    catalogue = spark.createDataFrame(rows, f"ndb_no string, descrip string, {', '.join(f'{n} double' for n in NUTRIENTS)}, {', '.join(f'{f} int' for f in FLAGS)}, macro array<double>, micro array<double>")
    tags = spark.createDataFrame([(str(i), *(r.choice([True, False, None]) for _ in TAGS)) for i in range(len(names))], f"ndb_no string, {', '.join(f'{t} boolean' for t in TAGS)}")
    lists = {i: r.sample(names, 6) for i in range(14)}
    recipes = spark.createDataFrame([(i, f"dish {i}", x, [f"cut {x[0]} and {x[5]}", "serve"]) for i, x in lists.items()], "id long, name string, ingredients array<string>, steps array<string>")
    weights = spark.createDataFrame([(i, str(100 + i), "4") for i in lists], "id long, serving_size string, servings string")
    quantity = spark.createDataFrame([(i, n, None if r.random() < 0.3 else 20.0 * r.randint(1, 9)) for i, x in lists.items() for n in x], "id long, ingredients string, qty_g double")
    return Kitchen(recipes, weights, quantity, catalogue, tags), lists, {n: str(i) for i, n in enumerate(names)}


def step_by_step(spark, kitchen, constraints, gone, given):
    """new lists by the rules: gone {id: [names in order]}, given {(id, place): name}."""
    made, lists, ndb = kitchen
    lines = {i: [] for i in lists}
    for x in transform.recipe_lines(made).orderBy("id", "pos").collect():
        lines[x.id].append([x.ingredient, x.ndb_no, x.qty_g, x.total_weight])
    offers = {}
    near = substitutes(spark.createDataFrame([(n,) for n in {n for v in gone.values() for n in v}], "target string"), made.catalogue, constraints, 5)
    for x in near.orderBy("target", "rank").collect():
        offers.setdefault(x.target, []).append((x.ndb_no, x.descrip))
    working = {i: [x for x in lines[i] if x[0] not in gone.get(i, ())] for i in lists}
    swapped = {i: {} for i in lists}
    for place in range(1, max(map(len, gone.values())) + 1):
        tried, rows = {}, []
        for i, names in gone.items():
            if len(names) < place:
                continue
            old = names[place - 1]
            own = given.get((i, place))
            some = [(ndb[own], own)] if own in ndb else offers.get(old, [])
            for rank, (code, descrip) in enumerate(some):
                tried[i, rank] = (old, code, descrip)
                added = [[descrip, code, x[2], x[3]] for x in lines[i] if x[0] == old]
                rows += [(str(rank), i, x[1], x[2], x[3]) for x in working[i] + added]
        if not rows:
            continue
        scored = nutrition_of_lines(spark.createDataFrame(rows, "variant string, id long, ndb_no string, qty_g double, total_weight double"), made.catalogue).collect()
        for i in {x.id for x in scored}:
            best = min((x for x in scored if x.id == i), key=lambda x: (-round(x.score_sante, 9) if x.score_sante is not None else 1e9, int(x.variant)))
            old, code, descrip = tried[i, int(best.variant)]
            working[i] += [[descrip, code, x[2], x[3]] for x in lines[i] if x[0] == old]
            swapped[i][old] = descrip
    after = [("", i, x[1], x[2], x[3]) for i in lists if swapped[i] for x in working[i]]
    score = {x.id: x.score_sante for x in nutrition_of_lines(spark.createDataFrame(after, "variant string, id long, ndb_no string, qty_g double, total_weight double"), made.catalogue).collect()}
    return {i: ([swapped[i].get(n, n) for n in x], score.get(i)) for i, x in lists.items()}


def found(df):
    return {x.id: (list(x.ingredients), x.nutrition_after and x.nutrition_after.score_sante) for x in df.collect()}


def close(a, b):
    assert {i: v[0] for i, v in a.items()} == {i: v[0] for i, v in b.items()}
    for i in a:
        assert (a[i][1] is None) == (b[i][1] is None) and (a[i][1] is None or a[i][1] == pytest.approx(b[i][1]))


def test_many_removals_and_given_substitutes(spark, kitchen):
    made, lists, _ = kitchen
    gone = {i: x[: i % 6] for i, x in lists.items() if i % 6}  # up to five in one recipe
    given = {(3, 2): lists[4][0], (4, 1): "nobody knows it", (5, 1): lists[6][1], (5, 9): lists[6][2], (0, 1): lists[1][0]}
    remove = spark.createDataFrame([(i, n, 10 * k) for i, v in gone.items() for k, n in enumerate(v)] + [(3, "not in it", 5)], "id long, ingredient string, place int")
    own = spark.createDataFrame([(*k, v) for k, v in given.items()], "id long, place int, name string")
    none = constraint_struct([])
    close(found(transform.substitute_rounds(made, none, remove, own)), step_by_step(spark, kitchen, none, gone, given))
    close(found(transform.substitute_rounds(made, none, remove)), step_by_step(spark, kitchen, none, gone, {}))


def test_what_breaks_a_diet_goes_besides(spark, kitchen):
    made, lists, _ = kitchen
    diet = constraint_struct(["no_gluten", "decrease_sugar"])
    own = {x.id: [] for x in made.recipes.collect()}
    for x in transform.removals(transform.recipe_lines(made), made, diet).orderBy("id", "place").collect():
        own[x.id].append(x.ingredient)
    listed = {i: [lists[i][5]] for i in range(0, 14, 2)}
    gone = {i: [*listed.get(i, []), *(n for n in own[i] if n not in listed.get(i, []))] for i in lists}
    remove = spark.createDataFrame([(i, v[0], 1) for i, v in listed.items()], "id long, ingredient string, place int")
    close(found(transform.substitute_rounds(made, diet, remove)), step_by_step(spark, kitchen, diet, {i: v for i, v in gone.items() if v}, {}))
    close(found(transform.substitute_rounds(made, diet)), step_by_step(spark, kitchen, diet, {i: v for i, v in own.items() if v}, {}))


def test_nothing_to_remove(spark, kitchen):
    made, lists, _ = kitchen
    got = transform.substitute_rounds(made, constraint_struct([]))
    assert {x.id: list(x.ingredients) for x in got.collect()} == lists and not got.where("success").count()
    assert transform.substitute_rounds(Kitchen(made.recipes.limit(0), made.weights, made.quantity, made.catalogue, made.tags), constraint_struct(["vegan"])).count() == 0


def test_the_first_choice_changes_the_second(spark, kitchen):
    """Judged one after another, some recipe ends otherwise than judged on the original list."""
    made, lists, _ = kitchen
    remove = spark.createDataFrame([(i, n, k) for i, x in lists.items() for k, n in enumerate(x[:3], 1)], "id long, ingredient string, place int")
    none = constraint_struct([])
    one, two = (found(f(made, none, remove)) for f in (transform.substitute_rounds, transform.substitute_flow))
    assert any(one[i][0] != two[i][0] for i in lists)
