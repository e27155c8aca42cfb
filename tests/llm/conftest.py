from __future__ import annotations

import random

import pytest

#: Names that operators use inside, as extra columns of the input.
CLASHING = "digest fp tag key span spans level salt p row row_id items runs n word"


def make_docs(spark, rows, extra=True):
    """rows: (doc_id, text, lang, source), with columns whose names clash with inner ones."""
    names = CLASHING.split() if extra else []
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} int" for c in names)
    return spark.createDataFrame([(*r, len(r[1] or ""), *range(len(names))) for r in rows], schema)


def sentence(r: random.Random, n: int, vocabulary: list[str]) -> str:
    return " ".join(r.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def vocabulary():
    r = random.Random(5)
    return ["".join(r.choice("abcdefghilmnoprstuvz") for _ in range(r.randint(2, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def edge_rows(vocabulary):
    """Null, empty, short, very long, repeated and self-repeating texts, null and repeated ids."""
    r = random.Random(9)
    passage = sentence(r, 60, vocabulary)
    base = sentence(r, 120, vocabulary)
    rows = [
        (0, base, "en", "a"), (1, None, "en", "a"), (2, "", None, "a"), (3, "one two", "en", None), (4, " \n\t ", "en", "b"), (5, base, "en", "b"),
        (6, base + " tail", "en", "b"), (7, sentence(r, 30, vocabulary) + " " + passage + " " + sentence(r, 30, vocabulary), "fr", "a"), (8, passage + "\n" + passage, "fr", "a"),
        (9, "loop " * 100, "en", "a"), (10, "x" * 50_000, "en", "a"), (11, sentence(r, 20_000, vocabulary), "en", "a"), (12, "Ünï©ode 日本語 текст 🙂 " * 3, "de", "a"),
        (13, base, "en", "a"), (13, base, "en", "a"), (None, "null id " + passage, "en", "a"), (None, None, None, None),
    ]
    rows += [(100 + i, sentence(r, r.randint(1, 80), vocabulary), r.choice(["en", "fr"]), r.choice("ab")) for i in range(40)]
    return rows
