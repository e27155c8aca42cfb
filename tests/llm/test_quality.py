from __future__ import annotations

import random
import re

import duckdb
import numpy as np

from larder.llm import quality
from tests.llm.conftest import make_docs, sentence


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_base_statistics(spark, edge_rows):
    docs = make_docs(spark, [*edge_rows, (700, "a#b * c\n\x0bd\x0c e\r\na#b * c\n", "en", "a"), (701, "same line\nsame line\n\nsame line", "en", "a")])
    got = quality.base_statistics(docs).collect()
    want = sorted((str(x.doc_id), *brute(x.text)) for x in docs.select("doc_id", "text").collect())
    assert sorted((str(x.doc_id), x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in got) == want


def brute_mcd(x, support=quality.SUPPORT):
    """Both starts, concentration steps until the determinant stands still, with numpy; quantiles by bucket. (distances, log determinant, steps)"""

    def at_share(v, q):
        return np.sort(v)[int(np.ceil(q * len(v))) - 1]

    def estimate(mean, cov):
        cov = cov + np.diag(np.square(quality.LEAST_SPREAD))
        z = np.linalg.solve(np.linalg.cholesky(cov), (x - mean).T)
        return (z * z).sum(axis=0), np.linalg.slogdet(cov)[1]

    def bucket(d):
        return np.floor(np.log2(d + 1e-6) * quality.BUCKETS)

    cols = range(x.shape[1])
    q = {s: np.array([at_share(np.floor(x[:, i] * quality.UNITS), s) for i in cols]) for s in (0.25, 0.5, 0.75)}
    ends = []
    for mean, cov in ((x.mean(axis=0), np.cov(x.T, bias=True)), (q[0.5] / quality.UNITS, np.diag(((q[0.75] - q[0.25]) / (quality.UNITS * 1.349)) ** 2))):
        (d, _), was = estimate(mean, cov), np.inf
        for step in range(quality.MOST_STEPS):
            kept = x[bucket(d) <= at_share(bucket(d), support)]
            new, log_det = estimate(kept.mean(axis=0), np.cov(kept.T, bias=True))
            stop = log_det >= was - quality.STILL
            if log_det <= was:
                d, was = new, log_det
            if stop:
                break
        ends.append((was, d, step))
    log_det, d, step = min(ends, key=lambda e: e[0])
    scale = 2 ** ((at_share(bucket(d), 0.5) + 0.5) / quality.BUCKETS)
    return d * min(1, quality.CHI2_MEDIAN / scale), log_det, step


def spread_rows(r, vocabulary, n, at=0):
    """Texts of ordinary spread in every part: some symbols, some repeated lines, any length."""
    rows = []
    for i in range(n):
        lines = [sentence(r, r.randint(5, 20), vocabulary) for _ in range(r.randint(4, 40))]
        lines += r.choices(lines, k=int(len(lines) * r.choice([0, 0, 0.1, 0.3])))
        text = "\n".join(line + ("#" * r.randint(1, 3) if r.random() < 0.2 else "") for line in lines)
        rows.append((at + i, text, "en", "a"))
    return rows


def test_verdict_against_brute_force(spark, vocabulary):
    r = random.Random(4)
    rows = [(i, sentence(r, r.randint(40, 400), vocabulary) + ".", "en", "a") for i in range(120)]
    rows += [(200 + i, " ".join(w + "###$$$" for w in sentence(r, 100, vocabulary).split()), "en", "a") for i in range(8)]
    rows += [(*x[:3], "b") for x in spread_rows(r, vocabulary, 150, 1000)] + [(1900, sentence(r, 300, vocabulary).replace(" ", "$%#&| "), "en", "b")]
    docs = make_docs(spark, rows)
    stats = {x.doc_id: x for x in quality.with_vector(quality.base_statistics(docs)).collect()}
    want = {}
    for source in "ab":
        ids = sorted(i for i in stats if not stats[i].base_failed and stats[i].source == f"={source}")
        assert len(ids) > 100
        want |= dict(zip(ids, brute_mcd(np.array([[stats[i][f"x{j}"] for j in range(5)] for i in ids]))[0], strict=True))
    got = {x.doc_id: x for x in quality.quality(docs).collect()}
    assert all(abs(got[i].distance2 - want[i]) <= 1e-3 * max(1, want[i]) for i in want)
    assert all(got[i].kept for i in range(120)) and not any(got[200 + i].kept for i in range(8))
    # in a group of ordinary spread the junk goes and nearly all else stays
    assert not got[1900].kept and sum(got[i].kept for i in got if 1000 <= i < 1900) > 0.97 * sum(not got[i].base_failed for i in got if 1000 <= i < 1900)


def test_the_end_is_no_worse_than_its_starts():
    """Concentration never raises the determinant, and stops by itself well before the bound."""
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(size=(200, 5)), r.normal(loc=6, size=(50, 5))])
    d, log_det, steps = brute_mcd(x)
    spread = np.diag(np.square(quality.LEAST_SPREAD))
    assert log_det < np.linalg.slogdet(np.cov(x.T, bias=True) + spread)[1] and steps < 20
    assert (d[200:] > quality.CUT).all() and (d[:200] <= quality.CUT).mean() > 0.95


def test_result_does_not_depend_on_partitions(spark, vocabulary):
    r = random.Random(6)
    rows = [(i, t, r.choice(["en", "fr", None, ""]), r.choice(["a", None])) for i, t, *_ in spread_rows(r, vocabulary, 300)]
    docs = make_docs(spark, rows)
    found = [sorted(map(tuple, quality.quality(docs.repartition(n)).select("doc_id", "kept", "distance2").collect())) for n in (1, 7)]
    assert found[0] == found[1] and len(found[0]) == 300


def test_many_groups_are_joined(spark, vocabulary, monkeypatch):
    """Beyond the number of groups that are broadcast the salted join gives the same."""
    docs = make_docs(spark, [(i, t, "en", f"s{i % 3}") for i, t, *_ in spread_rows(random.Random(7), vocabulary, 150)])
    one = sorted(map(tuple, quality.quality(docs, least_rows=30).collect()))
    monkeypatch.setattr(quality, "FEW_GROUPS", 0)
    assert sorted(map(tuple, quality.quality(docs, least_rows=30, salts=3).collect())) == one


def test_levels(spark):
    rows = [("=en", "=a", False)] * 5 + [("=en", "=b", False)] * 2 + [("=fr", "=a", False)] * 2 + [("=fr", "=b", False)] * 2 + [("", "", False), ("=", "", True)]
    got = {(x.lang, x.source): (x.level, list(x.member_of)) for x in quality.group_levels(spark.createDataFrame(rows, "lang string, source string, base_failed boolean"), 3).collect()}
    assert got == {("=en", "=a"): (0, [0, 1, 2]), ("=en", "=b"): (1, [1, 2]), ("=fr", "=a"): (1, [1, 2]), ("=fr", "=b"): (1, [1, 2]), ("", ""): (2, [2]), ("=", ""): (2, [2])}


def test_base_equals_sql(spark):
    """The base columns of the query against DuckDB, over a whole table."""
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    found = con.execute(quality.ORACLE_BASE)
    names = [d[0] for d in found.description]
    got = quality.base_statistics(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())


def test_edges(spark, edge_rows):
    docs = make_docs(spark, edge_rows)
    got = quality.quality(docs).collect()
    assert len(got) == len(edge_rows)
    assert not any(x.kept for x in got if x.base_failed)
    assert quality.quality(docs.limit(0)).count() == 0


def test_no_python_in_plan(spark, edge_rows):
    plan = quality.quality(make_docs(spark, edge_rows))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
