from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from larder.llm import simhash
from tests.llm.conftest import make_docs


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_classes(fps):
    """Index -> least index of its component; links at two bits or fewer."""
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_equals_brute_force(edge_rows):
    for _, text, _, _ in edge_rows:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_documents(spark, edge_rows):
    docs = make_docs(spark, edge_rows)
    got = simhash.near_duplicates(docs).collect()
    fps = [brute_fingerprint(t) for _, t, _, _ in edge_rows]
    root = brute_classes(fps)
    least = {}
    for i, (doc, *_) in enumerate(edge_rows):
        ids = [x for x in (least.get(root[i]), doc) if x is not None]
        least[root[i]] = min(ids, default=None)
    want = sorted((str(d), f"{fps[i]:016x}", str(least[root[i]])) for i, (d, *_) in enumerate(edge_rows))
    assert sorted((str(x.doc_id), x.fingerprint, str(x.component_id)) for x in got) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(v) for v in least.values())
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_families_and_bucket_sizes(spark):
    r = random.Random(3)
    base, fps = [r.getrandbits(64) for _ in range(6)], []
    for _ in range(400):
        x = r.choice(base)
        for _ in range(r.choice([0, 1, 2, 3])):
            x ^= 1 << r.randrange(64)
        fps.append(x)
    df = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(fps)], "doc_id long, fp long")
    want = brute_classes(fps)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for most, batch in ((8, before), (2, "37"), (1000, "37")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {x.doc_id: x.component_id for x in df.join(simhash.classes(df, most), "fp").collect()}
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert [got[i] for i in range(len(fps))] == want


def test_long_chain_is_one_component(spark):
    fps = [0]
    for i in range(60):
        fps.append(fps[-1] ^ (1 << i))
    df = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(fps)], "doc_id long, fp long")
    assert {x.component_id for x in simhash.classes(df).collect()} == {0}


@pytest.mark.parametrize("few", [0, 1_000])
def test_one_row_of_each_document_whatever_the_order(spark, few):
    """Rows that repeat id and text but not other columns: the same row stays however they are dealt; ties and repeats count once."""
    rows = [(1, "a b c d", "en", f"s{i}") for i in range(6)] + [(None, "a b c d", "en", "s"), (None, None, "en", "x"), (None, None, "en", "y"), (2, "A B C D", "en", "s"), (3, "other words here now", "en", "s")] * 2
    kept = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        docs = make_docs(spark, rows).drop("n_chars").repartition(1 + seed)
        docs = docs.withColumn("n_chars", F.length("source"))
        kept.append(sorted((str(x.doc_id), str(x.text), x.source) for x in simhash.drop_near_duplicates(docs, few=few).collect()))
    assert kept[0] == kept[1] == kept[2] and [x[0] for x in kept[0]] == ["1", "3", "None"]
