"""Stored tables and indexes that change: versions, copy-on-write, segments, marks, pruning."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from larder.operators import search
from larder.operators.segments import SegmentIndex
from larder.sources import io, manifest, tables


def test_versions_and_conflicts(spark, tmp_path):
    root = str(tmp_path / "t")
    assert manifest.read(spark, root) == (0, {})
    assert manifest.commit(spark, root, 0, {"a": 1}) == 1
    assert manifest.commit(spark, root, 1, {"a": "é"}) == 2
    assert manifest.read(spark, root) == (2, {"a": "é"}) and manifest.read(spark, root, 1) == (1, {"a": 1})
    with pytest.raises(manifest.Conflict):
        manifest.commit(spark, root, 1, {"a": 3})
    assert manifest.read(spark, root) == (2, {"a": "é"})
    assert [p.name for p in (tmp_path / "t" / manifest.FOLDER).iterdir() if "draft" in p.name and not p.name.endswith(".crc")] == []


@pytest.fixture
def stored(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") % 7).alias("v"), F.lit(None).cast("string").alias("note"))
    return tables.StoredTable.create(rows.repartitionByRange(5, "id"), str(tmp_path / "table"))


def content(table):
    return {r.id: (r.v, r.note) for r in table.read().collect()}


def test_only_files_with_a_matching_row_are_rewritten(spark, stored):
    assert len(stored.files) == 5
    new = stored.update(F.col("id").between(3, 5), {"v": F.lit(99), "note": F.lit("n")})
    assert len(set(new.files) & set(stored.files)) == 4 and new.version == 2
    assert content(new) == {i: (99, "n") if 3 <= i <= 5 else (i % 7, None) for i in range(100)}
    assert content(stored) == {i: (i % 7, None) for i in range(100)}  # the old version stays readable
    same = new.update(F.lit(None).cast("boolean"), {"v": F.lit(0)})
    assert same.version == new.version and same.files == new.files
    source = spark.createDataFrame([(99, None, "z"), (1000, 1, "new"), (None, 2, "nobody")], "id long, v long, note string")
    merged = new.merge(source, "id", ["v", "note"])
    assert content(merged)[99] == (None, "z") and len(content(merged)) == 100 and len(set(merged.files) & set(new.files)) == 4
    with_new = merged.merge(source.select("id", "note"), "id", ["note"], insert=True)
    assert content(with_new)[1000] == (None, "new") and content(with_new)[None] == (None, "nobody") and len(content(with_new)) == 102
    gone = with_new.delete(spark.createDataFrame([(1000,), (4,), (5,), (None,)], "id long"), "id")
    assert set(content(gone)) == (set(range(100)) - {4, 5}) | {None}
    assert content(tables.StoredTable.open(spark, gone.path)) == content(gone)
    assert content(tables.StoredTable.open(spark, gone.path, 1)) == content(stored)
    assert gone.vacuum() > 0 and content(tables.StoredTable.open(spark, gone.path)) == content(gone)
    with pytest.raises(FileNotFoundError):
        tables.StoredTable.open(spark, gone.path + "-absent")


def test_failure_leaves_the_old_table(spark, stored, monkeypatch):
    before = content(stored)
    with monkeypatch.context() as m:
        m.setattr(manifest, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            stored.update(F.col("id") < 50, {"v": F.lit(-1)})
    assert content(tables.StoredTable.open(spark, stored.path)) == before
    first = stored.insert(spark.createDataFrame([(500, 1, "x")], "id long, v long, note string"))
    with pytest.raises(manifest.Conflict):  # from the version that the insert replaced
        stored.update(F.col("id") < 50, {"v": F.lit(-1)})
    assert content(tables.StoredTable.open(spark, stored.path)) == content(first)
    with pytest.raises(manifest.Conflict):
        tables.StoredTable.create(first.read(), stored.path)


def test_repeated_source_keys_raise(spark, stored):
    twice = spark.createDataFrame([(1, 5), (1, 6)], "id long, v long")
    with pytest.raises(ValueError, match="more than once"):
        stored.merge(twice, "id", ["v"])
    with pytest.raises(ValueError, match="more than once"):
        io.merge_update(stored.read(), twice, "id", ["v"])


def test_delete_from_both_tables(spark, tmp_path):
    parents = tables.StoredTable.create(spark.range(10).withColumnRenamed("id", "conversation_id"), str(tmp_path / "p"))
    children = tables.StoredTable.create(spark.range(30).select((F.col("id") % 10).alias("conversation_id"), "id"), str(tmp_path / "c"))
    kept, below = tables.delete_from(parents, children, spark.createDataFrame([(3,), (3,), (77,)], "conversation_id long"))
    assert kept.read().count() == 9 and below.read().count() == 27


def test_empty_table_and_table_without_rows_left(spark, tmp_path):
    none = tables.StoredTable.create(spark.range(0), str(tmp_path / "e"))
    assert none.read().count() == 0 and none.insert(spark.range(3)).read().count() == 3
    all_gone = tables.StoredTable.open(spark, none.path).delete(spark.range(3), "id")
    assert all_gone.read().count() == 0 and all_gone.insert(spark.range(2)).read().count() == 2


# ---- segments ---------------------------------------------------------------------------------

WEIGHTS = {"name": 3, "tags": 1}


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    zipf = [1 / (i + 1) for i in range(300)]
    return {i: (" ".join(r.choices(words, zipf, k=r.randint(0, 60))), [r.choice(words)] * (i % 3)) for i in range(900)}


def frame(spark, docs):
    return spark.createDataFrame([(i, n, t) for i, (n, t) in docs.items()], "id long, name string, tags array<string>")


def hits(df):
    return sorted((r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in df.collect())


def ask(spark):
    rows = [(1, "w5 w200 w5"), (2, "w0 w1 w2 w3"), (3, "w299"), (4, "absent"), (5, "")]
    return spark.createDataFrame(rows, "query_id long, query string")


def fresh(spark, docs, k=10, keep=None):
    return hits(search.bm25_search(search.bm25_index(frame(spark, docs), "id", WEIGHTS), ask(spark), k, keep))


def test_pruning_changes_no_result(spark, texts, tmp_path):
    index = SegmentIndex.create(frame(spark, texts), "id", WEIGHTS, str(tmp_path / "i"))
    keep = spark.range(0, 900, 3).withColumnRenamed("id", "doc_id")
    for k, kept in ((1, None), (10, None), (10, keep), (2000, None)):
        exact = index.search(ask(spark), k, kept, prune=False)
        fast = index.search(ask(spark), k, kept, first=2)
        assert hits(fast.hits) == hits(exact.hits) == fresh(spark, texts, k, kept)
        assert exact.read == exact.blocks == fast.blocks
        if k == 1:
            assert fast.read < fast.blocks
        if k == 2000:
            assert fast.read == fast.blocks


def test_append_delete_compact_equal_a_fresh_index(spark, texts, tmp_path):
    first = {i: v for i, v in texts.items() if i < 500}
    more = {i: v for i, v in texts.items() if i >= 500} | {7: ("w5 w5 w299", [])}  # 7 comes again with another text
    index = SegmentIndex.create(frame(spark, first), "id", WEIGHTS, str(tmp_path / "i"))
    old = index
    index = index.append(frame(spark, more))
    now = first | more
    assert len(index.state["segments"]) == 2 and hits(index.search(ask(spark), 10).hits) == fresh(spark, now)
    gone = [i for i in now if i % 4 == 1] + [12345]
    index = index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    now = {i: v for i, v in now.items() if i not in gone}
    assert hits(index.search(ask(spark), 10).hits) == fresh(spark, now)
    index = index.append(frame(spark, {1: texts[1]}))  # a deleted one comes back
    now[1] = texts[1]
    assert hits(SegmentIndex.open(spark, index.path).search(ask(spark), 10).hits) == fresh(spark, now)
    packed = index.compact()
    assert len(packed.state["segments"]) == 1 and not packed.state["marks"]
    assert hits(packed.search(ask(spark), 10).hits) == fresh(spark, now)
    assert hits(old.search(ask(spark), 10).hits) == fresh(spark, first)  # a reader of an old version is not disturbed
    with pytest.raises(manifest.Conflict):
        old.append(frame(spark, more))


def test_empty_index_and_index_without_documents_left(spark, texts, tmp_path):
    none = SegmentIndex.create(frame(spark, {}), "id", WEIGHTS, str(tmp_path / "e"))
    assert none.search(ask(spark), 5).hits.count() == 0
    few = {i: texts[i] for i in range(3, 6)}
    some = none.append(frame(spark, few))
    assert hits(some.search(ask(spark), 5).hits) == fresh(spark, few, 5)
    left = some.delete(spark.range(100), "id")
    assert left.search(ask(spark), 5).hits.count() == 0
    assert left.compact().search(ask(spark), 5).hits.count() == 0


def test_filters_without_source_raise(spark, texts):
    index = search.bm25_index(frame(spark, texts), "id", WEIGHTS)
    with pytest.raises(ValueError, match="source"):
        search.hybrid_search(index, spark.createDataFrame([], "doc_id long, embedding array<float>"), ask(spark), 5, filters=search.SearchFilters())
