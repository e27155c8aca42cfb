from __future__ import annotations

import hashlib
import random

from larder.llm import decontam
from tests.llm.conftest import make_docs, sentence


def brute(text, items, window=10):
    words = decontam.bench_words(text)
    hit, found = set(), set()
    for item, body in items:
        w = decontam.bench_words(body)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_words():
    assert decontam.bench_words("Don't STOP é9_x") == ["don", "t", "stop", "é9", "x"]
    assert decontam.bench_words("ÉA") == ["Éa"]  # only A-Z is folded


def test_against_brute_force(spark, edge_rows, vocabulary):
    r = random.Random(2)
    few = vocabulary[:12]
    items = [(i, sentence(r, n, few)) for i, n in enumerate([1, 2, 3, 9, 10, 11, 25, 40])] + [(20, None), (21, ""), (22, "!!"), (None, sentence(r, 12, few)), (3, sentence(r, 5, few))]
    rows = [x for x in edge_rows if len(x[1] or "") < 10_000] + [(500 + i, sentence(r, 60, few) + " " + items[6][1].upper() + ", " + sentence(r, 5, few), "en", "a") for i in range(20)]
    docs, bench = make_docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(x[0]), *brute(x[1], items)) for x in rows)
    for size, words in ((decontam.BLOCK_CHARS, decontam.PIECE_WORDS), (decontam.BLOCK_CHARS, 3), (200, 7)):
        got = decontam.contamination(docs, bench, block_chars=size, piece_words=words).collect()
        assert sorted((str(x.doc_id), x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got) == want
        kept = decontam.drop_contaminated(docs, bench, block_chars=size, piece_words=words)
        assert kept.columns == docs.columns and kept.count() == sum(not x[-1] for x in want)


def test_blocks_are_bounded(spark, vocabulary):
    """One long item and many equal ones: pieces are cut and equal ones become one, so no block is much larger than asked."""
    r = random.Random(3)
    long, same = sentence(r, 5_000, vocabulary), sentence(r, 40, vocabulary)
    bench = spark.createDataFrame([(0, long), *((i, same) for i in range(1, 400))], "item_id long, text string")
    sizes = [sum(len(p) for _, _, b in t.groups for x in b.values() for p, _ in x) for t in decontam.blocks_of(bench, block_chars=3_000, piece_words=50)]
    assert len(sizes) > 8 and max(sizes) < 4 * sum(sizes) / len(sizes)
    assert len(list(decontam.blocks_of(bench, block_chars=10**7))) == 1


def test_empty_tables(spark):
    docs = make_docs(spark, [(1, "a b c", "en", "a")])
    none = spark.createDataFrame([], "item_id long, text string")
    assert not decontam.contamination(docs, none).first().contaminated
    assert decontam.contamination(docs.limit(0), none).count() == 0
