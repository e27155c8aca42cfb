from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest

from larder.llm import trie
from larder.llm.queries import op11_prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Nodes of the trie from a dictionary of every prefix."""
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        own.setdefault(conv, []).append((role or "", text or ""))
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - int(abs(c) % 5 * (1 if c >= 0 else -1)), [])
        s = tuple(base[:h] + turns[h:])
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
        ends.setdefault(s, []).append(c)
    children, saved, leaves = {}, {}, {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, m in members.items():
        worth = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] = saved.get(p[:d], 0) + worth
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in children)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children.get(p, 0), leaves[p], saved[p], digest(ends.get(p, []))) for p, m in members.items()
    )


def conversations(spark, rows):
    names = ["key", "seq", "n", "depth", "head", "ends"]
    schema = "conv_id long, turn long, role string, text string" + "".join(f", {c} int" for c in names)
    return spark.createDataFrame([(*r, *range(len(names))) for r in rows], schema)


def found(df):
    return sorted(tuple(-1 if v is None else v for v in (r[c] for c in COLUMNS)) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    says = lambda n: (r.choice(["user", "assistant"]), " ".join(r.choice("aé🙂b") for _ in range(n)))
    few = [says(n) for n in (0, 1, 2, 5)]
    out = []
    for c in range(400):  # few distinct turns: deep shared prefixes and many copies
        out += [(c, t, *r.choice(few[: 2 + c % 3])) for t in range(r.randint(1, 12))]
    out += [(c, t, "user", "the same") for c in range(1000, 1300) for t in range(3)]  # a large group of copies
    out += [(c, t, *says(3)) for c in range(2000, 2040) for t in range(r.randint(1, 9))]
    out += [(2100 + c, t, "user", f"turn {t}") for c in range(6) for t in range(150 + c)]  # long ones that share all but their ends
    out += [(3001, 0, "user", "lonely"), (3002, 5, "user", "x"), (3002, None, None, None), (3002, None, "user", "null first"), (3002, 5, "user", "x"), (3002, 5, "user", "w"), (3002, 5, "assistant", "z")]
    out += [(None, 0, "user", "nobody's"), (-3, 0, "user", "a"), (0, 99, "user", "b" * 50_000), (-7, 1, None, "a"), (-5, 0, "user", "c")]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("limit", [1, 40, 1_000, trie.CONTAINER])
def test_nodes_equal_brute_force_whatever_bursts(spark, rows, limit):
    assert found(trie.prefix_trie(conversations(spark, rows).repartition(6), limit)) == brute(rows)


def test_containers_are_bounded(spark, rows):
    strings = trie.distinct_strings(trie.rebuild(trie.turn_strings(conversations(spark, rows))))
    placed, heads, n = trie.burst(strings, 40)
    assert n > 20 and heads.count() == n
    held = {}
    for x in placed.collect():
        if x.depth * trie.CELL <= len(x.seq):
            held.setdefault(bytes(x.seq[: x.depth * trie.CELL]), []).append(len(x.seq) // trie.CELL - x.depth)
    assert all(sum(v) <= 40 or len(v) == 1 for v in held.values())


def test_member_lists_of_many_pieces(spark, rows, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    assert found(trie.prefix_trie(conversations(spark, rows))) == brute(rows)


def test_empty_and_turnless(spark):
    assert trie.prefix_trie(conversations(spark, [])).count() == 0
    turnless = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    rows = [(turnless, 0, "user", "gone")]
    assert found(trie.prefix_trie(conversations(spark, rows))) == brute(rows)
    assert brute(rows) == [(turnless, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_and_sql(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    wanted = brute(rows)
    sql = con.execute(trie.ORACLE).fetchall()
    assert [d[0] for d in con.description] == COLUMNS
    assert sorted(tuple(-1 if v is None else v for v in r) for r in sql) == wanted
    assert found(op11_prefix_trie(spark, f"/root/testdata/{sf}")) == wanted


def test_sql_on_hard_rows(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    own = [r for r in rows if r[0] is None or r[0] < 2000 and r[0] % 7 == 0 or r[0] > 3000 or r[0] < 0]
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", own)
    assert sorted(tuple(-1 if v is None else v for v in r) for r in con.execute(trie.ORACLE).fetchall()) == brute(own)
