"""Operator 11: the prefix trie of conversations, by burst tries.

A turn's id is a digest of its role and text beside the length of the text; a conversation is the string of its turns' ids, and
equal conversations are one string with a count. All strings begin in one container under the root. A container of more
than ``CONTAINER`` turns bursts: its head becomes an inner node, and its strings go by their next turn id to containers
one level below, which burst in turn; rounds cover 2, 2, 4, 8 ... levels, so a prefix that very many conversations
share takes few. The containers that remain are dealt over tasks by their head (the shards), sorted, and swept once: a stack of
open nodes along the last string closes a node when the next string leaves it. Heads add up what the containers
below them give. A head that holds a third of all conversations is split by what follows it, copies are one string before that, and only
strings of digests are shuffled, never texts.

Memory of a task: the nodes of one container, and one conversation's ids (24 bytes a turn). The digest over a node's members is
sequential by its definition; the ids it reads are sorted over all tasks first and arrive as joined pieces.

Defined results: rows are ordered by turn (null first), then role, then text; rows that repeat all four are turns of their
own; null role or text is empty; a row without a conv_id belongs to no conversation; an empty table has no root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import materialize

#: Bytes of a turn in a string: 16 of its digest, 8 of its text's length.
CELL = 24
#: Turns of a container at most, unless it holds a single string.
CONTAINER = 20_000
#: Heads (about 100 bytes each) that are broadcast at most.
FEW_HEADS = 500_000
#: Conversations beside the first of each family of five borrow up to this many of its turns.
FAMILY, MOST_SHARED = 5, 8
#: Ids that stand in one piece of a node's member list.
PIECE = 5_000

STRINGS = "key binary, conv_id bigint, seq binary"
HEADS = "head binary, parent binary, level bigint, bytes bigint, cells bigint, n bigint, conv_id bigint"
SWEPT = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends binary, parent_head binary, path binary"


def node_key(prefix: bytes) -> bytes:
    return hashlib.blake2b(prefix, digest_size=16).digest()


def node_keys(prefix: bytes, first: int, last: int) -> Iterator[bytes]:
    """Keys of the nodes at depths ``first`` to ``last`` along a string."""
    h = hashlib.blake2b(prefix[: first * CELL], digest_size=16)
    yield h.copy().digest()
    for d in range(first, last):
        h.update(prefix[d * CELL : (d + 1) * CELL])
        yield h.copy().digest()


def text_bytes(seq: bytes, depth: int) -> int:
    """Bytes of the text at a depth; the root has none."""
    return int.from_bytes(seq[depth * CELL - 8 : depth * CELL], "big") if depth else 0


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "bigint": pa.int64()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def _in_batches(rows: Iterator[tuple], schema: str, size: int = 4_000, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    found, n = [], 0
    for row in rows:
        found.append(row)
        n += sum(len(x) for x in row if isinstance(x, bytes))
        if len(found) >= size or n >= limit:
            yield _batch(found, schema)
            found, n = [], 0
    if found:
        yield _batch(found, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def turn_strings(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, tie, cell: one row per turn, without its text; ``tie`` orders turns of one number by role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    cell = F.unhex(F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.octet_length(text)), 16, "0")))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), cell.alias("cell"))
    place = ["conv_id", "turn"]
    tied = materialize(turns.groupBy(*place).count().where("count > 1").select(*place), "tied")
    if tied.isEmpty():
        return turns.select(*place, F.lit(0).alias("tie"), "cell")
    same = lambda a, b: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in place))
    distinct = turns.join(tied, same(turns, tied), "left_semi").groupBy(*place, "cell").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    ranks = materialize(distinct.select(*place, "cell", F.row_number().over(Window.partitionBy(*place).orderBy("role", "text")).alias("tie")), "ties")
    return turns.join(ranks, same(turns, ranks) & (turns["cell"] == ranks["cell"]), "left").select(turns["conv_id"], turns["turn"], F.coalesce(ranks["tie"], F.lit(0)).alias("tie"), turns["cell"])


def rebuild(turns: DataFrame) -> DataFrame:
    """key, conv_id, seq: every conversation with the first turns of its family's head, h = crc32(conv_id) % 9 of them, before its own after the first h."""
    family = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family")
    dealt = turns.select(family, (F.col("conv_id") != F.expr(f"conv_id - conv_id % {FAMILY}")).alias("member"), "conv_id", "turn", "tie", "cell").repartition("family")
    dealt = dealt.sortWithinPartitions("family", "member", "conv_id", F.col("turn").asc_nulls_first(), "tie").select("family", "conv_id", "cell")

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        """Family, conv_id and own turns, as the sorted rows give them."""
        now, parts = None, []
        for batch in batches:
            families, convs = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            data = b"".join(batch.column(2).to_pylist())
            starts = np.flatnonzero(np.concatenate([[True], convs[1:] != convs[:-1]])) if len(convs) else []
            for a, b in zip(starts, [*starts[1:], len(convs)], strict=True):
                own = (int(families[a]), int(convs[a]))
                if own != now and now is not None:
                    yield *now, b"".join(parts)
                    parts = []
                now = own
                parts.append(data[a * CELL : b * CELL])
        if now is not None:
            yield *now, b"".join(parts)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        of, head = None, b""
        for family, conv, own in conversations(batches):
            if family != of:
                of, head = family, b""
            if conv == family:
                head = own[: MOST_SHARED * CELL]
            else:
                h = zlib.crc32(str(conv).encode()) % (MOST_SHARED + 1) * CELL
                own = head[:h] + own[h:]
            yield node_key(own), conv, own

    return materialize(dealt.mapInArrow(lambda batches: _in_batches(rows(batches), STRINGS), STRINGS), "rebuilt")


def member_lists(rebuilt: DataFrame) -> DataFrame:
    """key, conv_id, n, ends: smallest id, number and digest of the conversations of each distinct string."""
    joined, summed = "key binary, conv_id bigint, n bigint, ids binary", "key binary, conv_id bigint, n bigint, ends binary"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, ids = None, []
        for k, conv in _rows(batches):
            if k != key or len(ids) >= PIECE:
                if ids:
                    yield key, ids[0], len(ids), ",".join(map(str, ids)).encode()
                key, ids = k, []
            ids.append(conv)
        if ids:
            yield key, ids[0], len(ids), ",".join(map(str, ids)).encode()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, least, n, h = None, None, 0, None
        for k, conv, more, ids in _rows(batches):
            if k == key:
                h.update(b",")
            else:
                if key is not None:
                    yield key, least, n, h.digest()
                key, least, n, h = k, conv, 0, hashlib.sha256()
            n += more
            h.update(ids)
        if key is not None:
            yield key, least, n, h.digest()

    ids = rebuilt.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = ids.mapInArrow(lambda batches: _in_batches(join(batches), joined), joined)
    return parts.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(lambda batches: _in_batches(digest(batches), summed), summed)


def distinct_strings(rebuilt: DataFrame) -> DataFrame:
    """key, seq, conv_id, n, ends: every distinct string once."""
    once = rebuilt.groupBy("key").agg(F.first("seq").alias("seq"))
    return materialize(once.join(member_lists(rebuilt), "key"), "strings")


def small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= FEW_HEADS else df


def burst(strings: DataFrame, limit: int = CONTAINER) -> tuple[DataFrame, DataFrame | None, int]:
    """(strings with the depth of their container's head, heads above containers, number of these).

    A string that ends at a head has a depth beyond its end. Heads come with the number and least id of their conversations.
    """

    def heads_of(active: DataFrame, first: int, last: int) -> DataFrame:
        """Nodes at depths first to last - 1 along each string; key is the string's."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for key, seq, conv, n in _rows(batches):
                size = len(seq) // CELL
                if size < first:
                    continue
                parent = node_key(seq[: (first - 1) * CELL]) if first else None
                for d, head in enumerate(node_keys(seq, first, min(last - 1, size)), first):
                    yield key, head, parent, d, text_bytes(seq, d), size - d, n, conv
                    parent = head

        schema = f"key binary, {HEADS}"
        return active.select("key", "seq", "conv_id", "n").mapInArrow(lambda batches: _in_batches(rows(batches), schema), schema)

    active, first, last, done, heads, count = strings, 0, 2, [], [], 0
    while True:
        along = heads_of(active, first, last)
        sums = along.groupBy("head", "parent", "level", "bytes").agg(F.sum("cells").alias("cells"), F.count(F.lit(1)).alias("strings"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"))
        full = materialize(sums.where((F.col("cells") > limit) & (F.col("strings") > 1)).select("head", "parent", "level", "bytes", "n", "conv_id"), "heads")
        n = full.count()
        if not n:
            done.append(active.withColumn("depth", F.lit(first)))
            break
        heads.append(full)
        count += n
        deepest = along.select("key", "head").join(small(full.select("head", "level"), n), "head").groupBy("key").agg((F.max("level") + 1).cast("int").alias("below"))
        placed = materialize(active.join(deepest, "key", "left").withColumn("depth", F.coalesce("below", F.lit(first))).drop("below"), "placed")
        done.append(placed.where(F.col("depth") < last))
        active = placed.where(F.col("depth") == last)
        first, last = last, 2 * last
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, heads) if heads else None, count


class Node:
    __slots__ = ("bytes", "children", "conv", "depth", "ends", "leaves", "n", "saved", "waiting")

    def __init__(self, depth: int, size: int):
        self.depth, self.bytes, self.n, self.conv, self.children, self.leaves, self.saved, self.ends, self.waiting = depth, size, 0, None, 0, 0, 0, None, []

    def add(self, n: int, conv: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None or conv < self.conv else self.conv


def shared_cells(a: bytes, b: bytes, least: int) -> int:
    most = min(len(a), len(b)) // CELL
    if a[: most * CELL] == b[: most * CELL]:
        return most
    while a[least * CELL : (least + 1) * CELL] == b[least * CELL : (least + 1) * CELL]:
        least += 1
    return least


def sweep(rows: Iterator[tuple[bytes, int, bytes, int, int, bytes]]) -> Iterator[tuple]:
    """Sorted (head, depth, seq, conv_id, n, ends) -> nodes; the top of a container lacks its parent's id and has the parent's key and path instead."""
    stack: list[Node] = []
    last_head = last_seq = None

    def close(down_to: int) -> Iterator[tuple]:
        while stack and stack[-1].depth > down_to:
            node = stack.pop()
            leaves = node.leaves if node.children else 1
            saved = node.saved + (node.n - 1) * node.bytes
            for x in node.waiting:
                yield x[0], x[1], node.conv, *x[2:], None, None
            row = (node.conv, node.depth, node.n, node.children, leaves, saved, node.ends)
            if stack:
                up = stack[-1]
                up.add(node.n, node.conv)
                up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
                up.waiting.append(row)
            else:
                path = last_seq[: (node.depth - 1) * CELL] if node.depth else None
                yield *row[:2], None, *row[2:], node_key(path) if node.depth else None, path

    for head, depth, seq, conv, n, ends in rows:
        if head != last_head:
            yield from close(-1)
            stack.append(Node(depth, text_bytes(seq, depth)))
        else:
            yield from close(shared_cells(last_seq, seq, depth))
        for d in range(stack[-1].depth + 1, len(seq) // CELL + 1):
            stack.append(Node(d, text_bytes(seq, d)))
        stack[-1].add(n, conv)
        stack[-1].ends = ends
        last_head, last_seq = head, seq
    yield from close(-1)


def swept(placed: DataFrame) -> DataFrame:
    """Nodes of every container."""
    schema = "head binary, depth bigint, seq binary, conv_id bigint, n bigint, ends binary"

    def containers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for depth, seq, conv, n, ends in _rows(batches):
            if depth * CELL <= len(seq):
                yield node_key(seq[: depth * CELL]), depth, seq, conv, n, ends

    held = placed.select("depth", "seq", "conv_id", "n", "ends").mapInArrow(lambda batches: _in_batches(containers(batches), schema), schema)
    held = held.repartition("head").sortWithinPartitions("head", "seq")
    return materialize(held.mapInArrow(lambda batches: _in_batches(sweep(_rows(batches)), SWEPT), SWEPT), "swept")


def head_nodes(heads: DataFrame, count: int, tops: DataFrame, strings: DataFrame) -> DataFrame:
    """Heads as nodes: sums over the containers and heads below them."""
    few = small(heads, count)
    own = (F.col("n") - 1) * F.col("bytes")
    paths = strings.select("conv_id", "seq").join(few.where("level > 0").drop("parent", "head"), "conv_id")
    paths = paths.select(F.expr(f"substring(seq, 1, cast({CELL} * (level - 1) as int))").alias("path"), F.lit(0).cast("long").alias("leaves"), own.alias("saved"))
    below = tops.select("path", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")).unionByName(paths)
    schema = "head binary, children bigint, leaves bigint, saved bigint"

    def ancestors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for path, leaves, saved in _rows(batches):
            deepest = len(path) // CELL
            for d, head in enumerate(node_keys(path, 0, deepest)):
                yield head, int(d == deepest), leaves, saved

    sums = below.mapInArrow(lambda batches: _in_batches(ancestors(batches), schema), schema).groupBy("head")
    sums = sums.agg(*(F.sum(c).alias(c) for c in ("children", "leaves", "saved")))
    ended = strings.select(F.col("key").alias("head"), "ends").join(small(heads.select("head"), count), "head")
    parents = heads.select(F.col("head").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = heads.join(sums, "head").join(ended, "head", "left").join(parents, "parent", "left")
    return found.select(
        "conv_id", F.col("level").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), (own + F.col("saved")).alias("saved_tokens"), "ends"
    )


def prefix_trie(conversations: DataFrame, limit: int = CONTAINER) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. ``limit``: turns of a container."""
    strings = distinct_strings(rebuild(turn_strings(conversations)))
    placed, heads, count = burst(strings, limit)
    nodes = swept(placed)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    if heads is None:
        found = nodes.select(*columns)
    else:
        tops = nodes.where("parent_head is not null")
        known = heads.select(F.col("head").alias("parent_head"), F.col("conv_id").alias("above"))
        joined = tops.join(small(known, count), "parent_head").withColumn("parent_conv_id", F.col("above"))
        found = nodes.where("parent_head is null").select(*columns).unionByName(joined.select(*columns)).unionByName(head_nodes(heads, count, tops, strings))
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(*columns[:-1], F.coalesce(F.lower(F.hex("ends")), nobody).alias("ends_sha256"))


#: The trie of ``conversations`` in SQL, one row for each prefix of each conversation.
ORACLE = """
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM turns),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS s FROM placed GROUP BY conv_id),
crc AS (SELECT conv_id, s, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, c: list_reduce(list_concat([xor(a, c)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384)))) % 9 AS h FROM own),
rebuilt AS (SELECT a.conv_id, CASE WHEN b.s IS NULL THEN a.s[a.h + 1:] ELSE list_concat(b.s[1:a.h], a.s[a.h + 1:]) END AS s
    FROM crc a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
prefixes AS (SELECT conv_id, d, s[1:d] AS p, len(s) = d AS ends FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(strlen(p[d].text), 0) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM prefixes GROUP BY p, d),
children AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
subtree AS (SELECT p[1:e] AS p, e AS d, sum(saved) AS saved, sum(leaf) AS leaves FROM (
    SELECT n.p, n.saved, (c.n IS NULL)::BIGINT AS leaf, unnest(range(0, n.d + 1)) AS e FROM nodes n LEFT JOIN children c ON c.p = n.p AND c.d = n.d) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, t.leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtree t ON t.p = n.p AND t.d = n.d LEFT JOIN children c ON c.p = n.p AND c.d = n.d LEFT JOIN nodes up ON up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]
"""
