"""Operator 2: benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts and patterns are sequences of words. Patterns of one length share a table: the SHIFT table
gives, for the block of two words under the window's end, how far the window may jump without
passing an occurrence; where it gives zero, the block's hash bucket lists the patterns that end
so, and a direct comparison of all words confirms the occurrence. Words outside the benchmark
get one code that occurs in no pattern, so unrelated text is crossed in jumps of almost a window.

The benchmark's size is checked. Long items are cut into pieces that overlap by a window less one word, which
have the same windows; equal pieces become one; and pieces are searched in blocks of about ``block_chars``
characters. One block is at the driver and in the tasks at a time: each is a pass of its own over the documents whose
hits are written to the shared folder before the next block is read, so that what a task holds is
bounded however large the benchmark becomes. A benchmark of one block, as most are, takes one pass.

Defined results: null or empty text has no words; items without words never occur; an item with a
null id marks words but is not counted or listed; items that share an id count once; repeated rows
each get their own result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import ascii_lower, id_and_text, materialize, pieces

#: Words of a window.
WINDOW = 10
#: Characters of benchmark text searched in one pass, and words of a piece of a long item.
BLOCK_CHARS, PIECE_WORDS = 1_000_000, 2_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bench_words(text: str | None) -> list[str]:
    return _WORD.findall(ascii_lower(text)) if text else []


class WuManber:
    """Tables for one block of items: by pattern length, SHIFT and suffix-hash buckets."""

    def __init__(self, pieces: list[tuple[list[str], str]], window: int = WINDOW) -> None:
        """``pieces``: ids of the items that hold it, words apart by a space."""
        self.vocabulary: dict[str, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for ids, text in pieces:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text.split(" ")]
            n = min(window, len(words))
            for i in range(len(words) - n + 1):
                by_length[n][tuple(words[i : i + n])].update(ids)
        self.base = len(self.vocabulary) + 1
        self.groups = []
        for n, patterns in sorted(by_length.items()):
            shift: dict[int, int] = {}
            bucket: dict[int, list[tuple[tuple[int, ...], set[str]]]] = defaultdict(list)
            for words, ids in patterns.items():
                if n == 1:
                    bucket[words[0]].append((words, ids))
                    continue
                for j in range(1, n):
                    code = words[j - 1] * self.base + words[j]
                    shift[code] = min(shift.get(code, n - 1), n - 1 - j)
                bucket[words[-2] * self.base + words[-1]].append((words, ids))
            self.groups.append((n, shift, dict(bucket)))

    def search(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [start, end) runs of hit words, and the items with an occurrence."""
        codes = list(map(self.vocabulary.get, words, [0] * len(words))) if words else []
        runs: list[tuple[int, int]] = []
        found: set[str] = set()
        base, total = self.base, len(codes)
        if not any(codes):
            return runs, found
        for n, shift, bucket in self.groups:
            if n == 1:
                for i, c in enumerate(codes):
                    if c in bucket:
                        runs.append((i, i + 1))
                        found |= bucket[c][0][1]
                continue
            at, far, step = n - 1, n - 1, shift.get
            while at < total:
                block = codes[at - 1] * base + codes[at]
                jump = step(block, far)
                if jump:
                    at += jump
                    continue
                start = at - n + 1
                seen = tuple(codes[start : at + 1])
                for pattern, ids in bucket.get(block, ()):
                    if pattern == seen:
                        runs.append((start, at + 1))
                        found |= ids
                at += 1
        return merged(runs), found


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def pieces_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", piece_words: int = PIECE_WORDS, window: int = WINDOW) -> DataFrame:
    """piece (words apart by a space) and items (ids that hold it, none for null ids) of all items with words."""
    schema = pa.schema([("item", pa.string()), ("piece", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            items, found = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = bench_words(text)
                for at in range(0, max(1, len(words) - window + 1) if words else 0, piece_words):
                    items.append(item)
                    found.append(" ".join(words[at : at + piece_words + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(found, pa.string())], schema=schema)

    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(cut, "item string, piece string").groupBy("piece").agg(F.collect_set("item").alias("items"))


def blocks_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, piece_words: int = PIECE_WORDS) -> Iterator[WuManber]:
    """Tables of the benchmark, one block at a time; one (of nothing) where it is empty."""
    found = materialize(pieces_of(benchmark, item_col, text_col, piece_words), "benchmark")
    size = found.agg(F.sum(F.length("piece"))).first()[0] or 0
    n = max(1, -(-size // block_chars))
    for k in range(n):
        yield WuManber([(r["items"], r.piece) for r in found.where(F.pmod(F.xxhash64("piece"), F.lit(n)) == k).collect()])


_RUNS, _ITEMS = pa.list_(pa.int32()), pa.list_(pa.string())


def _hits(keyed: DataFrame, tables: WuManber) -> DataFrame:
    """doc_id, digest, runs, items of the texts with hits. ``keyed``: doc_id, digest, text."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("runs", _RUNS), ("found", _ITEMS)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            rows = []
            for doc_id, digest, text in zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True):
                runs, found = tables.search(bench_words(text))
                if runs:
                    rows.append((doc_id, digest, [x for r in runs for x in r], sorted(found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 4, schema, strict=True)], schema=schema)

    return keyed.mapInArrow(scan, "doc_id bigint, digest bigint, runs array<int>, found array<string>")


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", _ITEMS), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("runs", _RUNS)])
_RESULT_SQL = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items array<string>, items_sha256 string, contaminated boolean, runs array<int>"


def _result(rows: list[tuple[int | None, int, list[tuple[int, int]], set[str]]]) -> pa.RecordBatch:
    """From doc_id, number of words, merged runs and items."""
    out = []
    for doc_id, n_words, runs, found in rows:
        items, hit = sorted(found), sum(e - s for s, e in runs)
        out.append((doc_id, n_words, hit, len(items), items, hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0, [x for r in runs for x in r]))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(_RESULT), _RESULT, strict=True)], schema=_RESULT)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_chars: int = BLOCK_CHARS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items (sorted), items_sha256, contaminated, runs."""
    blocks = blocks_of(benchmark, item_col, "text", block_chars, piece_words)
    tables, more = next(blocks), next(blocks, None)
    df = id_and_text(docs, id_col, text_col)
    if more is None:

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches):
                words = list(map(bench_words, piece.column(1).to_pylist()))
                yield _result([(doc_id, len(w), *tables.search(w)) for doc_id, w in zip(piece.column(0).to_pylist(), words, strict=True)])

        return df.mapInArrow(scan, _RESULT_SQL)
    # several blocks: hits of each, which a text's digest ties to its row; rows equal in id and text have equal hits
    keyed = df.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    found = materialize(_hits(keyed, tables), "hits")
    while more is not None:
        found = found.unionByName(materialize(_hits(keyed, more), "hits"))
        more = next(blocks, None)
    per = found.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("runs", "found")).alias("hits")).withColumnsRenamed({"doc_id": "hit_id", "digest": "hit_digest"})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([len(bench_words(t)) for t in piece.column(2).to_pylist()], pa.int64())], names=["doc_id", "digest", "n_words"])

    thin = keyed.mapInArrow(count, "doc_id bigint, digest bigint, n_words bigint")
    both = thin.join(per, thin.doc_id.eqNullSafe(per.hit_id) & (thin.digest == per.hit_digest), "left").select("doc_id", "n_words", "hits")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n_words, hits in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                runs = merged([x for h in hits or () for x in zip(h["runs"][::2], h["runs"][1::2], strict=True)])
                rows.append((doc_id, n_words, runs, {x for h in hits or () for x in h["found"]}))
            yield _result(rows)

    return both.mapInArrow(together, _RESULT_SQL)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_chars: int = BLOCK_CHARS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """The rows, all columns unchanged, whose text holds no occurrence of a benchmark window; a pass for each block, on what the one before kept."""
    at = docs.columns.index(text_col)

    def clean(df: DataFrame, tables: WuManber) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, text=text_col):
                yield piece.filter(pa.array([not tables.search(bench_words(t))[0] for t in piece.column(at).to_pylist()], pa.bool_()))

        return df.mapInArrow(scan, df.schema)

    blocks = blocks_of(benchmark, block_chars=block_chars, piece_words=piece_words)
    out = clean(docs, next(blocks))
    for tables in blocks:
        out = clean(materialize(out, "clean"), tables)
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS s
      FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM p),
dw AS (SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT rid, i, dw.n, item FROM dw JOIN p ON dw.s = p.s AND dw.n = p.n),
pos AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM hits) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
