"""Operator 10: exact substring deduplication with super-k-mer partitioning.

A window is 20 consecutive words of a document; its minimiser is the least hash among its runs of
a few words. Consecutive windows that share a minimiser travel together to the minimiser's bucket,
in two rounds. First only (minimiser, place) travels, and sorting finds the minimisers that
occur twice; a window whose minimiser occurs once in the corpus has no equal. Then the
super-k-mers of those travel as one packed string each (compressed with a shared dictionary, so equal
strings stay equal). There rows are sorted by (bucket, document, start) and every window that was met
before in that order is removed; comparison is by the words themselves, so counts are exact. The
removed windows are gathered per document and joined back to its text.

Hot buckets, in two ways that change how rows travel and never what is removed. Minimisers that hold ``share`` or more of
the repeated super-k-mers of a sample (so there are 1 / share of them at most) skip the first round, where they would fill one
task. Minimisers of more than ``large`` windows, counted exactly in the first round, and those of the sample, have no
string in a bucket: their windows travel one by one to the bucket of their whole content, and each task first keeps
only the earliest of equal windows, so that a passage found in a third of all documents reaches its bucket
once per task and no bucket holds more than ``large`` different windows.

Defined results: null or empty text has no words; fewer than 20 words make no window; a null
doc_id comes before every other; rows with the same doc_id count as one document, and equal windows
that start at the same place of it remove neither. Rows that share an id are told apart by a 64-bit
digest of their text; rows equal in both are compared once, and each gets the result. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import materialize, pieces, words_of

WINDOW, RUN = 20, 4
#: One in so many documents is looked at for frequent minimisers; hot are those of this share of its super-k-mers whose minimiser was met so often at least (fewer fill
#: no task, and their buckets are counted in the first round).
SAMPLE_ONE_IN, HOT_SHARE, HOT_LEAST = 64, 1e-4, 128
#: Windows of a bucket up to which its strings are compared in it.
LARGE = 1 << 16
#: Texts, of so many characters at most, that train the dictionary of the packed strings (it changes their size only); size of the dictionary.
DICT_DOCS, DICT_CHARS, DICT_BYTES = 400, 4_000, 65_536
#: Hot windows that a task holds at most before it sends them on.
HELD = 50_000
NONE = -(2**63)
#: (document, digest) pairs that a task remembers at most, to leave out rows equal in both early.
MET = 200_000
#: A super-k-mer's span in 64 bits: 50 of the first window, 12 of the number of windows, and the two marks.
COUNT, SHIFT = 1 << 12, 14
#: The minimiser occurs twice inside the run, so that windows may repeat there; the minimiser is hot or large.
AGAIN, BY_CONTENT = 1, 2


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word.encode(), 7)
        return got


_HASH = _Hashes()


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by doubling."""
    got, have = a, 1
    while have < width:
        step = min(have, width - have)
        got = np.minimum(got[: len(got) - step], got[step:])
        have += step
    return got


def run_hashes(words: list[str], run: int = RUN) -> np.ndarray:
    """A hash of every run of words, as signed 64-bit numbers."""
    h = np.fromiter(map(_HASH.__getitem__, words), dtype=np.uint64, count=len(words))
    code = np.zeros(len(h) - run + 1, dtype=np.uint64)
    for i in range(run):
        code = code * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - run + 1 + i]
    code ^= code >> np.uint64(31)
    code *= np.uint64(0xD6E8FEB86659FD93)
    code ^= code >> np.uint64(32)
    return code.view(np.int64)


def super_kmers(words: list[str], window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser: minimiser, first window, number of windows, whether the minimiser occurs twice in the run."""
    if len(words) < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(bool)
    code = run_hashes(words, run)
    m = sliding_min(code, window - run + 1)
    first = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
    n = np.diff(first, append=len(m))
    if n.max() >= COUNT:  # a place holds fewer windows: longer runs (of repeating text) are cut
        parts = [(c, min(COUNT - 1, a + k - c)) for a, k in zip(first.tolist(), n.tolist(), strict=True) for c in range(a, a + k, COUNT - 1)]
        first, n = (np.array(x) for x in zip(*parts, strict=True))
    again = np.zeros(len(first), dtype=bool)
    if len(np.unique(code)) < len(code):
        for i in np.flatnonzero(np.isin(m[first], repeated(code))):
            again[i] = np.count_nonzero(code[first[i] : first[i] + n[i] + window - run] == m[first[i]]) > 1
    return m[first], first, n, again


def repeated(values: np.ndarray) -> np.ndarray:
    """The values that occur twice or more."""
    found, counts = np.unique(values, return_counts=True)
    return found[counts > 1]


class Packer:
    """Packs strings with a shared dictionary; one string always packs to the same bytes."""

    def __init__(self, dictionary: bytes) -> None:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        bare = zstandard.FORMAT_ZSTD1_MAGICLESS
        self.pack = zstandard.ZstdCompressor(dict_data=shared, compression_params=zstandard.ZstdCompressionParameters.from_level(3, format=bare, write_dict_id=False, write_content_size=True)).compress
        self.unpack = zstandard.ZstdDecompressor(dict_data=shared, format=bare).decompress


def train_dictionary(texts: list[str]) -> bytes:
    samples = [" ".join(w[i : i + 28]).encode() for w in map(words_of, texts) for i in range(0, len(w), 28)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if len(samples) > 200 else b""
    except zstandard.ZstdError:  # too little to learn from: strings are packed without one
        return b""


class _Met(set):
    """Whether a task met (document, digest) before; it may forget, so a later step must still bear repeats."""

    def before(self, doc: int, digest: int) -> bool:
        if (doc, digest) in self:
            return True
        if len(self) >= MET:
            self.clear()
        self.add((doc, digest))
        return False


def _packed(df: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, digest, body: the text packed, as it travels to a join."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("body", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packer(dictionary).pack
        for piece in pieces(batches):
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([pack(t.encode()) for t in piece.column(2).to_pylist()], pa.binary())], schema=schema)

    return df.mapInArrow(scan, "doc_id bigint, digest bigint, body binary")


def _hot(df: DataFrame, window: int, run: int, one_in: int, share: float, least: int) -> frozenset[int]:
    """Minimisers that hold ``share`` or more of the super-k-mers, in a sample of documents, whose minimiser was met ``least`` times; 1 / share of them at most."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found = [np.zeros(0, dtype=np.int64), *(super_kmers(words_of(t), window, run)[0] for t in piece.column(2).to_pylist())]
            values, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], names=["m", "n"])

    sample = df.where(F.pmod(F.xxhash64("doc_id", "digest"), F.lit(one_in)) == 0).mapInArrow(scan, "m bigint, n bigint")
    counts = materialize(sample.groupBy("m").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "minimisers")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return frozenset(r.m for r in counts.where(F.col("n") >= share * total).select("m").collect())


def _places(df: DataFrame, hot: frozenset[int], window: int, run: int) -> DataFrame:
    """key, doc_id, digest, span of every super-k-mer; hot ones under a key that spreads them, marked to travel by content."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("span", pa.int64())])
    often = np.array(sorted(hot), dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met()
        for piece in pieces(batches):
            keys, docs, digests, spans = [none], [none], [none], [none]
            for doc, digest, text in zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True):
                if met.before(doc, digest):
                    continue
                m, first, n, again = super_kmers(words_of(text), window, run)
                marks = again * AGAIN
                if len(often):
                    known = np.isin(m, often)
                    m = np.where(known, m ^ (first * 0x9E3779B1 + (doc ^ digest) % 2**40), m)
                    marks = marks | known * BY_CONTENT
                keys.append(m)
                docs.append(np.full(len(m), doc, dtype=np.int64))
                digests.append(np.full(len(m), digest, dtype=np.int64))
                spans.append((first.astype(np.int64) * COUNT + n) * 4 + marks)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, docs, digests, spans)], schema=schema)

    return df.mapInArrow(scan, "key bigint, doc_id bigint, digest bigint, span bigint")


def _shared(places: DataFrame, large: int) -> DataFrame:
    """doc_id, digest, span of super-k-mers whose minimiser occurs twice; those of more than ``large`` windows are marked."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("span", pa.int64())])

    def out(rows: np.ndarray, keep: np.ndarray, marked: np.ndarray | int) -> pa.RecordBatch:
        span = rows[3] | (np.broadcast_to(marked, rows.shape[1:]) * BY_CONTENT)
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (rows[1], rows[2], span)], schema=schema)

    def complete(rows: np.ndarray) -> pa.RecordBatch:
        """Buckets that are all there."""
        key, n = rows[0], (rows[3] >> 2) % COUNT
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1]) if len(key) else np.zeros(0, dtype=np.int64)
        size = np.diff(starts, append=len(key))
        windows = np.add.reduceat(n, starts) if len(key) else n
        return out(rows, (np.repeat(size, size) > 1) | ((rows[3] & 3) > 0), np.repeat(windows > large, size))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), dtype=np.int64)
        over: int | None = None  # the key of a large bucket, whose rows go out as they come
        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            if over is not None:
                others = np.flatnonzero(rows[0] != over)
                n = int(others[0]) if len(others) else rows.shape[1]
                yield out(rows[:, :n], np.ones(n, dtype=bool), 1)
                rows = rows[:, n:]
            if not rows.shape[1]:
                held = rows
                continue
            others = np.flatnonzero(rows[0] != rows[0, -1])
            cut = int(others[-1]) + 1 if len(others) else 0
            yield complete(rows[:, :cut])
            held, over = rows[:, cut:], None
            if ((held[3] >> 2) % COUNT).sum() > large and held.shape[1] > 1:
                over = int(held[0, -1])
                yield out(held, np.ones(held.shape[1], dtype=bool), 1)
                held = held[:, :0]
        yield complete(held)

    return places.repartition("key").sortWithinPartitions("key").mapInArrow(scan, "doc_id bigint, digest bigint, span bigint")


_ROW = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("start", pa.int32()), ("packed", pa.binary())])


def _travelling(df: DataFrame, dictionary: bytes, window: int, run: int) -> DataFrame:
    """The packed super-k-mers at the spans of each document, windows that travel by content, and (packed null) windows known to be removed already.

    ``df``: doc_id, digest, body, spans; of rows equal in doc_id and digest a task sends one.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(dictionary)
        pack, unpack = packer.pack, packer.unpack
        held: dict[str, tuple[int, int, int]] = {}
        met = _Met()
        of_content = lambda w: xxhash.xxh64_intdigest(w.encode(), 9) - 2**63

        def sent() -> list[tuple]:
            rows = [(of_content(w), d, g, s, pack(w.encode())) for w, (d, s, g) in held.items()]
            held.clear()
            return rows

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*rows, strict=True) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ROW, strict=True)], schema=_ROW)

        for piece in pieces(batches, limit=1_000_000, rows=500, text="body"):
            rows: list[tuple] = []
            for doc, digest, body, spans in zip(*(piece.column(i).to_pylist() for i in range(4)), strict=True):
                if met.before(doc, digest):
                    continue
                words = words_of(unpack(body).decode())
                whole = " ".join(words)
                at = [0, *accumulate(len(w) + 1 for w in words)]
                code = run_hashes(words, run)
                firsts = np.array(spans, dtype=np.int64) >> SHIFT
                least = sliding_min(code, window - run + 1)[firsts].tolist()
                for span, first, m in zip(spans, firsts.tolist(), least, strict=True):
                    over = first + (span >> 2) % COUNT
                    if not span & BY_CONTENT:
                        if span & AGAIN:
                            inside: set[str] = set()
                            # windows may repeat inside the string: those are known to be removed
                            for s in range(first, over):
                                w = whole[at[s] : at[s + window] - 1]
                                if w in inside:
                                    rows.append((doc ^ s * 0x9E3779B1, doc, digest, s, None))
                                inside.add(w)
                        rows.append((m, doc, digest, first, pack(whole[at[first] : at[over + window - 1] - 1].encode())))
                        continue
                    for s in range(first, over):
                        w, mine = whole[at[s] : at[s + window] - 1], (doc, s, digest)
                        other = held.setdefault(w, mine)
                        if other is mine:
                            continue
                        if other[:2] == mine[:2]:  # rows that share a doc_id: neither is earlier
                            rows.append((of_content(w), doc, digest, s, pack(w.encode())))
                            continue
                        if mine < other:
                            held[w], mine = mine, other
                        rows.append((mine[0] ^ mine[1] * 0x9E3779B1, mine[0], mine[2], mine[1], None))
                    if len(held) > HELD:
                        rows += sent()
                if len(rows) > 10_000:
                    yield out(rows)
                    rows = []
            yield out(rows)
        yield out(sent())

    return df.mapInArrow(scan, "key bigint, doc_id bigint, digest bigint, start int, packed binary")


def _removed(rows: DataFrame, dictionary: bytes, window: int) -> DataFrame:
    """doc_id, digest, start, n: n windows of a document from start on that an earlier one equals."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = Packer(dictionary).unpack
        key, alone = None, None
        seen: dict[str, tuple[int, int]] = {}
        # texts whose window inside a string is the earliest so far: a later string of the same doc_id may hold it earlier
        inner: dict[str, list[int]] = {}

        def visit(row: list, found: list[tuple]) -> None:
            doc, digest, start, packed = row
            text = unpack(packed).decode()
            at = [0, *accumulate(len(w) + 1 for w in text.split(" "))]
            for i in range(len(at) - window):
                w, here = text[at[i] : at[i + window] - 1], (doc, start + i)
                first = seen.setdefault(w, here)
                if first < here:
                    if found and found[-1][:2] == (doc, digest) and found[-1][2] + found[-1][3] == start + i:
                        found[-1] = (doc, digest, found[-1][2], found[-1][3] + 1)
                    else:
                        found.append((doc, digest, start + i, 1))
                    continue
                if here < first:
                    seen[w] = here
                    found += [(doc, d, first[1], 1) for d in inner.pop(w)]
                if i:
                    inner.setdefault(w, []).append(digest)

        for batch in batches:
            found: list[tuple] = []
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[3] is None:
                    found.append((row[0], row[1], row[2], 1))
                elif k != key:
                    key, alone = k, row
                    seen.clear()
                    inner.clear()
                else:
                    if alone is not None:
                        visit(alone, found)
                        alone = None
                    visit(row, found)
            cols = zip(*found, strict=True) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return rows.repartition("key").sortWithinPartitions("key", "doc_id", "start", "digest").mapInArrow(scan, "doc_id bigint, digest bigint, start int, n int")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, run: int = RUN, one_in: int = SAMPLE_ONE_IN, share: float = HOT_SHARE, least: int = HOT_LEAST, large: int = LARGE) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the words that stay, one space apart)."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    df = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NONE)).alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    hot = _hot(df, window, run, one_in, share, least)
    few = df.where((F.pmod(F.xxhash64("digest"), F.lit(one_in)) == 0) & (F.length("text") <= DICT_CHARS)).select("text").limit(DICT_DOCS)
    dictionary = train_dictionary([r.text for r in few.collect()])
    key, packed = ["doc_id", "digest"], _packed(df, dictionary)
    spans = _shared(_places(df, hot, window, run), large).groupBy(*key).agg(F.collect_set("span").alias("spans"))
    rows = packed.join(spans, key).select(*key, "body", "spans")
    removed = _removed(_travelling(rows, dictionary, window, run), dictionary, window)
    by_doc = removed.groupBy(*key).agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = Packer(dictionary).unpack
        for piece in pieces(batches, limit=1_000_000, rows=500, text="body"):
            rows = []
            for doc, body, gone in zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True):
                words = words_of(unpack(body).decode())
                n = len(words)
                if gone:
                    edge = np.zeros(n + 1, dtype=np.int64)
                    starts = np.array([(s["start"], s["n"]) for s in gone], dtype=np.int64)
                    np.add.at(edge, starts[:, 0], 1)
                    np.add.at(edge, starts.sum(axis=1) + window - 1, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:n] == 0)]
                rows.append((None if doc == NONE else doc, n, n - len(words), " ".join(words)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    both = packed.join(by_doc, key, "left").select("doc_id", "body", "gone")
    return both.mapInArrow(scan, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
stay AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN stay USING (doc_id)
"""
