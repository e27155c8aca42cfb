"""Operator 12: packing by concatenating and cutting, with two-pass prefix sums.

The documents' tokens stand behind one another in the order of input splits and rows, and every ``width`` tokens make a
sequence, so only the last sequence is padded. First pass: a task encodes its rows, counts tokens from its own start and
writes both; the totals of tasks (one row each) become offsets by a running sum. Second pass: the written rows are read with
their task's offset and cut at multiples of ``width``; neither pass shuffles a token. Tokens are numbered once, in the
written table, so a task that runs again cannot renumber them.

Pieces are the boundary records: which tokens of which document stand where in which sequence. ``sequences`` turns them
into rows of ids: windows that lie within one batch leave at once, and only those that a batch begins or ends in are shuffled.

White space separates tokens in the vocabulary this is made for, so a text is encoded word by word and a worker
keeps the ids of up to ``MEMO`` words; ``by_words=False`` gives whole texts to the library, for vocabularies that join words.

Defined results: null text is empty, its document is the end id alone; repeated rows are documents of their own; a null id stays null;
an empty table gives no piece. The last sequence is padded to ``width`` unless its length is a power of two; ``sequence_tokens``
is a sequence's length with padding. Other columns are ignored.
"""

from __future__ import annotations

import functools
import gc
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import id_and_text, materialize, pieces

WIDTH = 2048
#: Words whose ids a worker keeps, and their length in code points at most.
MEMO, MEMO_CHARS = 500_000, 40
#: End of the tokens that end a word, and marks that often stand behind one.
WORD_END, MARKS = "</w>", ",.;:!?"
#: Totals (16 bytes each, one per input split) that are broadcast at most.
MOST_SPLITS = 2_000_000

ENCODED = "split int, before bigint, doc_id bigint, doc_tokens bigint, ids binary"
CUT = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def library(path: str):
    """The tokenizer of a file, without truncation or padding, and its encoding of texts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t, lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def _as_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


class WordEncoder:
    """Texts -> ids, word by word, for vocabularies in which no token holds or crosses white space.

    Such a vocabulary ends every run of letters, and every run of marks, with a token of its own kind (word end), so words of letters, with
    or without a mark behind them, are encoded many at a time and told apart by their last tokens. Each distinct word of
    a batch is looked up once. A full memo becomes the old one, whose words come back as they are met.
    """

    def __init__(self, path: str, memo: int = MEMO):
        tokenizer, self.encode = library(path)
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.limit, self.memo, self.old = memo, {}, {}

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids."""
        plain = [w for w in words if w.isalpha()]
        marked = [w for w in words if w[-1] in MARKS and w[:-1].isalpha()]
        known = {*plain, *marked}
        other = [w for w in words if w not in known]
        for some, ends_each in ((plain, 1), (marked, 2)):
            groups = [some[i : i + 200] for i in range(0, len(some), 200)]
            for group, ids in zip(groups, self.encode([" ".join(g) for g in groups]), strict=True):
                ids = np.asarray(ids, dtype="<u4")
                ends = (np.flatnonzero(self.ends[ids])[ends_each - 1 :: ends_each] + 1) * 4
                if np.count_nonzero(self.ends[ids]) != ends_each * len(group):  # a letter that folds to more than letters
                    other += group
                    continue
                data, begin = ids.tobytes(), 0
                for w, end in zip(group, ends.tolist(), strict=True):
                    yield w, data[begin:end]
                    begin = end
        yield from zip(other, map(_as_bytes, self.encode(other)), strict=True)

    def look_up(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.memo) > self.limit:
            self.memo, self.old = {}, self.memo
        found = list(map(self.memo.get, words))
        lacking = [k for k, ids in enumerate(found) if ids is None]
        new = []
        for k in lacking:
            if (ids := self.old.get(words[k])) is None:
                new.append(words[k])
            else:
                found[k] = self.memo[words[k]] = ids
        made = dict(self.encode_words(new))
        self.memo.update(made if max(map(len, new), default=0) <= MEMO_CHARS else {w: i for w, i in made.items() if len(w) <= MEMO_CHARS})
        for k in lacking:
            if found[k] is None:
                found[k] = made[words[k]]
        return found

    def __call__(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each text's ids), with ``end`` behind each text."""
        split = pa.compute.ascii_split_whitespace(pa.compute.fill_null(texts, ""))
        stops = np.asarray(split.offsets)[1:] - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        blank = words.index("") if "" in words else None
        found = self.look_up([w for w in words if w])
        if blank is not None:
            found.insert(blank, b"")
        found.append(end)
        kind = np.int32 if texts.nbytes < 500_000_000 else np.int64  # at most a token for each byte and text
        sizes = np.fromiter(map(len, found), dtype=kind, count=len(found)) // 4
        pool = np.frombuffer(b"".join(found), dtype="<u4")
        place = np.insert(np.asarray(coded.indices), stops, len(found) - 1)  # the end stands behind each text's words
        own = sizes[place]
        shift = (np.cumsum(sizes, dtype=kind) - sizes)[place] - (np.cumsum(own, dtype=kind) - own)
        at = np.arange(own.sum(), dtype=kind)
        at += np.repeat(shift, own)
        ids = pool[at]
        first = np.concatenate([[0], stops[:-1] + np.arange(1, len(stops))]) if len(stops) else np.zeros(0, dtype=int)
        return ids, (np.add.reduceat(own, first) if len(first) else own).astype(np.int64)


@functools.lru_cache(maxsize=1)
def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process, which keeps its words from task to task."""
    return WordEncoder(path)


def encode(docs: DataFrame, tokenizer_path: str, end_id: int, by_words: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass: ids of every document with ``end_id`` behind them, and the tokens before it in its input split; written and read again."""
    end = _as_bytes([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, before = TaskContext.get().partitionId(), 0
        _, whole = (None, None) if by_words else library(tokenizer_path)
        for piece in pieces(batches, limit=4_000_000, rows=8_000):
            if by_words:
                gc.disable()  # many words and no cycles among them
                ids, sizes = worker_encoder(tokenizer_path)(piece.column(1), end)
                gc.enable()
            else:
                lists = [[*i, end_id] for i in whole([t or "" for t in piece.column(1).to_pylist()])]
                ids, sizes = np.array([i for own in lists for i in own], dtype="<u4"), np.array([len(own) for own in lists], dtype=np.int64)
            ends = before + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sizes), split, dtype=np.int32)), pa.array(ends - sizes), piece.column(0), pa.array(sizes), binaries(ids.tobytes(), sizes * 4)],
                names=["split", "before", "doc_id", "doc_tokens", "ids"],
            )
            before = int(ends[-1])

    return materialize(id_and_text(docs, id_col, text_col).mapInArrow(run, ENCODED), "encoded")


def binaries(data: bytes, sizes: np.ndarray) -> pa.Array:
    """A binary column of consecutive parts of ``data``."""
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).cast(pa.binary())


def cut_batch(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """Rows (at, doc_id, doc_tokens, ids) -> pieces: the same ids with more boundaries between them."""
    at, size = np.asarray(batch.column(0)), np.asarray(batch.column(2))
    ids = batch.column(3)
    first, last = at // width, (at + size - 1) // width
    n = last - first + 1
    row = np.repeat(np.arange(len(at)), n)
    sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.maximum(at[row], sequence * width)
    length = np.minimum((at + size)[row], (sequence + 1) * width) - begin
    data = b"".join(ids.to_pylist())
    parts = binaries(data, length * 4)
    columns = [batch.column(1).take(pa.array(row)), begin - at[row], length, parts, size[row], sequence, begin - sequence * width]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, width: int = WIDTH, by_words: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian), doc_tokens, sequence_id, offset, sequence_tokens."""
    encoded = encode(docs, tokenizer_path, end_id, by_words, id_col, text_col)
    totals = materialize(encoded.groupBy("split").agg(F.sum("doc_tokens").alias("total")), "totals")
    size = totals.agg(F.count(F.lit(1)).alias("splits"), F.coalesce(F.sum("total"), F.lit(0)).alias("tokens")).first()
    #: One row per input split meets here, never rows of documents.
    offsets = totals.select("split", (F.sum("total").over(Window.orderBy("split")) - F.col("total")).alias("offset"))
    placed = encoded.join(F.broadcast(offsets) if size.splits <= MOST_SPLITS else offsets, "split")
    placed = placed.select((F.col("offset") + F.col("before")).alias("at"), "doc_id", "doc_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=16_000_000, text="ids"):
            yield cut_batch(piece, width)

    rest = size.tokens % width
    last = rest if rest and not rest & (rest - 1) else width
    ends_short = F.col("sequence_id") == (size.tokens // width)
    return placed.mapInArrow(run, CUT).withColumn("sequence_tokens", F.when(ends_short, F.lit(last)).otherwise(F.lit(width)).cast("long"))


def sequences(packed: DataFrame, width: int = WIDTH) -> DataFrame:
    """sequence_id, ids, n_tokens: the pieces of ``pack`` as rows of at most ``width`` ids, without padding.

    A batch joins what it holds of each sequence; whole sequences are done, the rest meet by sequence, of which none has more than ``width`` ids.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list[tuple[int, bytes]]] = {}
            for s, o, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.setdefault(s, []).append((o, i))
            names, offsets, parts = [], [], []
            for s, own in found.items():
                own.sort()
                for k, (o, i) in enumerate(own):  # neighbours in the sequence become one part
                    if k and offsets[-1] + len(parts[-1]) // 4 == o:
                        parts[-1] += i
                    else:
                        names.append(s)
                        offsets.append(o)
                        parts.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(offsets, pa.int64()), pa.array(parts, pa.binary())], names=["sequence_id", "offset", "ids"])

    parts = materialize(packed.select("sequence_id", "offset", "ids").mapInArrow(join, "sequence_id bigint, offset bigint, ids binary"), "parts")
    full = F.octet_length("ids") == 4 * width
    met = parts.where(~full).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    met = met.select("sequence_id", F.aggregate(F.transform("p", lambda x: x["ids"]), F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))
    return parts.where(full).select("sequence_id", "ids").unionByName(met).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
