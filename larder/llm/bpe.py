"""Operator 8: byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece of text there is exactly one last token in its encoding. A suffix
automaton over the vocabulary (a trie of token bytes with failure links) lists the tokens that
end at each byte, longest first; the first of them that is compatible with the last token of
the prefix before it is the prefix's last token. Two tokens are compatible if merging their bytes
by rank never joins across their border, which is found by undoing merges from the border outward.
Back-pointers from the full length give the exact ids in time linear in the text.

Ids equal merge order here (a merged token's id is 256 more than its merge's place), which reading
the vocabulary checks. Texts are cut into pieces by the vocabulary's split pattern, and special
strings in texts become their own id, as the tokenizers library does by default. A piece met
again in a task takes its ids from a bounded table of earlier pieces.

Defined results: null text counts as empty, with no ids; one very long piece (no white space) takes
linear time; repeated rows each get their own result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from larder.llm.common import id_and_text, pieces

#: Fixed value: how the vocabulary's byte-level pre-tokenizer cuts text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids are kept per worker, and the longest piece that is kept.
KEPT_PIECES, KEPT_LENGTH = 120_000, 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, the two parts each was merged from, and the suffix automaton."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte, model = byte_alphabet(), spec["model"]
        if spec.get("normalizer") or model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids: dict[str, int] = model["vocab"]
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            if token not in self.special:
                self.bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.pair: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            i = ids[a + b]
            if i != 256 + rank:
                raise ValueError(f"{path}: ids are not in merge order")
            self.pair[ids[a], ids[b]] = i
            self.parts[i] = (ids[a], ids[b])
        self.single = [ids[c] for c, b in sorted(to_byte.items(), key=lambda x: x[1])]
        self._automaton([(self.bytes[i], i) for i in ids.values() if i < 256 + len(model["merges"])])
        self._fits: dict[int, bool] = {}
        self.whole = {self.bytes[i]: i for i in range(256 + len(model["merges"])) if self.encode_piece(self.bytes[i]) == [i]}

    def _automaton(self, tokens: list[tuple[bytes, int]]) -> None:
        """Trie with failure links; ends[s] is the longest token that ends at state s, shorter[s] the state of the next."""
        go: list[dict[int, int]] = [{}]
        token_at = [-1]
        for word, i in tokens:
            s = 0
            for b in word:
                n = go[s].get(b)
                if n is None:
                    n = go[s][b] = len(go)
                    go.append({})
                    token_at.append(-1)
                s = n
            token_at[s] = i
        fail, queue = [0] * len(go), list(go[0].values())
        nearest = [0] * len(go)  # the longest proper suffix state that is a token
        for s in queue:
            nearest[s] = fail[s] if token_at[fail[s]] >= 0 else nearest[fail[s]]
            for b, n in go[s].items():
                f = fail[s]
                while f and b not in go[f]:
                    f = fail[f]
                fail[n] = go[f].get(b, 0)
                queue.append(n)
        self.go, self.fail = go, fail
        self.matches: list[tuple[int, ...]] = [()] * len(go)
        for s in queue:
            here = (token_at[s],) if token_at[s] >= 0 else ()
            self.matches[s] = here + (self.matches[nearest[s]] if nearest[s] else ())

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together ends in a then b: no merge crosses their border.

        Seen from the border outward: undo the later merge of the two tokens there, as long as there
        is one; a join of the pair now at the border that ranks before the merges undone would have
        come first, and so cross it.
        """
        key = a << 32 | b
        got = self._fits.get(key)
        if got is not None:
            return got
        left, right, bound, good = a, b, 1 << 60, True
        while True:
            joined = self.pair.get((left, right))
            if joined is not None and joined < bound:
                good = False
                break
            if left > right:  # the left one was made later; on a tie of ranks the left pair joins first
                inner = self.parts[left][1]
                if inner != left:
                    bound, left = left, inner
                    continue
                bound, inner = right + 1, self.parts[right][0]
                if inner == right:
                    break
                right = inner
            else:
                inner = self.parts[right][0]
                if inner != right:
                    bound, right = right + 1, inner
                    continue
                bound, inner = left, self.parts[left][1]
                if inner == left:
                    break
                left = inner
        if len(self._fits) > 400_000:
            self._fits.clear()
        self._fits[key] = good
        return good

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one piece: last token of every prefix, then back-pointers."""
        go, fail, matches, size, known = self.go, self.fail, self.matches, self.bytes, self._fits
        last: list[int] = []
        state = 0
        for at, b in enumerate(data):
            while state and b not in go[state]:
                state = fail[state]
            state = go[state].get(b, 0)
            for token in matches[state]:
                before = at - len(size[token])
                if before < 0:
                    last.append(token)
                    break
                prior = last[before]
                good = known.get(prior << 32 | token)
                if good or (good is None and self.fits(prior, token)):
                    last.append(token)
                    break
            else:
                raise ValueError("a byte outside the vocabulary")
        out, at = [], len(data)
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(size[token])
        out.reverse()
        return out


class Codec:
    """Whole texts to ids as packed unsigned 32-bit integers, and back."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.vocabulary.special, key=len, reverse=True))) + ")") if self.vocabulary.special else None
        self.kept: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.vocabulary.whole.get(data)
        ids = [whole] if whole is not None else self.vocabulary.encode_piece(data)
        got = np.array(ids, dtype="<u4").tobytes()
        if len(piece) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT_PIECES:
                self.kept.clear()
            self.kept[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, one after another."""
        out: list[bytes] = []
        kept = self.kept
        for i, part in enumerate(self.special.split(text)) if self.special else [(0, text)]:
            if i % 2:
                out.append(np.array([self.vocabulary.special[part]], dtype="<u4").tobytes())
                continue
            for piece in self.pattern.findall(part):
                out.append(kept.get(piece) or self._piece(piece))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        token = self.vocabulary.bytes
        return b"".join([token[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", errors="replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and vocabulary file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 of ids decoded again."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary_path)
        for piece in pieces(batches):
            ids = [c.encode(t or "") for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids])], schema=schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(scan, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), n_tokens and round_trip (the ids decode to the text) for each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("round_trip", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary_path)
        for piece in pieces(batches):
            texts = [t or "" for t in piece.column(1).to_pylist()]
            ids = [c.encode(t) for t in texts]
            sizes = [len(x) // 4 for x in ids]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([piece.column(0), lists, pa.array(sizes, pa.int64()), pa.array([c.decode(x) == t for x, t in zip(ids, texts, strict=True)])], schema=schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(scan, "doc_id bigint, ids array<int>, n_tokens bigint, round_trip boolean")
