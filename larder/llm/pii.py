"""Operator 1: personal data by base patterns and a skip-chain conditional random field.

Base patterns give exact spans (code points, end exclusive). On top of them a skip-chain CRF labels the
tokens of every text that holds a digit or an ``@``. All tokens form the chain; one without a digit and
without an ``@`` can be no entity of any kind, so its label is fixed and its chain potential goes to its
neighbours' node potentials, which is exact. Distant tokens of one text with the same or a similar form
(letters folded and outer marks dropped; the last seven digits; the local part of an address) share skip
potentials through one hub per text and form, so edges stay linear and no repeat is more than two edges
from another. Loopy sum-product message passing goes on until messages stand still. Tokens under base
spans have a known label, which travels to their repeats. Runs of tokens that the CRF labels as an
entity and that touch no base span are added where their format allows that kind; base spans always stay.

All weights, those of skip edges too, are learned: from a bounded sample of the corpus labelled by the
base patterns, and from the same texts with an entity mentioned again in a form that the patterns miss,
and with other numbers beside it, labelled by construction (``mentioned_again``).

Defined results: null text counts as empty; empty text has no spans and the digest of the empty
string; repeated rows each get their own result; equal tokens of one text get one verdict up to what
stands beside them; other columns are ignored. Work per text is linear in its length, also for one
very long run of digits or letters; tokens of any length are nodes.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import id_and_text, pieces

KINDS = ("email", "ip", "card", "phone")
LABELS = ("o", *KINDS)
#: Hashed feature space of the CRF's node potentials.
DIM = 1 << 15
#: About so many distinct texts with candidates fit the CRF.
TRAIN_DOCS = 1500
#: Longest text used for fitting. Longer ones are not learned from, which bounds what the driver gets; they are searched like any other.
TRAIN_CHARS = 20_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D\"'<>{}\[\]|=;,&?/\\]+")
_OUTER = ".,;:!?()[]\"'<>"
_HINT = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each ``@``: the local part is the run of its characters that ends there."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in the order of KINDS, then start."""
    if not text or not _HINT.search(text):
        return []
    out = [(0, s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


# ---- the conditional random field -------------------------------------------------------------


def _bucket(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % DIM


#: Features of a token.
FEATURES = 14
#: Edges whose messages are computed at once.
EDGES = 100_000


def tokens_in_context(text: str) -> Iterator[tuple[int, int, int, str, list[str]]]:
    """Tokens with a digit or an @: place among all tokens, start, end, token, and the two whole tokens before and after it."""
    around: deque[tuple[int, int, str]] = deque([(0, 0, "^"), (0, 0, "^")], maxlen=5)
    place = -3
    for start, end, token in chain(((*m.span(), m[0]) for m in _TOKEN.finditer(text)), [(0, 0, "$")] * 2):
        around.append((start, end, token))
        place += 1
        if len(around) == 5 and _HINT.search(around[2][2]):
            yield place, *around[2], [around[i][2] for i in (0, 1, 3, 4)]


class Graph:
    """Candidate tokens of many texts, their features, chain edges between them and their hubs."""

    def __init__(self) -> None:
        self.doc: list[int] = []
        self.span: list[tuple[int, int]] = []
        #: Hashed features, FEATURES of them for each token, one after another.
        self.features = array("i")
        self.chain: list[tuple[int, int]] = []
        #: Neighbours of each token in the chain whose label is fixed: tokens that can be no entity, and the ends of the text.
        self.fixed: list[int] = []
        #: (token, hub), hubs numbered from 0 over all texts.
        self.ties: list[tuple[int, int]] = []
        self.hubs = 0
        self._cache: dict[str, int] = {}

    def _id(self, name: str) -> int:
        got = self._cache.get(name)
        if got is None:
            if len(self._cache) > 200_000:
                self._cache.clear()
            got = self._cache[name] = _bucket(name)
        return got

    def add(self, doc: int, text: str) -> None:
        hubs: dict[str, int] = {}
        last = -2
        for place, start, end, token, (left2, left, right, right2) in tokens_in_context(text):
            node, digits = len(self.doc), _NOT_DIGIT.sub("", token)
            self.doc.append(doc)
            self.span.append((start, end))
            shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", token))
            names = [
                "bias", f"shape={shape}", f"digits={min(len(digits), 20)}", f"at={'@' in token}", f"dots={min(token.count('.'), 5)}", f"plus={token[0] == '+'}", f"paren={token[0] == '('}", f"dash={min(token.count('-'), 4)}",
                f"luhn={12 < len(digits) < 20 and luhn(digits)}", f"alpha={bool(re.search('[^\\W0-9_]', token))}", f"left={left.lower()}", f"right={right.lower()}", f"left2={left2.lower()}", f"right2={right2.lower()}",
            ]
            self.features.extend([self._id(x) for x in names])
            self.fixed.append(2)
            if place == last + 1:
                self.chain.append((node - 1, node))
                self.fixed[node - 1] -= 1
                self.fixed[node] -= 1
            last = place
            folded = token.strip(_OUTER).lower()
            keys = {f"form {folded}"}
            if len(digits) >= 7:
                keys.add(f"digits {digits[-7:]}")
            if "@" in folded:
                keys.add(f"local {folded[: folded.index('@')]}")
            self.ties += [(node, hubs.setdefault(k, self.hubs + len(hubs))) for k in sorted(keys)]
        self.hubs += len(hubs)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Features (a row per token), chain edges, ties to hubs of two tokens or more, number of fixed neighbours."""
        ties = np.array(self.ties, dtype=np.int64).reshape(-1, 2)
        ties = ties[np.bincount(ties[:, 1], minlength=self.hubs)[ties[:, 1]] > 1]
        return np.array(self.features, dtype=np.int32).reshape(len(self.doc), FEATURES), np.array(self.chain, dtype=np.int64).reshape(-1, 2), ties, np.array(self.fixed, dtype=float)


def base_labels(graph: Graph, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """The kind of the span that covers each candidate token, 0 where none does."""
    out = np.zeros(len(graph.doc), dtype=np.int64)
    rank = {doc: sorted((s, e, k) for k, s, e in spans[doc]) for doc in set(graph.doc)}
    place: dict[int, int] = dict.fromkeys(rank, 0)
    for i, (doc, (start, end)) in enumerate(zip(graph.doc, graph.span, strict=True)):
        found, at = rank[doc], place[doc]
        while at < len(found) and found[at][1] <= start:  # tokens come in order, so what ends before one ends before the next
            at += 1
        place[doc] = at
        kinds, k = [], at
        while k < len(found) and found[k][0] < end:
            kinds += [found[k][2]] if start < found[k][1] else []
            k += 1
        out[i] = min(kinds) + 1 if kinds else 0
    return out


def mentioned_again(text: str, spans: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]] | None:
    """The text with its entities mentioned again as the patterns miss them, and other numbers beside; all its spans.

    Words of the text itself stand around both, so that what stands beside a mention says nothing of it.
    Phone numbers lose their country code, addresses the end of their domain, cards get dots. None where the text has no entity.
    """
    entities = list(dict.fromkeys((k, text[s:e]) for k, s, e in spans if k != 1))
    if not entities:
        return None
    r = random.Random(zlib.crc32(text.encode()))
    words = [w for w in text.split() if not _HINT.search(w)] or ["and"]
    found: list[tuple[int | None, str]] = []
    for kind, value in entities:
        digits = _NOT_DIGIT.sub("", value)
        if kind == 0:
            again = [value.split("@")[0] + "@" + value.split("@")[1].split(".")[0]]
        elif kind == 2:
            again = [".".join(digits[i : i + 4] for i in range(0, len(digits), 4))]
        else:
            again = [f"{digits[-7:-4]}-{digits[-4:]}", f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}", digits[-7:], f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}"]
        found += [(kind, x) for x in r.sample(again, min(2, len(again)))]
    year, n = r.randint(1900, 2040), r.randint(2, 9)
    others = [f"{year}-{year + n}", f"{r.randint(100, 400)}-{r.randint(1000, 4000)}", str(year), f"{year}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{n}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}", f"#{r.randint(1000, 9_999_999)}", f"{r.randint(1, 99)},{r.randint(100, 999)},{r.randint(100, 999)}", str(r.randint(10**6, 10**9)), f"@{r.choice(words)[:9]}", f"{n}%"]
    found += [(None, x) for x in others for _ in range(r.choice([1, 2]))]
    r.shuffle(found)
    out, at, more = [text], len(text), []
    for kind, value in found:
        lead = " " + " ".join(r.choice(words) for _ in range(r.randint(1, 6))) + " "
        out += [lead, value]
        at += len(lead)
        if kind is not None:
            more.append((kind, at, at + len(value)))
        at += len(value)
    return "".join(out), [*spans, *more]


def fit_crf(texts: list[str], rounds: int = 120, rate: float = 0.3, l2: float = 1e-3) -> dict[str, np.ndarray]:
    """Pseudo-likelihood fit: spans are the labels, the labels of neighbours and of other tokens of a hub are given.

    In the texts as they are, unlabelled tokens that share a hub with a labelled one are left out, since they may be the
    very entities that the base patterns miss.
    """
    n = len(LABELS)
    spans = [base_spans(t) for t in texts]
    again = [x for t, s in zip(texts, spans, strict=True) if (x := mentioned_again(t, s))]
    graph = Graph()
    for i, t in enumerate([*texts, *(t for t, _ in again)]):
        graph.add(i, t)
    x, edges, ties, fixed = graph.arrays()
    y = base_labels(graph, [*spans, *(s for _, s in again)])
    weight, pair = np.zeros((DIM, n)), np.zeros((2, n, n))
    if not len(y):
        weight[:, 0] = 0.5
        return {"weight": weight, "pair": pair}
    # what the other tokens of a hub say: their most frequent kind, o where none has any
    counts = np.zeros((graph.hubs, n))
    np.add.at(counts, (ties[:, 1], y[ties[:, 0]]), 1.0)
    others = counts[ties[:, 1]]
    others[np.arange(len(ties)), y[ties[:, 0]]] -= 1
    said = np.where(others[:, 1:].any(axis=1), others[:, 1:].argmax(axis=1) + 1, 0)
    around = np.zeros((len(y), 2 * n))
    around[:, 0] = fixed
    for a, b in ((0, 1), (1, 0)):
        np.add.at(around, (edges[:, a], y[edges[:, b]]), 1.0)
    np.add.at(around, (ties[:, 0], n + said), 1.0)
    use = np.ones(len(y), dtype=bool)
    missed = ties[(said > 0) & (y[ties[:, 0]] == 0), 0]
    use[missed[np.array(graph.doc)[missed] < len(texts)]] = False
    x, y, around = x[use], y[use], around[use]
    target = np.eye(n)[y]
    cells = (x[:, :, None] * n + np.arange(n)).reshape(-1)
    across, width = np.zeros((2 * n, n)), x.shape[1]
    # a step per weight that shrinks with the slopes it has met, as features differ much in how often they occur
    met, met_across = np.full_like(weight, 1e-8), np.full_like(across, 1e-8)
    for _ in range(rounds):
        z = weight[x].sum(axis=1) + around @ across
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - target) / max(1, len(y))
        flat = np.bincount(cells, np.broadcast_to(d[:, None, :], (len(d), width, n)).reshape(-1), DIM * n).reshape(DIM, n) + l2 * weight
        slope = around.T @ d + l2 * across
        met += flat * flat
        met_across += slope * slope
        weight -= rate * flat / np.sqrt(met)
        across -= rate * slope / np.sqrt(met_across)
    pair = across.reshape(2, n, n)
    return {"weight": weight, "pair": (pair + pair.transpose(0, 2, 1)) / 2}  # an edge has no direction


def marginals(model: dict[str, np.ndarray], unary: np.ndarray, e: np.ndarray, rounds: int = 1000, damping: float = 0.3, text: np.ndarray | None = None, tolerance: float = 1e-4) -> np.ndarray:
    """Loopy sum-product over all texts of a batch at once, in the log domain.

    ``unary``: log potentials of tokens and hubs; ``e``: edges (node, node, kind of potential); ``text``: the text of each node.
    Each text goes on until its largest change of a message is below ``tolerance``, whatever the other texts do; after 100 rounds
    messages that still swing are damped heavily, and ``rounds`` only bounds those that never settle.
    """
    n, k = unary.shape
    if len(e):
        src, dst = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
        kind = np.concatenate([e[:, 2], e[:, 2]])
        back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
        group = np.zeros(len(src), dtype=np.int64) if text is None else text[src]
        msg, live = np.zeros((len(src), k)), np.arange(len(src))
        for turn in range(rounds):
            total = unary + np.stack([np.bincount(dst[live], msg[live, j], n) for j in range(k)], axis=1)
            new = np.empty((len(live), k))
            for at in range(0, len(live), EDGES):
                some = live[at : at + EDGES]
                new[at : at + EDGES] = np.logaddexp.reduce((total[src[some]] - msg[back[some]])[:, :, None] + model["pair"][kind[some]], axis=1)
            new -= new.max(axis=1, keepdims=True)
            worst = np.zeros(group.max() + 1)
            np.maximum.at(worst, group[live], np.abs(new - msg[live]).max(axis=1))
            keep = damping if turn < 100 else max(damping, 0.9)
            msg[live] = keep * msg[live] + (1 - keep) * new
            live = live[worst[group[live]] >= tolerance]
            if not len(live):
                break
        unary = unary + np.stack([np.bincount(dst, msg[:, j], n) for j in range(k)], axis=1)
    p = np.exp(unary - unary.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def label_tokens(model: dict[str, np.ndarray], graph: Graph, known: np.ndarray) -> np.ndarray:
    """Marginals of every candidate token; ``known``: labels given (0: none)."""
    n = len(LABELS)
    x, edges, ties, fixed = graph.arrays()
    unary = fixed[:, None] * model["pair"][0][0]
    for column in x.T:
        unary += model["weight"][column]
    given = np.flatnonzero(known)
    unary[given] = -1e6
    unary[given, known[given]] = 0.0
    # a hub is known where its known tokens are
    seen = np.zeros((graph.hubs, n), dtype=bool)
    sure = ties[known[ties[:, 0]] > 0]
    seen[sure[:, 1], known[sure[:, 0]]] = True
    evidence = np.where(seen.any(axis=1, keepdims=True) & ~seen, -1e6, 0.0)
    of_hub = np.zeros(graph.hubs, dtype=np.int64)
    doc = np.array(graph.doc, dtype=np.int64)
    of_hub[ties[:, 1]] = doc[ties[:, 0]]
    every = np.concatenate([np.column_stack([edges, np.zeros(len(edges), dtype=np.int64)]), np.column_stack([ties[:, 0], len(doc) + ties[:, 1], np.ones(len(ties), dtype=np.int64)])])
    return marginals(model, np.concatenate([unary, evidence]), every, text=np.concatenate([doc, of_hub]))[: len(doc)]


def _plausible(kind: int, text: str) -> bool:
    """Whether the format allows an entity of the kind (1 to 4)."""
    digits = _NOT_DIGIT.sub("", text)
    if kind == 1:
        return bool(re.search(r"[^\x20]@[^\x20]", text))
    if kind == 2:
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", text)) and all(int(p) <= 255 for p in text.split("."))
    if kind == 3:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and not re.search(r"[^\x20-\x2F0-9]", text)


def added_spans(model: dict[str, np.ndarray], texts: list[str], spans: list[list[tuple[int, int, int]]], least: float = 0.5) -> list[list[tuple[int, int, int]]]:
    """Spans the CRF adds to each text: runs of one label, certain enough, of a format the kind may have, apart from every base span."""
    graph = Graph()
    for i, t in enumerate(texts):
        if t and _HINT.search(t):
            graph.add(i, t)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not graph.doc:
        return out
    known = base_labels(graph, spans)
    p = label_tokens(model, graph, known)
    label, sure = np.where(known > 0, 0, p.argmax(axis=1)).tolist(), (p.max(axis=1) >= least).tolist()
    i = 0
    while i < len(label):
        j = i + 1
        if label[i] and sure[i]:
            text = texts[graph.doc[i]]
            while j < len(label) and graph.doc[j] == graph.doc[i] and label[j] == label[i] and sure[j] and text[graph.span[j - 1][1] : graph.span[j][0]] in ("", " "):
                j += 1
            start, end = graph.span[i][0], graph.span[j - 1][1]
            while start < end and text[start] in ".,;:!?\"'[]<>":
                start += 1
            while end > start and text[end - 1] in ".,;:!?\"'[]<>(":
                end -= 1
            if end > start and _plausible(label[i], text[start:end]) and all(e <= start or end <= s for _, s, e in spans[graph.doc[i]]):
                out[graph.doc[i]].append((label[i] - 1, start, end))
        i = j
    return out


# ---- the operator -----------------------------------------------------------------------------


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """Fit the CRF on about ``max_docs`` distinct texts that hold a digit or an @, chosen by their hash.

    Distinct texts are counted first (by their hashes), so that only the sample itself is sent to the driver.
    """
    held = id_and_text(docs, id_col, text_col).where(F.col("text").rlike("[0-9@]") & (F.length("text") <= TRAIN_CHARS)).select("text", F.xxhash64("text").alias("digest"))
    share = min(1.0, max_docs / max(1, held.select("digest").distinct().count()))
    rows = held.where(F.pmod("digest", F.lit(1 << 30)) < share * (1 << 30)).select("text").distinct().collect()
    return fit_crf(sorted(r.text for r in rows))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """One row per input row: doc_id, base and all spans as arrays of (kind, start, end)."""
    model = model or train(docs, id_col, text_col)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("base", span), ("spans", span), ("base_text", pa.string()), ("spans_text", pa.string())])
    said = lambda xs: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in xs]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            texts = [t or "" for t in piece.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            every = [sorted(b + a) for b, a in zip(base, added_spans(model, texts, base), strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(map(said, base), span), pa.array(map(said, every), span), pa.array(map(joined, base), pa.string()), pa.array(map(joined, every), pa.string())], schema=schema)

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return id_and_text(docs, id_col, text_col).mapInArrow(scan, f"doc_id bigint, base {kind}, spans {kind}, base_text string, spans_text string")


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans merge under the first."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", model: dict[str, np.ndarray] | None = None, id_col: str = "doc_id") -> DataFrame:
    """The same rows and columns with personal data replaced in ``text_col``; null text stays null."""
    model = model or train(docs, id_col, text_col)
    at = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text=text_col):
            texts = piece.column(at).to_pylist()
            plain = [t or "" for t in texts]
            base = [base_spans(t) for t in plain]
            clean = [redacted(t, b + a) for t, b, a in zip(texts, base, added_spans(model, plain, base), strict=True)]
            cols = list(piece.columns)
            cols[at] = pa.array(clean, piece.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=piece.schema)

    return docs.mapInArrow(scan, docs.schema)
