"""Operator 9: secret scans with a random forest that removes false positives.

Candidates are private key blocks (PEM with its headers, and PGP), passwords in URLs, values of six or more characters assigned to names
such as password or token, quoted ones up to their quote, and runs of 16 or more key-like characters that hold a letter, all at their full length. Each candidate's features (length,
character transitions, entropy, dictionary coverage, place in a path, neighbouring words) go through a random forest of
Spark's ML library, fitted to labelled findings; the verdict is its probability of a secret.

The labelled findings are a table of kinds of findings, one line of text each with its label, as they stand in settings, code,
logs and prose (``KINDS``). Values are drawn by rule with a fixed seed, so that no key stands in the repository; their
number is a parameter, so fitting is bounded. Tests hold out whole kinds, not draws of a kind that was learned.

Defined results: null or empty text has no candidates and so no rows; candidates do not overlap
(key blocks go first, then passwords in URLs and assigned values); runs without a letter are no candidates unless assigned; repeated
rows each give their own findings; other columns are ignored. Work is linear in a text's length.
"""

from __future__ import annotations

import functools
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import id_and_text, materialize, pieces

#: Labelled findings of each kind that fit the forest.
EACH_KIND = 24
#: A word of the dictionary stands in at least this share of a language's documents, and in so many.
WORD_SHARE, WORD_DOCUMENTS = 0.002, 5
#: A private key from its BEGIN line to its END line, headers and all; without an END line as far as whole lines of a key go. A BEGIN line alone is none.
_GAP, _KEY = r"(?:\s|\\[nr])", r"[A-Za-z0-9+/=]"
_BLOCK = re.compile(
    rf"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:{_GAP}*[A-Za-z][A-Za-z0-9-]*:[ \t][^\n\\]*(?=\n|\\[nr]))*+"
    rf"(?:(?:{_GAP}|{_KEY})*+-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|(?:{_GAP}*+{_KEY}{{40,}}+)+(?:{_GAP}*+{_KEY}+={{1,2}}(?!{_KEY}))?)"
)
_RUN = re.compile(r"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/=.-]{16,}+")
#: Names that values are assigned to. A value in quotes goes up to its quote on the same line, another up to white space or a mark.
_NAMES = r"password|passphrase|passwd|passcode|pwd|secret(?:[_-]?access)?[_-]?key|client[_-]?secret|secret|(?:api|access|private|encryption|signing|auth|account)[_-]?key|(?:access|auth|api|bearer)?[_-]?token|credentials?|auth"
_ASSIGNED = re.compile(rf"""(?i)(?<![a-z])(?:{_NAMES})["']?[ \t]*+[=:][ \t]*+(?:"([^"\n]{{6,}}+)"|'([^'\n]{{6,}}+)'|["']?([^\s"'<>,;]{{6,}}+))""")
#: The password of user:password@host in a URL.
_IN_URL = re.compile(r"""(?<=://)[^\s/:@"'<>]*+:([^\s/@"'<>]{4,}+)@""")
_LETTER = re.compile("[A-Za-z]")
_WORD = re.compile(r"[^\W\d_]+")
_PLAIN_WORD = re.compile(r"(?<![^\W_])[a-z]{4,24}(?![^\W_])")
CUES = frozenset("password passwd pwd secret secrets token key apikey api access private auth bearer credential credentials".split())
ANTI = frozenset("sha sha1 sha256 md5 commit checksum hash digest uuid guid id version build example sample test dummy placeholder your xxx changeme isbn order invoice".split())
DICTIONARY = frozenset("access account address admin after also back base build cache change class client code color commit common config content count create data date default delete description document domain draft email empty enable error event example file filter final first font form from function general group guide have header height home host html http https image import index info input insert item java json key label language last layout left letter level license line link list local login main make manager master media member menu message method model module month more name network null number object online open option order package page panel parent password path people picture place player plugin point policy post private product profile project public query read record region release remove report request resource result return right root sample save school screen script search section select send server service session setting site size slide source start state static status store string style submit summary support system table target task team template test text that theme thing this thumb time title token tool type under update upload user value version video view visit water week width window with word work world year your".split())
FEATURES = ("length", "letters", "digits", "transitions", "rare", "entropy", "distinct", "coverage", "path", "assigned", "cue", "anti", "hex", "upper", "prefix", "repeats", "separators")


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end): key blocks, passwords in URLs and assigned values, then other runs that hold a letter."""
    taken = [(m.start(), m.start() + len(m[0].rstrip())) for m in _BLOCK.finditer(text)]
    for block in taken:
        yield "block", *block
    def free(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
        """Those that touch none that is taken; both in order."""
        i, out = 0, []
        for start, end in spans:
            while i < len(taken) and taken[i][1] <= start:
                i += 1
            if not (i < len(taken) and taken[i][0] < end):
                out.append((start, end))
        return out

    def assigned() -> Iterator[tuple[int, int]]:
        for m in _ASSIGNED.finditer(text):
            group = m.lastindex
            value = m[group] if group < 3 else m[group].rstrip(".)]}")
            if len(value) >= 6:
                yield m.start(group), m.start(group) + len(value)

    for kind, spans in (("url", (m.span(1) for m in _IN_URL.finditer(text))), ("assigned", assigned())):
        new = free(spans)
        yield from ((kind, *span) for span in new)
        taken = sorted(taken + new)
    i = 0
    for m in _RUN.finditer(text):
        start, end = m.start(), m.end()
        while end > start and text[end - 1] in ".-_/":
            end -= 1
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if end - start < 16 or (i < len(taken) and taken[i][0] < end):
            continue
        if _LETTER.search(text, start, end):
            yield "run", start, end


def _entropy(counts: Counter, n: int) -> float:
    return -sum(c / n * math.log2(c / n) for c in counts.values())


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


#: Kind of every ASCII character, and which may stand first and second in a pair that words seldom have.
_KINDS = np.array([_kind(chr(i)) for i in range(128)], dtype=np.int8)
_FIRST, _SECOND = (np.isin(np.arange(129), [ord(c) for c in some]) for some in ("bcdfgjkqvwxz", "bcdfghjkmnpqvwxz"))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _kinds_of(codes: np.ndarray) -> np.ndarray:
    out = _KINDS[np.minimum(codes, 127)]
    far = codes > 127
    if far.any():
        known, place = np.unique(codes[far], return_inverse=True)
        out[far] = np.array([_kind(chr(c)) for c in known.tolist()], dtype=np.int8)[place]
    return out


def measure(run: str, part: int = 65_536) -> tuple[list[int], int, int, int]:
    """(characters of each kind, changes of kind, rare pairs, repeated pairs), read in parts, so that a value's length costs no memory."""
    counts, changes, rare, repeats, before = np.zeros(4, dtype=np.int64), 0, 0, 0, ""
    for at in range(0, len(run), part):
        piece = before + run[at : at + part]
        kinds, low = _kinds_of(_codes(piece)), _codes("".join(c if len(c) == 1 else "\x80" for c in map(str.lower, piece)) if not piece.isascii() else piece.lower())
        counts += np.bincount(kinds[len(before) :], minlength=4)
        changes += int(np.count_nonzero(kinds[1:] != kinds[:-1]))
        near = np.minimum(low, 128)
        rare += int(np.count_nonzero(_FIRST[near[:-1]] & _SECOND[near[1:]]))
        repeats += int(np.count_nonzero(low[1:] == low[:-1]))
        before = piece[-1]
    return counts.tolist(), changes, rare, repeats


class Dictionary:
    """Words of four letters or more, found longest first from left to right by an automaton."""

    def __init__(self, words: Iterable[str]):
        self.words = frozenset(w for w in words if len(w) > 3)
        self.machine = ahocorasick.Automaton()
        for w in self.words:
            self.machine.add_word(w, len(w))
        self.machine.make_automaton()

    def covered(self, low: str) -> int:
        """Characters of a lower-case text that belong to words."""
        return sum(n for _, n in self.machine.iter_long(low)) if self.words else 0


def _near(text: str, start: int, end: int) -> list[str]:
    """Whole words between two places; one that reaches over an outer end of the window is none."""
    return [m[0].lower() for m in _WORD.finditer(text, start, end) if not (m.start() == start > 0 and text[start - 1].isalpha()) and not (m.end() == end < len(text) and text[end].isalpha())]


def describe(text: str, kind: str, start: int, end: int, dictionary: Dictionary | None = None) -> list[float]:
    """The features of one candidate, in the order of FEATURES."""
    run = text[start:end]
    n, low, counts = len(run), run.lower(), Counter(run)
    (lower, upper, digits, others), changes, rare, repeats = measure(run)
    letters = lower + upper
    covered = (dictionary or base_dictionary()).covered(low)
    before = _near(text, max(0, start - 40), start)[-3:]
    after = _near(text, end, min(len(text), end + 24))[:2]
    near = [*before, *after]
    in_path = low.count("/") + (start > 0 and text[start - 1] in "/\\") + ("://" in text[max(0, start - 24) : start] and kind != "url")
    return [
        float(n), letters / n, digits / n, changes / max(1, n - 1), rare / max(1, n - 1),
        _entropy(counts, n), len(counts) / n, covered / max(1, letters), float(in_path), float(kind != "run") + float(kind == "block"), float(sum(w in CUES for w in before) + (kind == "url")), float(sum(w in ANTI for w in near)),
        float(bool(re.fullmatch("[0-9a-fA-F]+", run))), upper / n, float(run.startswith(("AKIA", "ASIA", "ghp_", "gho_", "sk_live_", "xox", "AIza", "eyJ"))),
        repeats / max(1, n - 1), others / n,
    ]


@functools.cache
def base_dictionary() -> Dictionary:
    return Dictionary(DICTIONARY)


def _document_words(rows: DataFrame, share: float, known: frozenset[str] | None = None) -> DataFrame:
    """lang, word, n: how many documents of a task hold each word: of ``known``, or words that ``share`` of the task's documents hold.
    The number of documents stands beside the word "#"."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for piece in pieces(batches):
            for lang, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                words = set(_PLAIN_WORD.findall(text.lower()))
                own = found.setdefault(lang, Counter())
                own.update(words if known is None else words & known)
                own["#"] += 1
        kept = [(lang, w, n) for lang, own in found.items() for w, n in own.items() if known is not None or n >= share * own["#"]]
        columns = zip(*kept, strict=True) if kept else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

    return rows.mapInArrow(count, "lang string, word string, n bigint")


def learn_dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", share: float = WORD_SHARE, least: int = WORD_DOCUMENTS) -> Dictionary:
    """DICTIONARY and the words of a to z, four letters or more, that at least ``share`` of a language's documents hold (``least`` of them at
    the fewest): whole texts, all documents, exact counts.

    A word that reaches the share in all documents reaches it in those of some task, so a first pass returns only such words, and a second
    counts them; the words of a text never move. As a document holds few words, few can reach the share.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    rows = docs.where(F.col(text_col).isNotNull()).select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"))
    likely = frozenset(r[0] for r in _document_words(rows, share).select("word").distinct().collect()) - {"#"}
    counts = materialize(_document_words(rows, share, likely).groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    sizes = counts.where("word = '#'").select("lang", F.col("n").alias("documents"))
    kept = counts.where("word <> '#'").join(sizes, "lang").where((F.col("n") >= least) & (F.col("n") >= share * F.col("documents")))
    return Dictionary(DICTIONARY | {r[0] for r in kept.select("word").distinct().collect()})


#: Kinds of findings: label (1 for a secret) and a line in which one candidate is drawn by rule. {hex40}: so many characters; {hex16-64}: a number between.
KINDS = """
1 password={hex18} and then
1 export DB_PASSWORD={odd9-20}
1 "password": "{mixed12-30}",
1 passwd: {odd10-16} # production
1 spring.datasource.password={mixed12-24}
1 the token = "{hex40}" is used
1 auth_token: {hex32}
1 access_token={mixed40-180}&expires=3600
1 secret = '{base40}='
1 aws_secret_access_key = {base40}
1 the secret access key {base40} of the account
1 api_key={hex16-64}
1 "apiKey": "{mixed20-48}"
1 apikey {mixed32} for the service
1 X-Api-Key: {mixed24-40}
1 private_key={base200-2000}
1 my private key {base400-2400} stays here
1 Authorization: Bearer {mixed32-80}
1 Authorization: Bearer eyJ{mixed200-2000}
1 curl -H 'Authorization: token ghp_{mixed36}'
1 use ghp_{mixed36} to push
1 key AKIA{up16} in use
1 AKIA{up16}
1 charged with sk_live_{mixed24}
1 maps AIza{mixed35} loaded
1 slack xoxb-{digits12}-{mixed24}
1 client_secret: {mixed24-40}
1 token: {letters20-48}
1 secret key {letters24-80} given by mail
1 password={phrase3-5}
1 pwd = {lower14-30}
1 secret: {up20-40}
1 https://user:{mixed16-24}@host.example.com with secret
1 postgres://admin:{odd8-16}@db.internal:5432/app
1 secret_key = {odd8-14}
1 passphrase: {odd9-18}
1 password = "{mixed4-8},{mixed3-6} {mixed3-6};{digits2}"
1 credentials {mixed20-32}:{mixed30} of the bot
1 -----BEGIN RSA PRIVATE KEY-----{base800-1600}-----END RSA PRIVATE KEY-----
1 -----BEGIN PRIVATE KEY-----{base400-900}
0 fixed in commit {hex40} today
0 merge {hex40} into main
0 sha256 checksum {hex64} of the file
0 sha256:{hex64}
0 md5 {hex32} matches
0 "integrity": "sha512-{base86}=="
0 ETag {hex32}
0 id {uuid} created
0 request {uuid} took 30 ms
0 "guid": "{uuid}"
0 see {path3-6}/{digits4}.html for more
0 import {dotted3-5}.{camel}
0 from {dotted3-4} it
0 {path3-6}.py line 20
0 https://www.example.com/{path2-4}/{digits5}
0 https://{word}.example.com/{word}-{word}-{word}-{digits4}
0 www.{word}{word}.com
0 write to {word}.{word}@mail.{word}.example.com
0 def {snake3-5}(self)
0 class {camel}{camel}Test
0 {camel}{camel}
0 const {snake3-4}{digits2} = 5
0 .{dash3-5} { color: red }
0 version {digits1}.{digits2}.{digits1}-{word}-build{digits3}
0 {word}-{word}-{digits1}.{digits2}.{digits1}.tar.gz
0 order {digits12}-{upperword} shipped
0 invoice {digits10}{upperword}
0 isbn {digits13}x
0 password: changeme1
0 password=your_password_1
0 token = xxxxxxxxxxxx
0 secret: ********
0 api_key=<your-api-key>
0 password: {plain}
0 token: {word}{word}
0 password is {plain}
0 secret = {word}_placeholder
0 password: os.environ['{word}']
0 token = get_{snake2}()
0 password={snake2}
0 http://{word}:{word}@{word}.example.com/{word}
0 secret: "{word} {word} {word}"
0 password: "{plain} {word} {word} {word}"
0 auth: {word}.{word}.{word}
0 data image png {base300-2400}
0 {same16-2000}
0 {compound3-5} in prose
0 {capital3-5} in prose
0 {upper3-4} in prose
0 {syllables6-12} and so on
0 {Syllables6-12} and so on
0 {syllables4}-{syllables5} und so
0 token: {syllables3-4}
0 {long40-300}
0 the {word}/{word}/{word}/{word} choice
"""
_DRAWN = re.compile(r"\{([A-Za-z]+)(\d*)(?:-(\d+))?\}")
#: Words of no dictionary entry, as people choose them.
_PLAIN = "required optional correct horse battery staple string missing expired invalid unknown nothing hidden protected generated rotating yellow river garden winter mountain silver orange falcon planet kitchen shadow bridge candle harbour meadow lantern pepper violet thunder".split()


def labelled_findings(each: int = EACH_KIND, seed: int = 11, kinds: str = KINDS, dictionary: Dictionary | None = None) -> list[tuple[list[float], float]]:
    """(features, 1 for a secret) of ``each`` findings of every kind, measured at the candidates that the scan finds."""
    r = random.Random(seed)
    words = sorted(DICTIONARY)
    sets = {"hex": "0123456789abcdef", "mixed": string.ascii_letters + string.digits, "base": string.ascii_letters + string.digits + "+/", "up": string.ascii_uppercase + "234567", "digits": string.digits, "letters": string.ascii_letters, "lower": string.ascii_lowercase, "odd": string.ascii_letters + string.digits + "!#$%&*"}
    syllable = lambda: r.choice("bdfgklmnprstvz") + r.choice("aeiou") + r.choice(["", "", "n", "r", "s", "l", "ch", "tz", "rb"])
    pick = lambda n, of=words: [r.choice(of) for _ in range(n)]
    made = {
        "uuid": lambda n: "-".join("".join(pick(k, sets["hex"])) for k in (8, 4, 4, 4, 12)), "path": lambda n: "/".join(pick(n)), "dotted": lambda n: ".".join(pick(n)), "snake": lambda n: "_".join(pick(n)), "dash": lambda n: "-".join(pick(n)),
        "word": lambda n: r.choice(words), "plain": lambda n: r.choice([w for w in _PLAIN if len(w) > 5]), "upperword": lambda n: r.choice(words).upper(), "camel": lambda n: "".join(w.capitalize() for w in pick(2)), "phrase": lambda n: "".join(pick(n, _PLAIN)),
        "compound": lambda n: "".join(pick(n)), "capital": lambda n: "".join(w.capitalize() for w in pick(n)), "upper": lambda n: "".join(pick(n)).upper(), "syllables": lambda n: "".join(syllable() for _ in range(n)), "Syllables": lambda n: "".join(syllable() for _ in range(n)).capitalize(),
        "same": lambda n: r.choice(sets["mixed"]) * n, "long": lambda n: "/".join(pick(n, words + _PLAIN)),
    }

    def draw(m: re.Match) -> str:
        n = r.randint(int(m[2]), int(m[3])) if m[3] else int(m[2] or 0)
        return made[m[1]](n) if m[1] in made else "".join(pick(n, sets[m[1]]))

    out = []
    for line in kinds.strip().splitlines():
        label, text = line.split(" ", 1)
        for _ in range(each):
            drawn = f"{r.choice(['the and of', 'see also', 'in with', 'la que de', 'und der die', 'les des une', ''])} {_DRAWN.sub(draw, text)} {r.choice(['and so', 'de la', 'und', ''])}"
            out += [(describe(drawn, *found, dictionary), float(label)) for found in candidates(drawn)]
    return out


def train(spark: SparkSession, each: int = EACH_KIND, trees: int = 32, depth: int = 9, kinds: str = KINDS, dictionary: Dictionary | None = None) -> RandomForestClassificationModel:
    rows = spark.createDataFrame(labelled_findings(each, kinds=kinds, dictionary=dictionary), "x array<double>, label double").coalesce(1)
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=7).fit(rows.select(array_to_vector("x").alias("features"), "label"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: RandomForestClassificationModel | None = None, least: float = 0.5, lang_col: str = "lang") -> DataFrame:
    """One row per candidate: doc_id, kind, start, end (code points), score, is_secret.

    Without a ``model`` the dictionary is learned from these documents and the forest fitted with it; a given model goes with DICTIONARY.
    """
    dictionary = None if model else learn_dictionary(docs, text_col, lang_col)
    words = sorted(dictionary.words) if dictionary else None
    schema = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("x", pa.list_(pa.float64()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary(words) if words else base_dictionary()
        for piece in pieces(batches):
            rows = [(doc, kind, s, e, describe(t, kind, s, e, known)) for doc, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True) if t for kind, s, e in candidates(t)]
            cols = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    found = id_and_text(docs, id_col, text_col).mapInArrow(find, "doc_id bigint, kind string, start bigint, end bigint, x array<double>")
    model = model or train(docs.sparkSession, dictionary=dictionary)
    scored = model.transform(found.withColumn("features", array_to_vector("x")))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select("doc_id", "kind", "start", "end", score.alias("score"), (score >= least).alias("is_secret"))
