"""Operator 3: quality rules with robust multivariate outliers, in DataFrame functions only.

Base statistics come from array expressions on the whole text, with no row per word. On top of
them a minimum-covariance-determinant estimate for each language and source rejects outliers. From two
starts (coordinate medians with interquartile ranges, and the plain mean and covariance) concentration
steps keep the share ``support`` of rows at the least Mahalanobis distance and estimate mean and
covariance anew, each group until its determinant falls no further; the start that ends with the lesser determinant
stands. A row is rejected when its squared distance is above ``cut``, the 99.9 % point of chi-square;
distances are shrunk where the group's median is above chi-square's (heavy tails), never stretched.

A part varies by its least deviation in ``LEAST_SPREAD`` at least (its square is added to the variance), so
that a part in which ordinary texts of a group agree, such as symbols, rejects what differs a lot and not whatever differs at all.

Groups of fewer than ``least_rows`` rows use their language's estimate, and languages of fewer that of
all rows; only the estimates that some group uses are made. Quantiles are taken over counts of
distances by bucket (one percent wide), so they are exact up to a bucket, need bounded memory, and do not depend
on how rows are dealt to tasks. Every step is one aggregation over the small statistics table, for all groups at once.

Hot groups: aggregates combine before the shuffle. Estimates, one row for each group, are counted: up to ``FEW_GROUPS``
are broadcast, more are joined, salted over ``salts`` copies of each row.

Defined results: null text has no words and fails the base rule; empty tables give no rows; null
language or source is a group of its own, apart from the empty string; repeated rows each get their own
result; without any row that passes the base rule nothing else is rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import materialize

WINDOW = 8
#: Words below which a text fails, and the largest percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
SUPPORT, LEAST_ROWS, SALTS = 0.75, 40, 16
#: A group's steps go on while they lower the logarithm of its determinant by more than this. Each does, so they end; the number only guards.
STILL, MOST_STEPS = 1e-3, 100
#: Groups whose estimates (some 25 numbers each) are broadcast.
FEW_GROUPS = 10_000
PARTS = 5
#: The median and the 99.9 % point of a chi-square variable with as many degrees of freedom as the vector has parts.
CHI2_MEDIAN, CUT = 4.351, 20.515
#: Least deviation of each part x0.. of the vector; see with_vector for their scales.
LEAST_SPREAD = (1.0, 0.1, 0.35, 0.5, 0.05)
#: Buckets for each doubling of a squared distance, and for each unit of a part.
BUCKETS, UNITS = 64, 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_column(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array; null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), " ", -1), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows whose words are found twice or more in the array.

    Hashes of the windows decide whether any repeats at all (a hash set); only then are
    (hash, start) pairs sorted, equal neighbours marked, and the covered words summed over starts.
    """

    def sums(starts: Column) -> Column:
        step = lambda acc, s: F.struct((acc["n"] + F.least(F.lit(window), s - acc["at"])).alias("n"), s.alias("at"))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("at"))
        # each start adds the words from the one before it that its window does not cover already
        return F.aggregate(starts, zero, step, lambda acc: acc["n"])

    def marked(pairs: Column) -> Column:
        same = lambda i, j: F.get(pairs, i)["h"].eqNullSafe(F.get(pairs, j)["h"])
        return F.array_sort(F.transform(F.filter(F.transform(pairs, lambda p, i: F.struct(p["i"].alias("i"), (same(i, i - 1) | same(i, i + 1)).alias("twice"))), lambda p: p["twice"]), lambda p: p["i"]))

    def from_hashes(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(pairs, marked), sums))

    def from_words(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (window - 1))
        return F.when(F.size(w) <= window, F.lit(0)).otherwise(let(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, window))), from_hashes))

    return let(words, from_words).cast("long")


def _named(c: Column) -> Column:
    """A key that no other column can be: "=" and the value, or the empty string for null."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_distinct."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    per = let(
        words_column(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        ),
    )
    line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    df = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        _named(F.col(lang_col)).alias("lang"),
        _named(F.col(source_col)).alias("source"),
        per.alias("w"),
        line.alias("l"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    n, r = F.col("w.n_words"), F.col("w.n_repeat_words")
    return df.select(
        "doc_id", "lang", "source", n.alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), r.alias("n_repeat_words"),
        ((n < LEAST_WORDS) | (100 * r > MOST_REPEATED * n)).alias("base_failed"), F.col("l.n").alias("n_lines"), F.col("w.n_distinct").alias("n_distinct"),
    )


def with_vector(stats: DataFrame) -> DataFrame:
    """x0..x4: logarithms of the words, of their mean length, of the share of symbols (0.01 added) and of repeated lines
    (0.05 added), and the logarithm of distinct words by that of words, which hardly depends on a text's length."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda a, b, more: F.log(F.col(a) / F.greatest(F.col(b), F.lit(1)) + more)
    return stats.withColumns({
        "x0": F.log1p(F.col("n_words").cast("double")),
        "x1": F.log((F.col("word_chars") + 1) / n),
        "x2": share("n_symbols", "word_chars", 0.01),
        "x3": share("n_dup_lines", "n_lines", 0.05),
        "x4": F.log1p(F.col("n_distinct").cast("double")) / F.log1p(n),
    })


XS = range(PARTS)
KEY = ["level", "g_lang", "g_source"]


def key_of(level: Column) -> Column:
    """The group of a row at a level: its language and source, its language, or all rows."""
    return F.struct(level.alias("level"), F.when(level < 2, F.col("lang")).otherwise("").alias("g_lang"), F.when(level == 0, F.col("source")).otherwise("").alias("g_source"))


def group_levels(stats: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """lang, source, level (whose estimate their rows use) and member_of (levels whose estimates their rows go into)."""
    pairs = stats.groupBy("lang", "source").agg(F.count_if(~F.col("base_failed")).alias("n"))
    langs = materialize(pairs.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.max(F.col("n") < least_rows).alias("some")), "langs")
    everything = bool(langs.agg(F.max(F.col("some") & (F.col("n_lang") < least_rows))).first()[0])
    level = F.when(F.col("n") >= least_rows, 0).when(F.col("n_lang") >= least_rows, 1).otherwise(2)
    member_of = F.array(F.when(F.col("n") >= least_rows, 0), F.when(F.col("some") & (F.col("n_lang") >= least_rows), 1), F.when(F.lit(everything), 2))
    return pairs.join(langs, "lang").select("lang", "source", level.alias("level"), F.filter(member_of, lambda x: x.isNotNull()).alias("member_of"))


def _z(p: str = "p.") -> list[Column]:
    """Parts of the vector from the mean m0.., by forward substitution with the Cholesky factor l00, l10, ..."""
    z: list[Column] = []
    for i in XS:
        rest = F.col(f"x{i}") - F.col(f"{p}m{i}")
        for j in range(i):
            rest = rest - F.col(f"{p}l{i}{j}") * F.col(f"z{j}")
        z.append(rest / F.col(f"{p}l{i}{i}"))
    return z


def with_distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared distance of x0.. under the estimate in the struct column p; null where there is none."""
    for i, z in enumerate(_z()):
        df = df.withColumn(f"z{i}", z)
    return df.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, PARTS)), F.col("z0") * F.col("z0"))).drop(*(f"z{i}" for i in XS))


def bucket(d2: Column) -> Column:
    return F.floor(F.log2(d2 + 1e-6) * BUCKETS)


def cholesky(df: DataFrame) -> DataFrame:
    """From means m0.. and covariances c00, c10, ..: the lower factor l00, l10, .. with the least spread added, and log_det."""
    for i in XS:
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (F.lit(LEAST_SPREAD[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    log_det = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, PARTS)), F.log(F.col("l00"))) * 2
    return df.withColumn("log_det", log_det).drop(*(f"c{i}{j}" for i in XS for j in range(i + 1)))


def _attach(df: DataFrame, params: DataFrame, few: bool, salts: int) -> DataFrame:
    """df with the struct p of its group (each, if it has several), null where it has none."""
    packed = params.select(*KEY, F.struct(*[c for c in params.columns if c not in KEY]).alias("p"))
    if few:
        return df.join(F.broadcast(packed), KEY, "left")
    copied = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("salt", F.pmod(F.hash(*(f"x{i}" for i in XS)), F.lit(salts))).join(copied, [*KEY, "salt"], "left").drop("salt")


def _at_share(counts: DataFrame, by: list[str], share: float, out: str) -> DataFrame:
    """by, ``out``: the least bucket b up to which the share of the rows lies. ``counts``: by, b, k; a group has a bounded number of buckets."""
    group = Window.partitionBy(*by)
    so_far = F.sum("k").over(group.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.select(*by, "b", so_far.alias("so_far"), F.sum("k").over(group).alias("all")).where(F.col("so_far") >= F.ceil(share * F.col("all"))).groupBy(*by).agg(F.min("b").alias(out))


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, m0.., c00, c10, ..: means and covariances, rounded so that the order of their sums does not show."""
    means = {f"m{i}": F.avg(f"x{i}") for i in XS}
    covs = {f"c{i}{j}": F.covar_pop(f"x{i}", f"x{j}") for i in XS for j in range(i + 1)}
    return rows.groupBy(*by).agg(*(F.round(c, 10).alias(k) for k, c in {**means, **covs}.items()))


def _starts(members: DataFrame) -> DataFrame:
    """KEY, start, m*, c*: the plain estimate, and coordinate medians with squared interquartile ranges over 1.349."""
    plain = _moments(members, KEY).withColumn("start", F.lit(0))
    long = members.select(*KEY, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.col(f"x{i}") * UNITS).alias("b")) for i in XS))).alias("e")).select(*KEY, "e.i", "e.b")
    counts = long.groupBy(*KEY, "i", "b").agg(F.count(F.lit(1)).alias("k"))
    at = lambda share, name: _at_share(counts, [*KEY, "i"], share, name)
    quarters = at(0.25, "low").join(at(0.5, "mid"), [*KEY, "i"]).join(at(0.75, "high"), [*KEY, "i"])
    of = lambda i, c: F.max(F.when(F.col("i") == i, c))
    wide = F.pow((F.col("high") - F.col("low")) / (UNITS * 1.349), F.lit(2.0))
    middle = quarters.groupBy(*KEY).agg(*(of(i, F.col("mid") / UNITS).alias(f"m{i}") for i in XS), *((of(i, wide) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in XS for j in range(i + 1)))
    return plain.unionByName(middle.withColumn("start", F.lit(1)))


def mcd(members: DataFrame, few: bool, support: float = SUPPORT, salts: int = SALTS) -> DataFrame:
    """KEY, m*, l*, log_det, scale (median of the squared distance) of each group in ``members`` (KEY, x0..)."""
    by = [*KEY, "start"]

    def near(known: DataFrame) -> DataFrame:
        rows = with_distance(_attach(members, known, few, salts).where("p is not null"))
        return rows.select(*KEY, F.col("p.start").alias("start"), *(f"x{i}" for i in XS), bucket(F.col("d2")).alias("b"), *([F.col("p.limit").alias("limit")] if "limit" in known.columns else []))

    counted = lambda known: near(known).groupBy(*by, "b").agg(F.count(F.lit(1)).alias("k"))
    # a start is no estimate of a part of the rows, so the first step counts as a fall
    active = materialize(cholesky(_starts(members)).withColumn("log_det", F.lit(float("inf"))), "mcd")
    values = [c for c in active.columns if c not in by]
    ended: DataFrame | None = None
    for _ in range(MOST_STEPS):
        limits = active.join(_at_share(counted(active), by, support, "limit"), by)
        after, was = cholesky(_moments(near(limits).where("b <= limit"), by)).alias("a"), active.alias("w")
        lower = F.col("a.log_det") <= F.col("w.log_det")
        both = after.join(was, by).select(*by, *(F.when(lower, F.col(f"a.{c}")).otherwise(F.col(f"w.{c}")).alias(c) for c in values), (F.col("a.log_det") >= F.col("w.log_det") - STILL).alias("still"))
        both = materialize(both, "mcd")
        done = both.where("still").drop("still")
        ended, active = done if ended is None else ended.unionByName(done), both.where("not still").drop("still")
        if active.isEmpty():
            break
    every = ended.unionByName(active)
    least = every.groupBy(*KEY).agg(F.min_by("start", F.struct("log_det", "start")).alias("start"))
    best = materialize(every.join(least, by), "mcd")
    scale = _at_share(counted(best), by, 0.5, "b").select(*by, F.pow(F.lit(2.0), (F.col("b") + 0.5) / BUCKETS).alias("scale"))
    return materialize(best.join(scale, by).drop("start"), "mcd")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cut: float = CUT, least_rows: int = LEAST_ROWS, support: float = SUPPORT, salts: int = SALTS) -> DataFrame:
    """One row per input row: the base statistics, base_failed, distance2 (scaled) and kept."""
    stats = with_vector(materialize(base_statistics(docs, id_col, text_col, lang_col, source_col), "quality"))
    levels = materialize(group_levels(stats, least_rows), "levels")
    # texts that the base rule rejects say nothing about ordinary ones
    usable = stats.where("not base_failed").join(levels.select("lang", "source", "member_of"), ["lang", "source"])
    members = usable.withColumn("g", F.explode(F.transform("member_of", key_of))).select("g.*", *(f"x{i}" for i in XS))
    few = levels.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    params = mcd(materialize(members, "members"), few, support, salts)
    rows = stats.join(levels.select("lang", "source", "level"), ["lang", "source"]).withColumn("g", key_of(F.col("level"))).drop("level").select("*", "g.*")
    distance = F.col("d2") * F.least(F.lit(1.0), CHI2_MEDIAN / F.col("p.scale"))
    kept = ~F.col("base_failed") & F.coalesce(distance <= cut, F.lit(True))
    return with_distance(_attach(rows, params, few, salts)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round(distance, 6).alias("distance2"))


#: The base columns in DuckDB; the verdict of the method is tested against a brute-force version.
ORACLE_BASE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS j FROM rep) GROUP BY rid),
lin AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lin.n, 0) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(cov.n, 0) > 30 * len(w) AS base_failed
FROM d LEFT JOIN cov USING (rid) LEFT JOIN lin USING (rid)
"""
