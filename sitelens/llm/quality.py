"""Quality rules by robust multivariate outliers, in DataFrame operations only.

Every text gives counts (words, symbols, repeated lines and 5-word windows).
Four of their ratios, transformed so that ordinary texts scatter about evenly,
form a vector.  For each language and source a minimum covariance determinant
estimate is fitted: start from medians and median deviations, then repeat
concentration steps (keep the nearer half, take its mean and covariance) - each
step is one distributed aggregate.  A text is rejected when a base rule fails
or its squared Mahalanobis distance exceeds the cut.

Scale: vectors are held as integers (1/1024), so sums are exact and do not
depend on the order of merging.  Half-way distances come from exact percentiles
over integer classes, whose number is bounded.  Groups are never collected:
only mean and Cholesky factor of each group (one row) are joined back, salted.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import prepare, salted_join, text_or_empty, words

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
UNIT = 1024                                # vectors are integers of 1/1024
#: Least standard deviation per component (word length, symbols, repeated words, repeated lines).
FLOORS = (0.06, 0.05, 0.25, 0.25)
CUT = 18.47                                # chi-squared, 4 degrees of freedom, 0.999
MIN_GROUP = 50                             # smaller groups are pooled by language, then overall
STEPS = 4
SYMBOLS = "[#*$%&|<>]"
DIM = len(FLOORS)
_X = [f"__x{i}" for i in range(DIM)]


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed.

    A null text counts as having no words.  n_repeat_words counts the words
    inside any 5-word window that occurs twice or more in the text (windows are
    compared by 64-bit hash).
    """
    t = text_or_empty(text)
    df = docs.withColumn("__w", words(t))
    df = df.withColumn("__lines", F.filter(F.split(t, "\n", -1), lambda s: s.rlike("[^\\x20\\x09-\\x0D]")))
    n = F.size("__w")
    df = df.withColumn("__h", F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(F.slice("__w", i + 1, WINDOW))))
        .otherwise(F.array().cast("array<bigint>")))
    # Sort (window, position) only where some window repeats.
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(
        F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    at = lambda j: F.get(F.col("__s"), j)["h"]
    repeated = F.filter("__s", lambda x, j: F.coalesce(at(j - 1) == x["h"], F.lit(False))
                        | F.coalesce(at(j + 1) == x["h"], F.lit(False)))
    df = df.withColumn("__p", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    covered = F.aggregate(
        "__p", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n")),
        lambda s: s["n"])
    return (df.withColumn("n_words", n.cast("long"))
            .withColumn("word_chars", F.aggregate("__w", F.lit(0), lambda a, x: a + F.length(x)).cast("long"))
            .withColumn("n_symbols", F.regexp_count(t, F.lit(SYMBOLS)).cast("long"))
            .withColumn("n_lines", F.size("__lines").cast("long"))
            .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
            .withColumn("n_repeat_words", covered.cast("long"))
            .withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
            .drop("__w", "__lines", "__h", "__s", "__p"))


def _vector() -> list[Column]:
    """Transformed statistics as integers; pseudo-counts steady short texts."""
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / b)))
    parts = [F.log((F.col("word_chars") + 150) / (F.col("n_words") + 30)),
             share("n_symbols", F.col("word_chars") + 50),
             share("n_repeat_words", F.col("n_words") + 50),
             share("n_dup_lines", F.col("n_lines") + 5)]
    return [F.round(p * UNIT).cast("long").alias(x) for p, x in zip(parts, _X)]


def _consistency(p: int) -> float:
    """Factor that makes the covariance of the nearer half consistent for normal data (even p)."""
    cdf = lambda x, k: 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(k // 2))
    low, high = 0.0, 100.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid, p) < 0.5 else (low, mid)
    return 0.5 / cdf(low, p + 2)


def _cholesky(group: DataFrame, scale: float) -> DataFrame:
    """Mean and lower Cholesky factor (plus floors on the diagonal) from counts and sums."""
    n = F.col("n")
    df = group.select("pool", *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(DIM)], *[
        (scale * (F.col(f"q{i}{j}") / n - F.col(f"s{i}") / n * (F.col(f"s{j}") / n))
         + (F.lit((FLOORS[i] * UNIT) ** 2) if i == j else F.lit(0.0))).alias(f"c{i}{j}")
        for i in range(DIM) for j in range(i + 1)])
    for i in range(DIM):
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}"))
            df = df.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    return df.select("pool", *[f"m{i}" for i in range(DIM)],
                     *[f"l{i}{j}" for i in range(DIM) for j in range(i + 1)])


def _distance(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """Join each row with its group's estimate; add d2, the squared Mahalanobis distance."""
    df = salted_join(rows, fitted, ["pool"], F.struct("__key", *_X), "left")
    for i in range(DIM):
        z = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"z{k}"), range(i), F.col(_X[i]) - F.col(f"m{i}"))
        df = df.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    d2 = reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(DIM)])
    return df.select(*rows.columns, d2.alias("d2"))


def _level(d2: Column) -> Column:
    """Integer class of a distance (1/64 in the logarithm): bounds the number of distinct values."""
    return F.round(64 * F.log(d2 + 1e-6)).cast("long")


def _halves(rows: DataFrame) -> DataFrame:
    """Per group, the sums over the half that is nearest by d2."""
    rows = rows.withColumn("lv", _level(F.col("d2")))
    half = rows.groupBy("pool").agg(F.percentile("lv", 0.5).alias("cut"))
    near = salted_join(rows, half, ["pool"], F.struct("__key", *_X)).filter(F.col("lv") <= F.col("cut"))
    return near.groupBy("pool").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(_X[i]).alias(f"s{i}") for i in range(DIM)],
        *[F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"q{i}{j}") for i in range(DIM) for j in range(i + 1)])


def fit_mcd(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """One row per pool: centre m0.. and Cholesky factor l00.. of the MCD estimate."""
    medians = rows.groupBy("pool").agg(*[F.percentile(x, 0.5).alias(f"m{i}") for i, x in enumerate(_X)])
    start = salted_join(rows, medians, ["pool"], F.struct("__key", *_X))
    spread = start.groupBy("pool").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(DIM)],
        *[(1.4826 * F.percentile(F.abs(F.col(x) - F.col(f"m{i}")), 0.5)).alias(f"d{i}") for i, x in enumerate(_X)])
    fitted = spread.select("pool", *[f"m{i}" for i in range(DIM)], *[
        (F.sqrt(F.col(f"d{i}") ** 2 + F.lit((FLOORS[i] * UNIT) ** 2)) if i == j else F.lit(0.0)).alias(f"l{i}{j}")
        for i in range(DIM) for j in range(i + 1)]).checkpoint()
    scale = _consistency(DIM)
    for _ in range(steps):
        fitted = _cholesky(_halves(_distance(rows, fitted)), scale).checkpoint()
    return fitted


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
            key: str = "doc_id", cut: float = CUT, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per document: key, counts, base_failed, distance and kept.

    Null languages and sources form groups of their own; groups of under
    ``min_group`` texts that pass the base rules are pooled by language, and
    small pools overall.  Repeated rows give repeated results; an empty table
    gives none.  Input columns of any other name are ignored.
    """
    prepare(docs.sparkSession)
    counts = text_counts(docs.select(F.col(key).alias("__key"), F.col(lang).alias("__lang"),
                                     F.col(source).alias("__source"), F.col(text).alias("__text")), "__text")
    name = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    counts = counts.select("*", *_vector(), name("__lang", "__source").alias("gk"), name("__lang").alias("lk"))
    counts = counts.drop("__text", "__lang", "__source").checkpoint()
    pairs = counts.filter(~F.col("base_failed")).groupBy("gk", "lk").agg(F.count(F.lit(1)).alias("n"))
    small = pairs.filter(F.col("n") < min_group).groupBy("lk").agg(F.sum("n").alias("n_lang"))
    own = pairs.join(small, "lk", "left").select(
        "gk", F.when(F.col("n") >= min_group, F.col("gk")).when(F.col("n_lang") >= min_group, F.col("lk"))
        .otherwise(F.lit("all")).alias("pool"))
    rows = salted_join(counts.drop("lk"), own, ["gk"], F.struct("__key", *_X), "left")
    rows = rows.withColumn("pool", F.coalesce("pool", F.lit("all")))
    rows = rows.drop("gk").checkpoint()
    fitted = fit_mcd(rows.filter(~F.col("base_failed")).select("__key", "pool", *_X))
    out = _distance(rows, fitted)
    return out.select(F.col("__key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & F.coalesce(F.col("d2") <= cut, F.lit(True))).alias("kept"),
                      F.round("d2", 3).alias("distance"))
