"""Quality rules: fixed base rules, then robust multivariate outliers.

Per language and source the minimum-covariance-determinant estimate of the
transformed text statistics is found by concentration steps; documents whose
Mahalanobis distance from it is too large are rejected. All of it is DataFrame
operations: each step is one aggregation to group parameters and one pass over
the statistics.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch

MIN_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
SUBSET = 64  # rows of a group that a drawn start takes, about
LEAST_FALL = 1e-3  # of the log of a determinant, for another step

# Transformed statistics: name, and the least standard deviation that its estimate may have
FLOORS = {"x1": 0.05, "x2": 0.05, "x3": 0.15, "x4": 0.11, "x5": 0.10}


def base_statistics(docs: DataFrame, *keep: str | Column, scratch: Scratch | None = None) -> DataFrame:
    """The columns of ``keep``, and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stutters, n_repeat_words, base_failed of whole texts.

    The result is written and read again: a filter on it would else be moved
    through the chain of derived arrays, which copies each into the next.

    Null texts have no words. Windows are compared by 64-bit hashes within one
    document. n_lines counts lines with a word, n_stutters words that equal the
    word before.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    df = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    df = df.withColumn("_words", F.array_remove(F.split(text, SPACE), "")).withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"))
    df = df.withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    df = df.withColumn("_1", F.transform("_words", lambda x: F.xxhash64(x))).drop("_text", "_lines", "_words")
    again = F.size(F.filter("_1", lambda x, i: F.coalesce(x == F.get(F.col("_1"), i - 1), F.lit(False))))
    df = df.withColumn("n_stutters", again.cast("long"))
    for a, b in ((1, 2), (2, 4), (4, 8)):  # hashes of 2, 4, then 8 words
        df = df.withColumn(f"_{b}", F.transform(f"_{a}", lambda x, i: F.xxhash64(x, F.get(F.col(f"_{a}"), i + a)))).drop(f"_{a}")
    df = df.withColumn("_h", F.slice("_8", 1, F.greatest(F.lit(0), F.col("n_words").cast("int") - (WINDOW - 1)))).drop("_8")
    several = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_o", F.when(several, F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("_h")
    same = lambda x, at: F.coalesce(x["h"] == F.get(F.col("_o"), at)["h"], F.lit(False))
    twice = F.filter("_o", lambda x, k: same(x, k - 1) | same(x, k + 1))
    df = df.withColumn("_p", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("_o")
    steps = F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), k + 1) - p, F.lit(WINDOW))).cast("long"))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("_p")
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    return (scratch or Scratch(docs.sparkSession, "statistics")).save(df, "statistics")


def transformed() -> dict[str, Column]:
    """Log word length; square roots of the shares of symbols, repeated lines, repeated words and stutters."""
    part = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return {
        "x1": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "x2": part("n_symbols", "word_chars"),
        "x3": part("n_dup_lines", "n_lines"),
        "x4": part("n_repeat_words", "n_words"),
        "x5": part("n_stutters", "n_words"),
    }


def _pairs() -> list[tuple[str, str]]:
    names = list(FLOORS)
    return [(a, b) for i, a in enumerate(names) for b in names[i:]]


def chi_square(x: float, k: int) -> float:
    """The distribution function with k degrees of freedom, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = math.exp(a * math.log(z) - z - math.lgamma(a + 1))
    n = 1
    while term > 1e-16 * total:
        term *= z / (a + n)
        total += term
        n += 1
    return min(1.0, total)


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, k) < p else (low, mid)
    return high


def _estimate(rows: DataFrame, factor: float) -> DataFrame:
    """Per group and start: means, the Cholesky factor of the covariance times ``factor`` with the floors added, and the log of its determinant."""
    names = list(FLOORS)
    stats = rows.groupBy("g", "s").agg(*(F.avg(a).alias("m_" + a) for a in names), *(F.avg(F.col(a) * F.col(b)).alias(f"c_{a}_{b}") for a, b in _pairs()))
    cov = lambda a, b: F.col(f"c_{a}_{b}") - F.col("m_" + a) * F.col("m_" + b)
    for i, a in enumerate(names):  # row by row, each from the ones before
        for j, b in enumerate(names[: i + 1]):
            own = F.lit(factor) * (F.greatest(cov(b, a), F.lit(0.0)) if a == b else cov(b, a))
            rest = reduce(lambda s, k: s - F.col(f"l_{a}_{k}") * F.col(f"l_{b}_{k}"), names[:j], own)
            value = F.sqrt(F.greatest(rest, F.lit(0.0)) + F.lit(FLOORS[a] ** 2)) if a == b else rest / F.col(f"l_{b}_{b}")
            stats = stats.withColumn(f"l_{a}_{b}", value)
    log_det = reduce(lambda s, a: s + 2 * F.log(F.col(f"l_{a}_{a}")), names, F.lit(0.0))
    return stats.select("g", "s", log_det.alias("log_det"), *("m_" + a for a in names), *(f"l_{a}_{b}" for i, a in enumerate(names) for b in names[: i + 1]))


def _distance(rows: DataFrame, estimate: DataFrame, *keep: str) -> DataFrame:
    """The rows, once for each start of the estimate, with d2, the squared Mahalanobis distance from their group's estimate (by forward substitution)."""
    names = list(FLOORS)
    df = rows.join(estimate, "g", "left")
    for i, a in enumerate(names):
        own = reduce(lambda s, b: s - F.col(f"l_{a}_{b}") * F.col(f"z_{b}"), names[:i], F.col(a) - F.col("m_" + a))
        df = df.withColumn(f"z_{a}", own / F.col(f"l_{a}_{a}"))
    d2 = reduce(lambda s, a: s + F.col(f"z_{a}") * F.col(f"z_{a}"), names, F.lit(0.0))
    return df.withColumn("d2", d2).select(*rows.columns, "d2", *keep)


def _bin(x: Column) -> Column:
    """64 bins an octave."""
    return F.floor(64 * F.log2(F.greatest(x, F.lit(1e-9))))


def _half(rows: DataFrame, scratch: Scratch, share: float) -> DataFrame:
    """Each group's and start's rows of the least d2, ``share`` of them or a bin more; counts by bin, combined before they are shuffled, give the limit."""
    counts = rows.groupBy("g", "s", _bin(F.col("d2")).alias("bin")).count()
    w = Window.partitionBy("g", "s")
    up_to = F.sum("count").over(w.orderBy("bin"))
    limit = counts.withColumn("enough", up_to >= share * F.sum("count").over(w)).where("enough").groupBy("g", "s").agg(F.min("bin").alias("most"))
    return rows.join(scratch.save(limit, "limit"), ["g", "s"]).where(_bin(F.col("d2")) <= F.col("most")).drop("most", "d2")


def _best_half(rows: DataFrame, scratch: Scratch, share: float, draws: int) -> DataFrame:
    """Each group's half of least determinant: from the medians and from ``draws`` small subsets, concentration steps until no determinant falls."""
    start = rows.groupBy("g").agg(*(F.percentile_approx(a, 0.5, 1000).alias("m_" + a) for a in FLOORS), F.count("*").alias("size"))
    first = rows.join(scratch.save(start, "medians"), "g")
    away = reduce(lambda s, a: s + ((F.col(a) - F.col("m_" + a)) / FLOORS[a]) ** 2, FLOORS, F.lit(0.0))
    near = _half(first.select(*rows.columns, F.lit(0).alias("s"), away.alias("d2")), scratch, share)
    drawn = F.filter(F.array(*(F.lit(k) for k in range(1, draws + 1))).cast("array<int>"), lambda k: F.pmod(F.xxhash64(k, *FLOORS), F.col("size")) < SUBSET)
    near = near.unionByName(first.select(*rows.columns, F.explode(drawn).alias("s")))
    best = scratch.save(_estimate(near, 1.0), "estimate")
    while True:
        estimate = scratch.save(_estimate(_half(_distance(rows, best, "s"), scratch, share), 1.0), "estimate")
        last = best.select("g", "s", F.col("log_det").alias("last"))
        fell = scratch.save(estimate.join(last, ["g", "s"]).where(F.col("last") - F.col("log_det") > LEAST_FALL).drop("last"), "fell")
        if fell.isEmpty():
            break
        best = scratch.save(fell.unionByName(best.join(fell, ["g", "s"], "left_anti")), "best")
    chosen = best.groupBy("g").agg(F.min(F.struct("log_det", "s")).alias("b")).select("g", "b.s")
    best = scratch.save(best.join(chosen, ["g", "s"], "left_semi"), "chosen")
    return _half(_distance(rows, best, "s"), scratch, share)


def quality_rules(docs: DataFrame, quantile: float = 0.999, share: float = 0.6, least_rows: int = 100, draws: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, the base statistics, base_failed, d2 and kept for every row of docs.

    The estimates are of the rows that pass the base rules. A language and
    source with fewer than ``least_rows`` of them takes the estimate of its
    language, and that of all rows where the language has too few as well. From the
    group's medians, and from ``draws`` subsets of about ``SUBSET`` rows, each
    concentration step takes the ``share`` of rows nearest
    to the last estimate and makes the next, until no determinant falls; the
    start that ends with the least one counts. Limits come from histograms of the distance,
    64 bins an octave, so that all rows count and no group is gathered.

    A document is rejected beyond the chi-square ``quantile`` of the squared
    distance; the covariance is scaled by the factor that makes it consistent
    for normal data. Statistics that hardly vary count
    with a least standard deviation (``FLOORS``), so clean texts are left
    alone; still each of them alone can reject a document, but word length,
    which varies: half of the lines repeated, a quarter of the words in
    repeated windows, a fifth of the words stutters or 5 % symbols do.

    Null languages and sources are values of their own; null texts fail the
    base rules (d2 null). Rows that repeat count as often. Other columns are
    ignored. Tables that are not read again are deleted from ``scratch``.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    label = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    base = base_statistics(docs, "doc_id", label("lang").alias("_l"), label("source").alias("_s"), scratch=scratch)
    stats = base.withColumns(transformed())
    passed = stats.where("NOT base_failed")
    n = passed.groupBy("_l", "_s").agg(F.count("*").alias("n"))
    by_language = n.groupBy("_l").agg(F.sum("n").alias("nl"))
    level = F.when(F.col("n") >= least_rows, F.to_json(F.array("_l", "_s"))).when(F.col("nl") >= least_rows, F.to_json(F.array("_l"))).otherwise("[]")
    groups = scratch.save(n.join(by_language, "_l").select("_l", "_s", level.alias("g")), "groups")
    every = passed.join(groups, ["_l", "_s"]).select("_l", "_s", *FLOORS)
    # each row counts for its group and, where they are asked for, its language and all
    asked = scratch.save(groups.select("g").distinct(), "asked")
    wide = every.withColumn("g", F.explode(F.array(F.to_json(F.array("_l", "_s")), F.to_json(F.array("_l")), F.lit("[]")))).join(asked, "g", "left_semi")
    rows = scratch.save(wide.select("g", *FLOORS), "rows")

    p = len(FLOORS)
    factor = share / chi_square(chi_square_quantile(share, p), p + 2)
    final = scratch.save(_estimate(_best_half(rows, scratch, share, draws), factor), "estimate")
    scratch.keep_only(base, groups, final)
    judged = _distance(stats.join(groups, ["_l", "_s"], "left"), final.drop("s", "log_det"))
    d2 = F.when(~F.col("base_failed"), F.col("d2"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    kept = ~F.col("base_failed") & (F.coalesce(d2, F.lit(0.0)) <= chi_square_quantile(quantile, p))
    return judged.select(*names, d2.alias("d2"), kept.alias("kept"))
