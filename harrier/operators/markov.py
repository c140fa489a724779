"""N-gram Markov scoring of command lines: transitions, priors, scores and the n-grams that explain them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAD = "~"


def _grams(df: DataFrame, units: Column, joint: str, order: int, keep: tuple[str, ...]) -> DataFrame:
    """(keep, ctx, nxt) of an array of characters or tokens: linear in its length, no row carries the whole line."""
    out = df.select(*keep, units.alias("_u"))
    each = F.transform(F.sequence(F.lit(0), F.size("_u") - order - 1), lambda i: F.struct(F.array_join(F.slice(F.col("_u"), i + 1, order), joint).alias("ctx"), F.get(F.col("_u"), i + order).alias("nxt")))
    return out.where(F.size("_u") > order).select(*keep, F.explode(each).alias("_g")).select(*keep, "_g.ctx", "_g.nxt")


def char_grams(df: DataFrame, line: str, order: int, front: bool, back: bool, *keep: str) -> DataFrame:
    """(keep, ctx, nxt): each character with the ``order`` before it; lines are padded on the sides asked for."""
    pad = F.lit(PAD * order)
    text = F.concat(*([pad] if front else []), F.coalesce(F.col(line), F.lit("")), *([pad] if back else []))
    return _grams(df, F.filter(F.split(text, ""), lambda c: c != ""), "", order, keep)


def token_grams(df: DataFrame, tokens: Column, order: int, *keep: str) -> DataFrame:
    """The same over tokens, padded on both sides; a context is its tokens joined by the unit separator."""
    pad = F.array_repeat(F.lit(PAD), order)
    return _grams(df, F.concat(pad, tokens, pad), "\u001f", order, keep)


def train(grams: DataFrame, weight: Column | None = None) -> DataFrame:
    """(ctx, nxt, n, p): weighted counts and their shares of the context."""
    counts = grams.groupBy("ctx", "nxt").agg(F.sum(F.lit(1) if weight is None else weight).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("ctx")))


def prior(model: DataFrame) -> DataFrame:
    """One row: a hundredth of the least probability, 0.001 without training."""
    return model.agg(F.coalesce(0.01 * F.min("p"), F.lit(0.001)).alias("prior"))


def score(lines: DataFrame, grams: DataFrame, model: DataFrame, *key: str) -> DataFrame:
    """(key, score, n_grams): the mean log probability of each line's n-grams, unseen ones by the prior; a line without any has the prior's.

    grams: of the lines, with their key. The model joins as Spark sees fit: it
    is broadcast only where its size allows.
    """
    p = F.broadcast(prior(model))  # one row
    joined = grams.join(model.select("ctx", "nxt", "p"), ["ctx", "nxt"], "left").crossJoin(p)
    mean = joined.groupBy(*key).agg(F.avg(F.log(F.coalesce("p", "prior"))).alias("s"), F.count("*").alias("n"))
    out = lines.select(*key).distinct().join(mean, list(key), "left").crossJoin(p)
    return out.select(*key, F.coalesce("s", F.log("prior")).alias("score"), F.coalesce("n", F.lit(0)).alias("n_grams"))


def threshold(model: DataFrame, percent: float = 95.0) -> DataFrame:
    """One row: ln(prior) times the percentage, which is kept within 55 and 99.999."""
    share = min(99.999, max(55.0, percent)) / 100
    return prior(model).select((F.log("prior") * share).alias("threshold"))


def suspects(scored: DataFrame, model: DataFrame, percent: float = 95.0) -> DataFrame:
    return scored.crossJoin(F.broadcast(threshold(model, percent))).withColumn("suspect", F.col("score") < F.col("threshold"))


def explain(grams: DataFrame, model: DataFrame, percent: float, *key: str) -> DataFrame:
    """(key, unusual): the n-grams of a line whose log probability is under the threshold."""
    joined = grams.join(model.select("ctx", "nxt", "p"), ["ctx", "nxt"], "left").crossJoin(F.broadcast(prior(model))).crossJoin(F.broadcast(threshold(model, percent)))
    odd = joined.where(F.log(F.coalesce("p", "prior")) < F.col("threshold"))
    return odd.groupBy(*key).agg(F.array_sort(F.collect_set(F.concat("ctx", "nxt"))).alias("unusual"))


def host_ratios(scored: DataFrame, host: str) -> DataFrame:
    """(host, scored, suspects, ratio)."""
    return scored.groupBy(host).agg(F.count("*").alias("scored"), F.count_if("suspect").alias("suspects"), F.avg(F.col("suspect").cast("int")).alias("ratio"))


def worst_lines(scored: DataFrame, host: str, *tie: str, most: int = 5) -> DataFrame:
    """The lines with the lowest scores of each host."""
    w = Window.partitionBy(host).orderBy("score", *tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def grouped(scored: DataFrame, command: str, machine: str) -> DataFrame:
    """One row per command: its lowest score, the machines, and how often it was seen."""
    return scored.groupBy(command).agg(F.min("score").alias("score"), F.array_sort(F.collect_set(machine)).alias("machines"), F.count("*").alias("seen"))


def training_lines(df: DataFrame, line: str, *drop_patterns: str) -> DataFrame:
    """Without kernel threads and lines that match a pattern."""
    from harrier.functions.scalars import kernel_thread

    out = df.where(~kernel_thread(F.col(line)))
    for p in drop_patterns:
        out = out.where(~F.col(line).rlike(p))
    return out


def training_sample(df: DataFrame, n: int, *order: str, newest: bool = False, seed: int | None = None) -> DataFrame:
    """The first or last n rows by their order, or n drawn by a seeded shuffle."""
    if seed is not None:
        return df.orderBy(F.xxhash64(F.lit(seed), *order)).limit(n)
    return df.orderBy(*(F.col(c).desc() if newest else F.col(c) for c in order)).limit(n)


def simulate(model: DataFrame, order: int, steps: int, seed: int = 0, most: int = 2_000_000) -> str:
    """A seeded walk over a model of at most ``most`` transitions, which is read once."""
    import random

    if (n := model.count()) > most:
        raise ValueError(f"the model has {n} transitions, over {most}")
    after: dict[str, tuple[list, list]] = {}
    for r in model.select("ctx", "nxt", "p").orderBy("ctx", "nxt").collect():
        to, p = after.setdefault(r.ctx, ([], []))
        to.append(r.nxt), p.append(r.p)
    rng, out = random.Random(seed), PAD * order
    for _ in range(steps):
        if out[-order:] not in after:
            break
        out += rng.choices(*after[out[-order:]])[0]
    return out[order:]
