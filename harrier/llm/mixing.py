"""Mixing sources to target weights, by hash-random keys and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, Scratch

WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of each source: source, source_size, n_docs -> and target.

    Sources, by code point with null last, weigh ``weights``, repeating. They
    share ``share`` times all sizes by weight; a target stops at ``most`` times
    its source's size and the excess goes to the others by weight. That is the
    water level ``least(cap, level * weight)``; with the sources by cap over
    weight, running sums give the level in one pass instead of rounds. The
    table has one row per source, so its windows are small.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    on = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / F.sum("weight").over(on))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    level = level.withColumn("level", F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(everything)["level"])
    return level.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap"))).select("source", "source_size", "n_docs", "target")


def mix_sources(docs: DataFrame, size: Column | None = None, seed: str = "mix", rows_per_bucket: int = 256, keep: list[str] | None = None, **how) -> DataFrame:
    """Every row of docs (of them the columns ``keep``, if given) with size, source_size, target and taken (the words the mix takes, repeats counted).

    A row's key is the MD5 of its doc_id and the seed, or of its text where it
    has no doc_id, so the order is random
    but the same in every run. Words are counted once: sizes and keys are written with the columns. Within a source the rows are cut into ranges of
    the key of about ``rows_per_bucket`` rows, sums of ranges and of ranges of
    ranges are added up, and each row learns the words before it. The mix takes
    as many whole epochs as the target holds, then rows in the key's order up
    to exactly the rest; the row at the cut is taken in part.

    Null texts have size 0 and are not taken; a null source is a source, the
    last one; rows that repeat a doc_id are ordered by
    their text, equal rows share a key. One row per source passes through one task. Other columns stay as they are, but columns of docs with the
    names of the results are replaced.
    """
    own = "__mix_"
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) if size is None else size
    # what breaks ties of repeated doc_ids, so that texts need not be shuffled for it
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), digest)), F.lit(":" + seed)))
    base = docs.withColumns({own + "key": key, own + "t": digest, "size": size.cast("long")}).drop("source_size", "target", "taken")
    base = scratch.save(base if keep is None else base.select(*dict.fromkeys([*keep, "doc_id", "source"]), "size", own + "key", own + "t"), "sizes")
    lean = base.select(F.col("source").alias(own + "s"), "size")
    sizes = lean.groupBy(F.col(own + "s").alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = scratch.save(source_targets(sizes, **how), "targets")
    t = targets.withColumnsRenamed({"source": own + "source", "n_docs": own + "n"})
    n_buckets = F.ceil(F.col(own + "n") / F.lit(float(rows_per_bucket)))
    keyed = base.join(t, F.col("source").eqNullSafe(F.col(own + "source")))
    keyed = keyed.withColumn(own + "b", F.floor(F.conv(F.substring(own + "key", 1, 8), 16, 10).cast("long") * n_buckets / F.lit(2.0**32)).cast("long"))
    keyed = keyed.withColumn(own + "g", F.xxhash64(own + "source", F.col(own + "source").isNull()))

    # sums of buckets, and of runs of buckets
    b = keyed.groupBy(own + "g", own + "b").agg(F.sum("size").alias("sum"))
    b = scratch.save(b.withColumn("run", F.floor(F.col(own + "b") / rows_per_bucket)), "buckets")
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = b.groupBy(own + "g", "run").agg(F.sum("sum").alias("sum"))
    runs = runs.select(own + "g", "run", F.coalesce(F.sum("sum").over(up_to(Window.partitionBy(own + "g").orderBy("run"))), F.lit(0)).alias("r"))
    inner = F.coalesce(F.sum("sum").over(up_to(Window.partitionBy(own + "g", "run").orderBy(own + "b"))), F.lit(0))
    offsets = b.withColumn("o", inner).join(runs, [own + "g", "run"]).select(F.col(own + "g").alias(own + "og"), F.col(own + "b").alias(own + "ob"), (F.col("o") + F.col("r")).alias(own + "o"))
    offsets = scratch.save(offsets, "offsets")
    scratch.keep_only(base, targets, offsets)

    order = Window.partitionBy(own + "g", own + "b").orderBy(own + "key", "doc_id", own + "t", "size")
    placed = keyed.withColumn(own + "w", F.coalesce(F.sum("size").over(up_to(order)), F.lit(0)))
    placed = placed.join(offsets, (F.col(own + "g") == F.col(own + "og")) & (F.col(own + "b") == F.col(own + "ob")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(F.col("target") - epochs * F.col("source_size"))
    partly = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col(own + "w") - F.col(own + "o")))
    out = placed.withColumn("taken", (epochs * F.col("size") + partly).cast("long"))
    return out.drop(*(c for c in out.columns if c.startswith(own)))


def materialize(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: a row's text once for each whole epoch, and its first words where the cut falls."""
    whole = F.floor(F.col("taken") / F.col("size"))
    part = F.col("taken") - whole * F.col("size")
    cut = F.array_join(F.slice(F.array_remove(F.split("text", SPACE), ""), 1, part.cast("int")), " ")
    texts = F.concat(F.array_repeat(F.col("text"), whole.cast("int")), F.when(part > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    taken = mixed.where(F.col("taken") > 0)
    return taken.withColumn("text", F.explode(texts)).select(*columns)
