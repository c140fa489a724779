"""Line removal by a log-template tree of fixed depth.

The tree's first level is a line's token count, the next ones its leading
tokens, those with a digit read as a variable. Within a leaf a token that few
texts have at its place is a variable field; what is left is the line's
template. Templates that recur across documents are dropped with all their
lines. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_broadcast, words

VARIABLE = "<*>"
BROADCAST_ROWS = 1_000_000
BROADCAST_NUMBERS = 4_000_000


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(token)


def _lines(texts: DataFrame, depth: int) -> DataFrame:
    """t1, t2 (the text's hashes), line, leaf and tokens of every line with a word; tokens with a digit are VARIABLE."""
    lines = texts.select("t1", "t2", F.posexplode(F.split("text", "\n")).alias("line", "_t"))
    lines = lines.select("t1", "t2", "line", words(F.col("_t")).alias("_w")).where(F.size("_w") > 0)
    lead = [F.coalesce(_masked(F.get(F.col("_w"), F.lit(k))), F.lit("")) for k in range(depth)]
    return lines.select("t1", "t2", "line", F.xxhash64(F.size("_w"), *lead).alias("leaf"), F.transform("_w", _masked).alias("tokens"))


def drop_recurring_lines(docs: DataFrame, least_docs: int = 10, depth: int = 3, constant: float = 0.5, most_share: float = 1.0) -> DataFrame:
    """docs with their text cleaned, and n_lines (with a word) and n_removed.

    A template recurs if at least ``least_docs`` different texts have it (exact
    copies count once) and at least the share ``constant`` of its places is
    constant. Its lines go, whatever is left: a text whose lines all recur
    becomes empty. On request documents that would lose more than
    ``most_share`` of their lines keep all. The lines that stay are joined as
    they were.

    Leaves, constants and templates are 64-bit hashes; texts are told apart by
    two of them. Only hashes are shuffled: one row for each line to find the
    leaves, one for each token of the lines in recurring leaves to find the
    constants, one for each of these lines to find the templates.

    Null texts stay null, with no lines; empty ones stay empty. Rows that
    repeat are cleaned alike; null doc_ids are fine. Columns of docs named
    n_lines or n_removed are replaced, others stay.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    t1, t2 = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").select(t1.alias("t1"), t2.alias("t2"), "text")
    several = lambda df, *by: df.select(*by, "t1").distinct().groupBy(*by).count().where(F.col("count") >= least_docs).drop("count")
    small = lambda df: bounded_broadcast(df, df.count(), BROADCAST_ROWS)
    leaves = scratch.save(several(_lines(texts, depth), "leaf"), "leaves")
    lines = _lines(texts, depth).join(small(leaves), "leaf", "left_semi")
    # written, so that no expression over tokens is evaluated again for each token, and that rows keep their numbers
    lines = scratch.save(lines.withColumn("row", F.monotonically_increasing_id()), "lines")
    tokens = lines.select("row", "t1", "t2", "line", F.size("tokens").alias("n"), "leaf", F.posexplode("tokens").alias("k", "token")).where(F.col("token") != VARIABLE)
    tokens = tokens.select("row", "t1", "t2", "line", "n", "leaf", F.xxhash64("leaf", "k", "token").alias("place"))
    constants = scratch.save(several(tokens, "place"), "constants")
    # places differ within a line, so the exclusive or of their hashes names their set
    known = tokens.join(small(constants), "place", "left_semi").groupBy("row", "t1", "t2", "line", "n", "leaf").agg(F.bit_xor("place").alias("fields"), F.count("*").alias("fixed"))
    shaped = known.where(F.col("fixed") >= constant * F.col("n")).select("t1", "t2", "line", F.xxhash64("leaf", "fixed", "fields").alias("template"))
    shaped = scratch.save(shaped, "shaped")
    recurring = scratch.save(several(shaped, "template"), "templates")
    found = shaped.join(small(recurring), "template", "left_semi").groupBy("t1", "t2").agg(F.collect_set("line").alias("_dropped"))
    found = scratch.save(found.withColumnsRenamed({"t1": "_t1", "t2": "_t2"}), "dropped")
    scratch.keep_only(found)

    own = F.col("text").cast("string")
    each = docs.drop("n_lines", "n_removed").withColumns({"_k1": F.xxhash64(own), "_k2": F.xxhash64(F.lit(1), own)})
    numbers = found.agg(F.sum(F.size("_dropped") + 4)).first()[0] or 0  # what a row holds, in numbers of 8 bytes at most
    out = each.join(bounded_broadcast(found, numbers, BROADCAST_NUMBERS), (F.col("_k1") == F.col("_t1")) & (F.col("_k2") == F.col("_t2")), "left")
    out = out.withColumn("_lines", F.split(own, "\n"))
    n_lines = F.coalesce(F.size(F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0))
    out = out.withColumn("n_lines", n_lines.cast("long")).withColumn("n_removed", F.coalesce(F.size("_dropped"), F.lit(0)).cast("long"))
    out = out.withColumn("n_removed", F.when(F.col("n_removed") <= most_share * F.col("n_lines"), F.col("n_removed")).otherwise(0))
    kept = F.array_join(F.filter("_lines", lambda x, i: ~F.array_contains("_dropped", i)), "\n")
    text = F.when(F.col("n_removed") > 0, kept).otherwise(own)
    return out.withColumn("text", text).drop("_k1", "_k2", "_t1", "_t2", "_lines", "_dropped")
