"""A corpus pipeline over the documents table: rules, lines, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.llm import minhash, mixing, packing, quality, templates
from harrier.llm.common import Scratch, bounded_broadcast

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BROADCAST_IDS = 2_000_000


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number for each row, written so that it stays; doc_ids may be null or repeat."""
    return Scratch(docs.sparkSession, "numbered").save(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    A verdict holds for a text of a language and source, so two hashes of these name the rows that go; doc_ids may be null or repeat.
    """
    told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    key = F.struct(*(F.xxhash64(F.lit(k), told("text"), told("lang"), told("source")).alias(f"k{k}") for k in (1, 2)))
    scratch = Scratch(spark, "quality")
    verdicts = quality.quality_rules(docs.select(key.alias("doc_id"), "text", "lang", "source"), scratch=scratch)
    gone = scratch.save(verdicts.where("NOT kept").select(F.col("doc_id").alias("key")).distinct(), "rejected")
    scratch.keep_only(gone)
    rows = docs.select(*COLUMNS, key.alias("key"))
    return rows.join(bounded_broadcast(gone, gone.count(), BROADCAST_IDS), "key", "left_anti").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template recurs.

    Every row stays, with null or repeated doc_ids too: rows with one text are cleaned alike. A null
    text stays null, one whose lines all recur becomes empty.
    """
    cleaned = templates.drop_recurring_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id; of several, the one with the least hash. Rows without a doc_id stay."""
    rows = _numbered(docs)
    named = rows.where("doc_id IS NOT NULL")
    scratch = Scratch(spark, "minhash")
    found = minhash.near_duplicates(named.withColumn("doc_id", F.col("row")), scratch=scratch).select(F.col("doc_id").alias("row"), "component_id")
    first = found.join(named.select("row", "doc_id", F.xxhash64("text").alias("h")), "row").groupBy("component_id").agg(F.min(F.struct("doc_id", "h", "row")).alias("first"))
    stay = scratch.save(first.select("first.row").union(rows.where("doc_id IS NULL").select("row")), "kept")
    scratch.keep_only(stay)
    return rows.join(bounded_broadcast(stay, stay.count(), BROADCAST_IDS), "row", "left_semi").select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: texts repeated or cut to meet each source's budget of words.

    A row's text comes once for each whole epoch and cut once at most; rows of which nothing is taken, such as
    null and empty texts, are left out. Rows are ordered by a hash of their doc_id, then by text, so ties are
    equal rows; a null source is a source.
    """
    mixed = mixing.materialize(mixing.mix_sources(docs), COLUMNS)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024 tokens.

    A null or empty text is one piece, its end-of-text id. Rows that repeat are documents of
    their own, told apart by their places; doc_ids may be null.
    """
    return packing.pack(packing.tokenize(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None  # SQL has no concentration steps, MinHash trees or best-fit packing


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
