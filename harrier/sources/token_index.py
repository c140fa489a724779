"""An index beside a Parquet table that tells which of its files hold a token, so that searches for words read only these.

An entry is a token's hash and a file. Entries lie in folders by the hash, sorted
within, so a lookup reads a few row groups. Files that aren't indexed
yet are always searched: the index only spares work, the rows are the scan's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.functions import predicates as P

from .snapshots import Snapshots

SPLIT = r"[^\p{L}\p{N}]+"


def _file():
    """A row's file, as inputFiles writes it."""
    return F.regexp_replace("_metadata.file_path", "^file:/+", "file:///")


class TokenIndex:
    """Index of the text column of a Parquet table, kept under ``root``.

    ``buckets`` folders hold the entries of a batch; more for larger tables. Up to
    ``most_batches`` batches stay apart, then ``refresh`` merges them.
    A file that the table lost matches nothing; a file that is rewritten under its old name must
    not be: tables are appended to and replaced by new files.
    """

    def __init__(self, spark: SparkSession, table: str, column: str, root: str, buckets: int = 64, most_batches: int = 16):
        self.spark, self.table, self.column = spark, table, column
        self.buckets, self.most_batches, self.snapshots = buckets, most_batches, Snapshots(spark, root)

    def _bucket(self, token):
        return F.pmod(token, F.lit(self.buckets)).cast("int")

    def _entries(self, batches: list[str]) -> DataFrame:
        return self.spark.read.schema("token long, file string, batch string, bucket int").option("basePath", f"{self.snapshots.root}/").parquet(*(f"{self.snapshots.root}/{b}" for b in batches))

    def _write(self, entries: DataFrame) -> str:
        """token, file -> a new batch's folder."""
        name = f"batch={uuid.uuid4().hex}"
        placed = entries.withColumn("bucket", self._bucket(F.col("token")))
        placed.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{self.snapshots.root}/{name}")
        return name

    def refresh(self) -> int:
        """Index the files that the table has and the index doesn't; how many these were. Batches are merged where they have become many."""
        known = set(self.snapshots.latest()[1].get("files", []))
        new = [f for f in self.spark.read.parquet(self.table).inputFiles() if f not in known]
        if new:
            rows = self.spark.read.parquet(*new).select(_file().alias("file"), F.explode(F.array_distinct(F.split(F.lower(self.column), SPLIT))).alias("word"))
            entries = rows.where(F.length("word") > 1).select(F.xxhash64("word").alias("token"), "file").distinct()
            name = self._write(entries)
            self.snapshots.change(lambda c: {"files": sorted({*c.get("files", []), *new}), "batches": [*c.get("batches", []), name]})
        if len(self.snapshots.latest()[1].get("batches", [])) > self.most_batches:
            self.compact()
        return len(new)

    def compact(self) -> None:
        """Merge all batches into one; entries of files that the table lost go."""
        number, content = self.snapshots.latest()
        there = set(self.spark.read.parquet(self.table).inputFiles())
        files = self.spark.createDataFrame([(f,) for f in content["files"] if f in there], "file string")
        name = self._write(self._entries(content["batches"]).select("token", "file").distinct().join(files, "file", "left_semi"))
        self.snapshots.commit(number, {"files": [f for f in content["files"] if f in there], "batches": [name]})
        self.snapshots.delete(*content["batches"])

    def files(self, text: str, most: int = 100_000) -> list[str] | None:
        """The table's files that may hold all tokens of the text; None if that is all of them, or more than ``most``."""
        words, content = sorted(set(P.tokens_of(text))), self.snapshots.latest()[1]
        if not words or not content:
            return None
        hashed = self.spark.range(1).select(*(F.xxhash64(F.lit(w)).alias(f"h{k}") for k, w in enumerate(words))).first()
        places = sorted({h % self.buckets for h in hashed})
        hits = self._entries(content["batches"]).where(F.col("bucket").isin(places) & F.col("token").isin(list(hashed)))
        full = hits.groupBy("file").agg(F.count_distinct("token").alias("n")).where(F.col("n") == len(words)).select("file")
        found = {r.file for r in full.limit(most + 1).collect()}
        if len(found) > most:
            return None
        indexed = set(content["files"])
        return [f for f in self.spark.read.parquet(self.table).inputFiles() if f in found or f not in indexed]

    def search(self, text: str) -> DataFrame:
        """The table's rows whose column holds all tokens of the text, as a scan gives them."""
        table, files = self.spark.read.parquet(self.table), self.files(text)
        if files is not None:
            table = self.spark.read.schema(table.schema).option("basePath", self.table).parquet(*files) if files else table.where("false")
        return table.where(P.has_tokens(F.col(self.column), text))
