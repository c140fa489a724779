"""Small helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.storage import Scratch, make_folder, shared_dir

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

__all__ = ["SPACE", "WORD", "Scratch", "bounded_broadcast", "bounded_sample", "make_folder", "shared_dir", "table", "words"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text) -> "F.Column":
    """Array of the words of a text, none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def bounded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only if the counted rows are within the limit; else Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


def bounded_sample(df: DataFrame, most: int, *key: str) -> DataFrame:
    """About ``most`` rows of the whole table, and never more than a quarter over that, by a hash of their key and place: rows with one key are drawn one by one.

    The same rows in every run over the same files.
    """
    n = df.count()
    if n <= most:
        return df
    h = F.pmod(F.xxhash64(*key, F.monotonically_increasing_id()), F.lit(1 << 40))
    return df.withColumn("_drawn", h).where(F.col("_drawn") < int((1 << 40) * most / n)).drop("_drawn").limit(most + most // 4)
