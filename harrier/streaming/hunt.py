"""Streaming hunts: filters, tumbling counts, first-seen keys and checked ingestion on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.functions.predicates import span
from harrier.sources.observations import MOST_BYTES


def realtime_filter(stream: DataFrame, predicate: Column) -> DataFrame:
    """A realtime rule is a filter alone; anything more belongs into a batch hunt."""
    return stream.where(predicate)


def admit(commands: list[str]) -> None:
    """Raises ValueError for a realtime rule that has pipe commands."""
    if commands:
        raise ValueError(f"realtime rules take a search only, not: {', '.join(commands)}")


def timechart(stream: DataFrame, ts: str, width: str, by: str, late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window and series; rows later than the watermark are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, span(width)), by).agg(F.count("*").alias("stat")).select(F.col("window.start").alias("bucket"), F.col(by).alias("series"), "stat")


def first_seen(stream: DataFrame, ts: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def checked(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of NDJSON lines of bounded length by an explicit schema; broken lines are dropped."""
    return lines.where(F.octet_length("value") <= MOST_BYTES).select(F.from_json("value", schema).alias("o")).where("o IS NOT NULL").select("o.*")


def each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``act(rows, batch id)`` on every micro-batch and returns the query. A batch comes again after a failure, with its id, so that act can tell."""
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).start()
