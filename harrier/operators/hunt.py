"""Hunting operators over an event table: DataFrame in, DataFrame out.

Each pipe command of the hunting language is one function, to be chained with
``DataFrame.transform``; the text of the language itself isn't parsed here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrier.functions import predicates as P

AGGREGATES = {
    "count": lambda c: F.count("*"), "dc": F.count_distinct, "distinct_count": F.count_distinct, "values": lambda c: F.array_sort(F.collect_set(c)),
    "list": lambda c: F.array_sort(F.collect_list(c)), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev, "median": F.median,
}


@dataclass
class FieldCatalog:
    """Names of query fields: columns or aliases of them; all other names are read from a JSON column."""

    columns: dict[str, str]
    ext: str | None = None
    numeric: set[str] = field(default_factory=lambda: set(P.NUMERIC))

    def resolve(self, name: str) -> Column:
        if name in self.columns:
            return F.col(self.columns[name])
        if self.ext is None:
            raise KeyError(f"no field {name}")
        return F.coalesce(F.get_json_object(self.ext, f"$.{name}"), F.lit(""))


def aggregate(fn: str, c: str | None) -> Column:
    """One aggregate by its name; approx_dc is the sketch for counts that need not be exact."""
    if fn == "approx_dc":
        return F.approx_count_distinct(c)
    if fn not in AGGREGATES:
        raise ValueError(f"unknown aggregate {fn}")
    return AGGREGATES[fn](F.col(c) if c else None)


def stats(df: DataFrame, fn: str = "count", c: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One aggregate as ``stat``, by groups or over all."""
    return df.groupBy(*by).agg(aggregate(fn, c).alias("stat"))


def head(df: DataFrame, n: int, ts: str | None = "ts", *tie: str) -> DataFrame:
    """The newest n rows; with ts None the first n of an input that is ordered already."""
    return df.limit(n) if ts is None else df.orderBy(F.col(ts).desc(), *tie).limit(n)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.select(F.col(old).alias(new), *(c for c in df.columns if c not in (old, new)))


def evaluate(df: DataFrame, name: str, expression: str | Column) -> DataFrame:
    """Adds or overwrites a column by a SQL expression."""
    return df.withColumn(name, F.expr(expression) if isinstance(expression, str) else expression)


def rex(df: DataFrame, name: str, pattern: str, c: str = "message") -> DataFrame:
    """The first capture group, all of the match where there is none, '' without a match."""
    import re

    return df.withColumn(name, F.regexp_extract(c, pattern, 1 if re.compile(pattern).groups else 0))


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join with a dimension's attributes; their defaults where the key is unknown. Spark broadcasts it where its size allows."""
    attrs = dim.select(F.col(dim_key).alias("_key"), *(F.col(c).alias("_d_" + c) for c in defaults))
    joined = df.join(attrs, df[key] == attrs["_key"], "left")
    return joined.select(*df.columns, *(F.coalesce(F.col("_d_" + c), F.lit(v)).alias(c) for c, v in defaults.items()))


def dedup(df: DataFrame, *by: str, ts: str = "ts", tie: tuple[str, ...] = ()) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*by).orderBy(F.col(ts).desc(), *tie)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def join_left_columns(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Left columns only, once for each match; empty and null keys match nothing."""
    keys = right.where(P.present(F.col(key))).select(F.col(key).alias("_k"))
    return left.join(keys, (left[key] == keys["_k"]) & P.present(left[key]), how).select(*left.columns)


def timechart(df: DataFrame, width: str, fn: str = "count", c: str | None = None, by: str | None = None, limit: int = 10, other: bool = True, ts: str = "ts") -> DataFrame:
    """(bucket, series, stat): the ``limit`` series with the largest totals over all buckets (0: all), the rest as Other or dropped.

    The rest is computed from its rows, so averages and extremes of Other are true ones.
    """
    base = df.withColumn("bucket", F.window(ts, P.span(width))["start"])
    base = base.withColumn("series", F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("all"))
    if by and limit:
        # totals as count or sum of the metric; the name breaks ties
        rank = F.count("*") if fn == "count" else F.sum(c)
        top = base.groupBy("series").agg(rank.alias("_total")).orderBy(F.col("_total").desc(), "series").limit(limit).select("series", F.lit(True).alias("_top"))
        base = base.join(top, "series", "left")
        base = base.withColumn("series", F.when(F.col("_top"), F.col("series")).otherwise("Other")) if other else base.where("_top")
    return base.groupBy("bucket", "series").agg(aggregate(fn, c).alias("stat"))


def histogram(df: DataFrame, minutes: int, ts: str = "ts") -> DataFrame:
    """Rows per bucket of 1 to 1440 minutes."""
    width = f"{min(1440, max(1, minutes))} minutes"
    return df.groupBy(F.window(ts, width)["start"].alias("bucket")).agg(F.count("*").alias("n"))


def capped(df: DataFrame, rows: int = 1000, most: int = 10_000) -> DataFrame:
    """The interface's row cap."""
    return df.limit(min(rows, most))


def newest_labelled(scans: DataFrame, tags: list[str], by: str = "host_id", ts: str = "finished_at", labels: dict[str, str] | None = None, first=None, last=None, tie: str | None = None) -> DataFrame:
    """The newest scan of each host that carries all tags, finished within the bounds (both included), on hosts whose labels (a map column) equal the given ones.

    Of scans of one time the one with the greatest ``tie`` counts, where that is given.
    """
    out = scans.where(F.forall(F.array(*map(F.lit, tags)).cast("array<string>"), lambda t: F.array_contains("tags", t)))
    for key, value in (labels or {}).items():
        out = out.where(F.coalesce(F.element_at("labels", F.lit(key)) == value, F.lit(False)))
    for bound, op in ((first, ">="), (last, "<=")):
        if bound is not None:
            at = F.lit(bound).cast("timestamp")
            out = out.where(F.col(ts) >= at if op == ">=" else F.col(ts) <= at)
    if tie is None:
        return dedup(out, by, ts=ts)
    w = Window.partitionBy(by).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return out.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def visualisation(columns: list[str], rows: int) -> str:
    """How a result is best shown."""
    if {"bucket", "series"} <= set(columns):
        return "timechart"
    if "stat" in columns:
        return "single_value" if columns == ["stat"] and rows == 1 else "stats"
    return "table"
