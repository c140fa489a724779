"""Sinks: partitioned tables, latest-wins upserts, retention, exports and routed alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.operators.triage import latest, route


def append_events(events: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Appends to a table partitioned by day and sorted for scans of one host."""
    by_day = events.withColumn("event_date", F.to_date(ts))
    by_day.repartition("event_date", "host_id").sortWithinPartitions("platform", "host_id", ts).write.mode("append").partitionBy("event_date").option("parquet.bloom.filter.enabled#host_id", "true").parquet(path)


def scan_events(spark, path: str, start=None, end=None, ts: str = "timestamp") -> DataFrame:
    """Events within the bounds; the days that can hold them are picked by partition."""
    df = spark.read.parquet(path)
    for bound, op in ((start, "ge"), (end, "le")):
        if bound is not None:
            day, t = F.to_date(F.lit(bound)), F.lit(bound).cast("timestamp")
            df = df.where((F.col("event_date") >= day) & (F.col(ts) >= t)) if op == "ge" else df.where((F.col("event_date") <= day) & (F.col(ts) <= t))
    return df


def upserted(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Newest version of each key over table and changes, tombstones gone."""
    return latest(table.unionByName(changes), keys, version)


def merged_keys(known: DataFrame, seen: DataFrame) -> DataFrame:
    """(fingerprint, last_seen, tags) with the latest time and all tags, each tag once before and after the shuffle."""
    both = known.unionByName(seen)
    tags = both.select("fingerprint", F.explode("tags").alias("t")).groupBy("fingerprint").agg(F.array_sort(F.collect_set("t")).alias("tags"))
    latest_ = both.groupBy("fingerprint").agg(F.max("last_seen").alias("last_seen"))
    return latest_.join(tags, "fingerprint", "left").select("fingerprint", "last_seen", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def merged_placements(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Placements by fingerprint, host_id, username and role (authorized where it is empty): the latest by seen_at replaces the whole row. Rows without a fingerprint are left out."""
    both = known.unionByName(seen).where(F.trim(F.coalesce("fingerprint", F.lit(""))) != "")
    both = both.withColumn("role", F.coalesce(F.nullif("role", F.lit("")), F.lit("authorized")))
    return latest(both, ["fingerprint", "host_id", "username", "role"], "seen_at", "path", deleted=None)


def merged_precedents(known: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """(detector, reason, verdict, reviewed_at, machine_id, updated_at): known precedents, replaced or extended by verdicts that are set.

    decisions: detector, reason, verdict, reviewed_at, machine_id. Of several decisions on one
    reason the last reviewed counts. Unset verdicts and empty detectors say nothing.
    """
    new = decisions.withColumn("detector", F.trim("detector")).where("verdict IS NOT NULL AND verdict <> 'unset' AND detector <> ''")
    new = latest(new, ["detector", "reason"], "reviewed_at", "machine_id", "verdict", deleted=None).withColumn("updated_at", now)
    columns = ["detector", "reason", "verdict", "reviewed_at", "machine_id", "updated_at"]
    old = known.join(new.select("detector", "reason"), ["detector", "reason"], "left_anti")
    return old.select(*columns).union(new.select(*columns))


def without(table: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys aren't listed for deletion."""
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def retained(table: DataFrame, now, ts: str = "timestamp", days: int = 90) -> DataFrame:
    return table.where(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS"))


def report_json(found: DataFrame) -> DataFrame:
    """One JSON text per host of an outlier report."""
    return found.select(F.to_json(F.struct(*found.columns)).alias("value"))


def export_lines(rows: DataFrame, kind: str, path: str) -> None:
    """JSON lines with the field names that rule engines expect."""
    names = {"process": {"machine_id": "Computer", "name": "ProcessName", "path": "Image", "args": "CommandLine", "pid": "ProcessId", "ppid": "ParentProcessId"}, "file": {"machine_id": "Computer", "path": "TargetFilename", "mtime": "CreationUtcTime"}}[kind]
    rows.withColumnsRenamed(names).withColumn("EventKind", F.lit(kind)).write.json(path)


def scored_csv(scored: DataFrame, path: str) -> None:
    scored.withColumn("unusual", F.array_join("unusual", " ")).write.csv(path, header=True)


def save_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def checked_lines(lines: DataFrame, required: tuple[str, ...], most_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(good, rejected with error) of JSON lines: too long, no JSON object, or without a required key."""
    keys = F.json_object_keys("line")
    lacks = F.array_compact(F.array(*(F.when(~F.coalesce(F.array_contains(keys, k), F.lit(False)), F.lit(k)) for k in required)))
    error = F.when(F.octet_length("line") > most_bytes, "too long").when(keys.isNull(), "no JSON object").when(F.size(lacks) > 0, F.concat(F.lit("missing "), F.array_join(lacks, ",")))
    marked = lines.withColumn("error", error)
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL")


def write_alerts(findings: DataFrame, least: str, path: str) -> None:
    """Alerts of at least the severity as JSON lines."""
    route(findings, least).write.mode("append").json(path)
