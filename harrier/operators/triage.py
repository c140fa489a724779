"""Findings after detection: status, verdict precedents, retention, routing and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrier.functions import scalars as S

MUTED = "false_positive"


def latest(rows: DataFrame, keys: list[str], version: str, *tie: str, deleted: str | None = "deleted") -> DataFrame:
    """The newest version of each key; keys whose newest version is a tombstone are gone."""
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc(), *tie)
    out = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return out.where(F.col(deleted) == 0) if deleted else out


def retain_newest(scans: DataFrame, host: str, ts: str, n: int, *tie: str) -> DataFrame:
    """The newest n scans of each host."""
    w = Window.partitionBy(host).orderBy(F.col(ts).desc(), *tie)
    return scans.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def cascade(children: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Child rows whose scan is kept."""
    return children.join(kept.select(key), key, "left_semi")


def latest_of_kind(rows: DataFrame, scans: DataFrame, host: str, kind: str, ts: str) -> DataFrame:
    """Rows of the newest scan of each host that has the kind."""
    newest = scans.where(F.col("kind") == kind).groupBy(host).agg(F.max_by("scan_id", ts).alias("scan_id"))
    return rows.join(newest, [host, "scan_id"], "left_semi")


def nth_newest(rows: DataFrame, host: str, ts: str, n: int, *tie: str) -> DataFrame:
    """The n-th newest row of each host; rows of one time are ordered by the columns ``tie``."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(host).orderBy(F.col(ts).desc(), *tie))).where(F.col("_rn") == n).drop("_rn")


def inherit_status(incoming: DataFrame, known: DataFrame, keys: list[str], muted: Column | None = None) -> DataFrame:
    """incoming with the status of muted findings of the same host and check."""
    muted = F.col("status") == MUTED if muted is None else muted
    hits = known.where(muted).select(*keys, F.lit(MUTED).alias("_m")).distinct()
    return incoming.join(hits, keys, "left").withColumn("status", F.coalesce("_m", "status")).drop("_m")


def set_status(findings: DataFrame, id_: str, status: str) -> DataFrame:
    """A verdict on one finding: false positives mute all of the host and check, ``new`` lifts muted ones there, anything else is for that one alone."""
    target = findings.where(F.col("id") == id_).select("host_id", "check_id", F.lit(True).alias("_same"))
    out = findings.join(F.broadcast(target.limit(1)), ["host_id", "check_id"], "left")  # one row
    same, own = F.coalesce("_same", F.lit(False)), F.col("id") == id_
    liftable = F.col("status").isin(MUTED, "suppressed", "new")
    hit = {MUTED: same, "new": (same & liftable) | own}.get(status, own)
    return out.withColumn("status", F.when(hit, status).otherwise(F.col("status"))).select(*findings.columns)


def findings_list(findings: DataFrame, n: int, host: str | None = None, severity: str | None = None) -> DataFrame:
    out = findings.where(F.col("host_id") == host) if host else findings
    out = out.where(F.col("severity") == severity) if severity else out
    return out.orderBy(F.col("last_seen").desc(), F.col("first_seen").desc(), F.col("id").desc()).limit(n)


def route(findings: DataFrame, least: str) -> DataFrame:
    """Findings of at least the severity."""
    return findings.where(S.severity_rank(F.col("severity")) >= S.severity_rank(F.lit(least)))


def honeycomb(hosts: DataFrame, findings: DataFrame) -> DataFrame:
    """(host_id, severity, score, n) of every host known or with findings; hosts without any are clean."""
    every = hosts.select("host_id").union(findings.select("host_id")).distinct()
    worst = findings.groupBy("host_id").agg(F.max_by("severity", S.severity_rank(F.col("severity"))).alias("severity"), F.max("score").alias("score"), F.count("*").alias("n"))
    return every.join(worst, "host_id", "left").select("host_id", F.coalesce("severity", F.lit("clean")).alias("severity"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n", F.lit(0)).alias("n"))


def group_verdict(findings: DataFrame, *by: str) -> DataFrame:
    """Per group: malicious if any is, else unset if any is, else false positive."""
    verdict = F.when(F.bool_or(F.col("verdict") == "malicious"), "malicious").when(F.bool_or(F.coalesce(F.col("verdict"), F.lit("unset")) == "unset"), "unset").otherwise(MUTED)
    return findings.groupBy(*by).agg(verdict.alias("verdict"), F.count("*").alias("n"))


def effective_score(findings: DataFrame) -> DataFrame:
    """(host_id, score): 0 where all groups are false positives, else the raw score."""
    groups = group_verdict(findings, "host_id", "detector", "grp").groupBy("host_id").agg(F.bool_and(F.col("verdict") == MUTED).alias("clear"))
    raw = findings.groupBy("host_id").agg(F.max("score").alias("raw"))
    return raw.join(groups, "host_id").select("host_id", F.when(F.col("clear"), 0.0).otherwise(F.col("raw")).alias("score"))


def newest_precedents(history: DataFrame, *tie: str) -> DataFrame:
    """(detector, reason, verdict): the newest verdict that is set."""
    w = Window.partitionBy("detector", "reason").orderBy(F.col("at").desc(), *tie)
    set_ = history.where("verdict IS NOT NULL AND verdict <> 'unset'")
    return set_.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("detector", "reason", "verdict")


def apply_precedents(findings: DataFrame, precedents: DataFrame, ignored: DataFrame) -> DataFrame:
    """Unset verdicts from the exact precedent, then from that of the process group; the ignore list is left alone."""
    key = S.triage_group(F.col("detector"), F.col("reason"))
    exact = precedents.select("detector", "reason", F.col("verdict").alias("_e"))
    group = precedents.select(key.alias("_g"), F.col("verdict").alias("_v")).groupBy("_g").agg(F.max("_v").alias("_v"))
    skip = ignored.select("detector", "reason", F.lit(True).alias("_skip")).distinct()
    out = findings.withColumn("_g", key).join(exact, ["detector", "reason"], "left").join(group, "_g", "left").join(skip, ["detector", "reason"], "left")
    unset = (F.coalesce("verdict", F.lit("unset")) == "unset") & F.col("_skip").isNull()
    return out.withColumn("verdict", F.when(unset, F.coalesce("_e", "_v", "verdict")).otherwise(F.col("verdict"))).select(*findings.columns)


def unify_verdicts(findings: DataFrame) -> DataFrame:
    """Every finding of a host, detector and group gets the group's verdict; ``final`` where the host has exactly one group and its verdict is set."""
    g = group_verdict(findings, "host_id", "detector", "grp").withColumnRenamed("verdict", "_v").drop("n")
    one = g.groupBy("host_id").agg(F.count("*").alias("_groups"))
    out = findings.join(g, ["host_id", "detector", "grp"]).join(one, "host_id").withColumn("verdict", F.col("_v"))
    return out.withColumn("final", (F.col("_groups") == 1) & (F.col("verdict") != "unset")).drop("_v", "_groups")


def stamp_reviews(before: DataFrame, after: DataFrame, now: Column) -> DataFrame:
    """after with reviewed_at: now where the verdict changed, the latest time of the group for all its findings."""
    old = before.select("id", F.col("verdict").alias("_old"), F.col("reviewed_at").alias("_at"))
    out = after.drop("reviewed_at").join(old, "id", "left")
    out = out.withColumn("_at", F.when(~F.col("verdict").eqNullSafe(F.col("_old")), now).otherwise(F.col("_at")))
    return out.withColumn("reviewed_at", F.max("_at").over(Window.partitionBy("host_id", "detector", "grp"))).drop("_old", "_at")


def review_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.col("score").desc(), S.severity_rank(F.col("severity")).desc(), "host_id")


def due_scans(hosts: DataFrame, active: DataFrame, now: Column) -> DataFrame:
    """Enabled hosts whose interval and jitter have passed since their last scan and that have no active one. hosts: host_id, enabled, every, last_scan."""
    interval = S.interval_seconds(F.col("every"))
    jitter = F.pmod(F.xxhash64("host_id"), F.greatest(F.lit(1), F.floor(interval / 10)))
    due = F.col("last_scan").isNull() | (F.unix_seconds(now) >= F.unix_seconds("last_scan") + interval + jitter)
    return hosts.where(F.col("enabled") & interval.isNotNull() & due).join(active.select("host_id").distinct(), "host_id", "left_anti")


def lease(jobs: DataFrame, capacity: int) -> DataFrame:
    return jobs.where("status = 'queued'").orderBy(F.col("priority").desc(), "created_at", "id").limit(capacity)


def examples(rows: DataFrame, wanted: DataFrame, keys: list[str], host: str, most: int = 5) -> DataFrame:
    """The first stored row for each wanted key, at most five for a host."""
    first = rows.join(wanted.select(*keys).distinct(), keys, "left_semi").withColumn("_a", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).where("_a = 1")
    return first.withColumn("_b", F.row_number().over(Window.partitionBy(host).orderBy("ord"))).where(F.col("_b") <= most).drop("_a", "_b")
