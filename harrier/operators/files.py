"""File inventories of a fleet: profiles, differences from the other hosts, rare files, clusters, and the verdict on each host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.functions import scalars as S
from harrier.operators import fleet
from harrier.storage import Scratch

FLAGS = ("is_suspicious", "is_world", "is_group", "is_recent", "is_root")
TEXTS = ("permissions", "owner", "group")


def baseline_path(path: Column) -> Column:
    """Paths whose owner, group and size are the same on all hosts of a like fleet."""
    return S.starts_any(path, ["/etc/", "/var/log/"]) | path.contains("/bin/") | path.contains("/sbin/")


def owned_by(uid: Column, owner: Column) -> Column:
    """uid; where it is 0, what the owner says: a number is the uid, any other name leaves 0."""
    uid = F.coalesce(uid.cast("long"), F.lit(0))
    return F.when(uid != 0, uid).otherwise(F.coalesce(F.trim(owner).try_cast("long"), uid))


def flagged(files: DataFrame) -> DataFrame:
    """files with euid and FLAGS. Needs machine_id, path, uid, owner, group, permissions, size, mtime, timestamp, ord; empty texts become null."""
    f = files.withColumns({c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in TEXTS})
    f = f.withColumn("euid", owned_by(F.col("uid"), F.col("owner")))
    f = f.withColumns({"is_suspicious": S.suspicious_path(F.col("path")), "is_world": S.world_writable(F.col("permissions")), "is_group": S.group_writable(F.col("permissions")), "is_root": F.col("euid") == 0})
    recent = S.recently_modified(F.col("path"), F.col("timestamp"), F.col("mtime"), F.col("euid"), F.col("is_suspicious"), F.col("is_world"), F.col("is_group"))
    return f.withColumns({"is_recent": recent, **{c: F.coalesce(F.col(c), F.lit(False)) for c in FLAGS if c != "is_recent"}}).withColumn("is_recent", F.coalesce("is_recent", F.lit(False)))


def profile(f: DataFrame) -> DataFrame:
    """Flagged rows counted by host and signature, its eleven columns."""
    return f.groupBy("machine_id", "path", "euid", *TEXTS, "size", "is_suspicious", "is_world", "is_group", "is_recent").agg(F.count("*").alias("n"))


def last_known(f: DataFrame) -> DataFrame:
    """One row per host and path: time, owner, group and size as the last row that has one says, and FLAGS of any row."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    return f.groupBy("machine_id", "path").agg(*map(last, ("mtime", "owner", "group", "size")), *(F.bool_or(c).alias(c) for c in FLAGS))


def details(known: DataFrame) -> DataFrame:
    """(machine_id, kind, path, detail): what a host has otherwise than the fleet, of paths on three hosts at least.

    Kinds: mtime (over 24 hours from the median), metadata (owner, group or
    size off a majority of two at least, of ``baseline_path``s), access and
    recent (the smaller side of a flag). known: rows of ``last_known``.
    """
    host, path = F.col("machine_id"), F.col("path")
    times = fleet.median_outliers(known.select("machine_id", "path", "mtime"), "machine_id", "path", "mtime", signed=True)
    side = F.when(F.col("hours_apart") > 0, "NEWER").otherwise("OLDER")
    found = times.select(host, F.lit("mtime").alias("kind"), path, F.concat(F.lit("MTIME ANOMALY: "), path, F.lit(" modified "), F.abs("hours_apart"), F.lit("h "), side, F.lit(" than fleet baseline")).alias("detail"))
    base = known.where(baseline_path(path))
    for c in ("owner", "group"):
        odd = fleet.majority_outliers(base, "machine_id", "path", c)
        found = found.union(odd.select(host, F.lit("metadata"), path, F.concat(F.lit(f"METADATA ANOMALY: {c} on "), path, F.lit(" is '"), F.col(c), F.lit("' (fleet majority: '"), "majority", F.lit("')"))))
    odd = fleet.majority_outliers(base, "machine_id", "path", "size")
    found = found.union(odd.select(host, F.lit("metadata"), path, F.concat(F.lit("METADATA ANOMALY: size on "), path, F.lit(" is "), "size", F.lit(" bytes (fleet majority: "), "majority", F.lit(" bytes)"))))
    sides = (  # flag, kind, rows compared, texts around the path where the host has the flag, and where it hasn't
        ("is_root", "access", known.where(~S.starts_any(path, ["/proc", "/sys"])), ("root UID access to ", "", "use non-root for this path"), ("non-root access to ", "", "use root for this path")),
        ("is_world", "access", known, ("world-writable ", "", "are not world-writable"), ("non-world-writable ", "", "see world-writable mode")),
        ("is_group", "access", known.where(path.contains("/etc") | path.contains("/tmp")), ("group-writable ", " under /etc or /tmp", "are not group-writable"), ("not group-writable ", "", "see group-writable on this path")),
        ("is_recent", "recent", known, ("mtime close to access on ", "", "do not show this pattern"), ("no recent mtime-at-access signal on ", "", "do")),
    )
    for flag, kind, of, yes, no in sides:
        few = fleet.minority_flags(of, "machine_id", "path", F.col(flag))

        def told(texts, most):
            return F.concat(F.lit(f"FLEET OUTLIER: {texts[0]}"), path, F.lit(f"{texts[1]} - "), most, F.lit(" of "), F.col("yes") + F.col("no"), F.lit(f" hosts {texts[2]} (minority)"))

        found = found.union(few.select(host, F.lit(kind), path, F.when(F.col("flag"), told(yes, F.col("no"))).otherwise(told(no, F.col("yes")))))
    return found


def buckets(f: DataFrame, metadata: bool = False, size: bool = False, recent: bool = False) -> DataFrame:
    """Signatures that count as one across the fleet: (machine_id, sig, path, euid, n, FLAGS of any row), one row per host and bucket."""
    kept = ["path", "euid", "is_suspicious", *((*TEXTS, "is_world", "is_group") if metadata else ()), *(["size"] if size else ()), *(["is_recent"] if recent else ())]
    sig = F.to_json(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in kept)))
    risk = (F.bool_or(c).alias(c) for c in FLAGS)
    return f.withColumn("sig", sig).groupBy("machine_id", "sig", "path", "euid").agg(F.count("*").alias("n"), *risk)


def off_baseline(b: DataFrame, known: DataFrame, fraction: float = 1.0, bucket_seconds: int = 86_400, spare_suspicious: bool = True) -> DataFrame:
    """Buckets without those that ceil(fraction of all) hosts have with a time in the same ``bucket_seconds``; suspicious paths stay if asked."""
    times = known.select("machine_id", "path", F.floor(F.unix_seconds(F.col("mtime").cast("timestamp")) / bucket_seconds).alias("_at"))
    rows = b.join(times, ["machine_id", "path"], "left").withColumn("_print", F.struct("sig", F.coalesce("_at", F.lit(-1)).alias("at")))
    asked = rows.where(~F.col("is_suspicious")) if spare_suspicious else rows
    hosts = rows.select(F.count_distinct("machine_id").alias("_hosts"))  # one row
    common = asked.groupBy("_print").agg(F.count_distinct("machine_id").alias("_df")).crossJoin(F.broadcast(hosts)).where((F.col("_hosts") > 1) & (F.col("_df") >= F.ceil(F.col("_hosts") * fraction)))
    return rows.join(common.select("_print"), "_print", "left_anti").select(*b.columns)


def rare(counted: DataFrame, risky: bool = True) -> DataFrame:
    """Buckets of one host only, with ``priority`` and ``detail``; with ``risky`` only those worth a look."""
    flags = [F.col(c) for c in FLAGS]
    alone = counted.groupBy("sig").agg(F.count("*").alias("_df")).where("_df = 1").select("sig")
    out = counted.join(alone, "sig", "left_semi")
    out = out.where(S.rare_file_interesting(F.col("path"), *flags)) if risky else out
    return out.withColumn("priority", S.rare_file_priority(F.col("path"), *flags)).withColumn("detail", F.concat(F.lit("Rare file access: "), "path", S.rare_file_qualifier(*flags)))


def clusters(b: DataFrame, counted: DataFrame, most: int = 8000, eps: float = 0.35, least: int = 2) -> DataFrame:
    """(machine_id, cluster): density clusters by TF-IDF of the rarest ``most`` buckets that some hosts have, but not one only and not all. Shares are of all a host's rows; hosts with no such bucket are one place."""
    scratch = Scratch(b.sparkSession, "file-clusters")
    hosts = scratch.save(b.groupBy("machine_id").agg(F.sum("n").alias("_rows")), "hosts")
    n = hosts.count()
    df = counted.groupBy("sig").agg(F.count("*").alias("_df")).where((F.col("_df") > 1) & (F.col("_df") < n)).orderBy("_df", "sig").limit(most)
    v = b.join(df, "sig").join(hosts, "machine_id").select("machine_id", "sig", (F.col("n") / F.col("_rows") * (F.log(F.lit(float(n)) / F.col("_df")) + 1)).alias("w"))
    length = v.groupBy("machine_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_length"))
    v = scratch.save(v.join(length, "machine_id").select("machine_id", "sig", (F.col("w") / F.col("_length")).alias("w")), "vectors")
    empty = hosts.join(v.select("machine_id"), "machine_id", "left_anti")
    place = empty.agg(F.min("machine_id").alias("m"), F.count("*").alias("k")).select(F.when(F.col("k") >= least, F.col("m")).alias("cluster"))  # one row
    return fleet.dbscan(v, "machine_id", "sig", eps, least).unionByName(empty.select("machine_id").crossJoin(F.broadcast(place)))


def findings(files: DataFrame, most: int = 20, fraction: float | None = None, risky: bool = True, eps: float = 0.35, least: int = 2, features: int = 8000) -> tuple[DataFrame, DataFrame]:
    """(verdicts, details): (machine_id, severity, distance, cluster, n, suspicious, more) of hosts that stand out, and (machine_id, kind, path, detail) rows behind them.

    Rare files: the first ``most`` of each host by priority are details,
    ``more`` counts the rest. With ``fraction`` files that so many hosts have
    with the same day are the fleet's baseline and neither rare nor features.
    Null paths and hosts are left out.
    """
    scratch = Scratch(files.sparkSession, "file-fleet")
    f = scratch.save(flagged(files.where("machine_id IS NOT NULL AND path IS NOT NULL")), "flagged")
    known = scratch.save(last_known(f), "known")
    b = scratch.save(buckets(f), "buckets")
    counted = b if fraction is None else scratch.save(off_baseline(b, known, fraction), "counted")
    order = [F.col("priority").desc(), F.col("n").desc(), F.col("path"), F.col("euid"), F.col("sig")]
    shown = scratch.save(fleet.rare_examples(rare(counted, risky), "machine_id", order, most), "rare")
    odd = details(known)
    told = scratch.save(odd.withColumn("weight", F.lit(1).cast("long")).unionByName(shown.select("machine_id", F.lit("rare").alias("kind"), "path", "detail", F.col("n").alias("weight"))), "details")
    has = lambda *kinds: F.coalesce(F.bool_or(F.col("kind").isin(*kinds)), F.lit(False))
    signs = told.groupBy("machine_id").agg(F.sum("weight").alias("suspicious"), has("mtime", "metadata").alias("_off"), has("recent").alias("_recent"))
    beyond = shown.groupBy("machine_id").agg(F.max("more").cast("long").alias("more"))
    places = scratch.save(clusters(b, counted, features, eps, least), "clusters")
    largest = places.where("cluster IS NOT NULL").groupBy("cluster").count().orderBy(F.col("count").desc(), "cluster").first()  # one row
    hosts = b.groupBy("machine_id").agg(F.sum("n").alias("n")).join(places, "machine_id").join(signs, "machine_id", "left").join(beyond, "machine_id", "left")
    noise = F.col("cluster").isNull()
    apart = noise | (F.col("cluster") != F.lit(largest.cluster)) if largest else noise
    off = F.coalesce("_off", F.lit(False))
    severity = F.when(off | F.coalesce("_recent", F.lit(False)) | (F.col("suspicious") > 5), "critical").when(F.col("suspicious") > 0, "high").otherwise("low")
    out = hosts.where(apart | F.col("suspicious").isNotNull()).select(
        "machine_id", severity.alias("severity"), F.when(off, 2.0).when(noise, 1.5).otherwise(0.8).alias("distance"), "cluster", "n",
        F.coalesce("suspicious", F.lit(0)).alias("suspicious"), F.coalesce("more", F.lit(0)).alias("more"))
    return out, told.drop("weight")
