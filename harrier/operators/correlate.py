"""Correlators: shared keys and credentials, drift from a baseline, views that disagree, integrity, indicators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrier.functions import scalars as S
from harrier.functions.predicates import sure

# -- keys and credentials


def reused_keys(placements: DataFrame, key: str = "fingerprint", host: str = "host_id", user: str = "username", least_hosts: int = 2) -> DataFrame:
    """Keys on at least two hosts, with sorted hosts and users."""
    out = placements.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key)
    out = out.agg(F.array_sort(F.collect_set(host)).alias("hosts"), F.array_sort(F.collect_set(user)).alias("users"))
    return out.where(F.size("hosts") >= least_hosts).withColumn("severity", F.lit("critical"))


def shared_credentials(shadow: DataFrame) -> DataFrame:
    """Password hashes that at least two usable accounts share."""
    usable = shadow.where(~F.col("locked") & ~F.col("empty_password") & F.col("hash_fingerprint").isNotNull())
    out = usable.groupBy("hash_fingerprint").agg(F.array_sort(F.collect_set("username")).alias("users"))
    return out.where(F.size("users") >= 2)


def key_summary(p: DataFrame) -> DataFrame:
    """One row: distinct keys, hosts and users, reused and weak keys. p: fingerprint, host_id, username, key_type, bits."""
    per = p.groupBy("fingerprint").agg(F.count_distinct("host_id").alias("h"), F.max(S.weak_key(F.col("key_type"), F.col("bits"))).alias("weak"))
    keys = per.agg(F.count("*").alias("keys"), F.count_if(F.col("h") >= 2).alias("reused"), F.count_if("weak").alias("weak"))
    return keys.crossJoin(F.broadcast(p.agg(F.count_distinct("host_id").alias("hosts"), F.count_distinct("username").alias("users"))))


def key_rollup(p: DataFrame, by: str) -> DataFrame:
    """Per host or user: placements, distinct keys, weak ones, and the key types seen."""
    return p.groupBy(by).agg(
        F.count("*").alias("placements"), F.count_distinct("fingerprint").alias("keys"),
        F.count_distinct(F.when(S.weak_key(F.col("key_type"), F.col("bits")), F.col("fingerprint"))).alias("weak"),
        F.array_sort(F.collect_set("key_type")).alias("key_types"),
    )


def key_graph(p: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of reused and weak keys and the ``top`` keys with the most hosts: key, host and user nodes.

    Repeated placements go while they are ids, before names are made, in a given number of partitions: adaptive
    execution would merge what is small when shuffled but large in the groups of a task. Ids are strings or whole numbers.
    """
    parts = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    on = p.select("fingerprint", "host_id", S.weak_key(F.col("key_type"), F.col("bits")).alias("weak")).repartition(parts, "fingerprint", "host_id").groupBy("fingerprint", "host_id").agg(F.max("weak").alias("weak"))
    of = p.select("fingerprint", "username").distinct()
    per = on.groupBy("fingerprint").agg(F.count("host_id").alias("h"), F.max("weak").alias("weak"))
    focus = per.where("h >= 2 OR weak").select("fingerprint").union(per.orderBy(F.col("h").desc(), "fingerprint").limit(top).select("fingerprint")).distinct()
    name = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    edge = lambda rows, kind, c, how: rows.join(focus, "fingerprint", "left_semi").select(name("key", "fingerprint").alias("source"), name(kind, c).alias("target"), F.lit(how).alias("kind"))
    edges = edge(on, "host", "host_id", "on").union(edge(of, "user", "username", "of"))
    nodes = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return nodes.withColumn("kind", F.substring_index("id", ":", 1)), edges


def find_keys(p: DataFrame, text: str = "", tag: str | None = None) -> DataFrame:
    """Placements with the text in any of their fields, and the tag."""
    joined = F.lower(F.concat_ws(" ", "fingerprint", "host_id", "username", "key_type", "comment"))
    out = p.where(F.contains(joined, F.lit(text.lower())))
    return out.where(F.array_contains("tags", tag)) if tag else out


def edit_tags(keys: DataFrame, ids: DataFrame, id_col: str, add: list[str] = (), remove: list[str] = (), replace: list[str] | None = None) -> DataFrame:
    """keys with their tags set, extended without repeats, or reduced, for the listed ids."""
    lits = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    marked = keys.join(ids.select(id_col, F.lit(True).alias("_hit")).distinct(), id_col, "left")
    base = lits(replace) if replace is not None else F.coalesce("tags", lits([]))
    new = F.array_sort(F.array_except(F.array_union(base, lits(add)), lits(remove)))
    return marked.withColumn("tags", F.when(F.col("_hit"), new).otherwise(F.col("tags"))).select(*keys.columns)


def zone_members(hosts: DataFrame, zones: DataFrame) -> DataFrame:
    """(zone, host_id): hosts that have a label or tag among the zone's selectors, in any case. Joined on the label, not pair by pair."""
    labels = hosts.select("host_id", F.explode(F.array_union("tags", F.map_values("labels"))).alias("_l")).select("host_id", F.lower("_l").alias("_l"))
    selectors = zones.select("zone", F.explode("selectors").alias("_l")).select("zone", F.lower("_l").alias("_l"))
    return labels.join(selectors, "_l").select("zone", "host_id").distinct()


# -- drift


def drift(old: DataFrame, new: DataFrame, keys: list[str], value: str | None = None) -> DataFrame:
    """(keys, change): added and removed keys, and changed ones where a value is compared. Both sides: one row per key."""
    a, b = old.select(*keys, *([F.col(value).alias("_old")] if value else []), F.lit(True).alias("_a")), new.select(*keys, *([F.col(value).alias("_new")] if value else []), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full_outer")
    changed = F.when(~F.col("_old").eqNullSafe(F.col("_new")), "changed") if value else F.lit(None).cast("string")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise(changed)
    return both.withColumn("change", kind).where("change IS NOT NULL").select(*keys, "change", *(["_old", "_new"] if value else [])).withColumnsRenamed({"_old": "old_value", "_new": "new_value"})


def hash_changes(old: DataFrame, new: DataFrame, packaged: DataFrame) -> DataFrame:
    """(path, severity): files whose hash differs; low where a package accounts for the new one, else high."""
    out = new.join(old.select("path", F.col("sha256").alias("_old")), "path").where(F.col("sha256") != F.col("_old"))
    out = out.join(packaged.select("path", "sha256", F.lit("low").alias("severity")).distinct(), ["path", "sha256"], "left")
    return out.select("path", F.coalesce("severity", F.lit("high")).alias("severity"))


# -- views that disagree


def hidden_processes(listing: DataFrame, *sources: tuple[str, DataFrame]) -> DataFrame:
    """(host, pid, starttime, sources): processes that some source has and the listing hasn't."""
    seen = reduce(lambda a, b: a.unionByName(b), [d.select("host", "pid", "starttime", F.lit(n).alias("source")) for n, d in sources])
    return seen.join(listing.select("host", "pid").distinct(), ["host", "pid"], "left_anti").groupBy("host", "pid", "starttime").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def confirmed(first: DataFrame, second: DataFrame) -> DataFrame:
    """What both passes found hidden, with the same start: ids may be reused in between."""
    return first.join(second.select("host", "pid", "starttime"), ["host", "pid", "starttime"], "left_semi")


def module_disagreement(listed: DataFrame, loadable: DataFrame) -> DataFrame:
    """(host, name, in_proc_modules, in_sysfs) of modules that one view lacks."""
    both = listed.select("host", "name", F.lit(True).alias("p")).join(loadable.select("host", "name", F.lit(True).alias("s")), ["host", "name"], "full_outer")
    return both.select("host", "name", F.coalesce("p", F.lit(False)).alias("in_proc_modules"), F.coalesce("s", F.lit(False)).alias("in_sysfs")).where("in_proc_modules <> in_sysfs")


def socket_owners(sockets: DataFrame, fds: DataFrame, euid: int, least_pids: int = 8, least_share: float = 0.4) -> DataFrame:
    """sockets with owning_pid and owner_unresolved; a missing owner is a finding only if the scan could see enough descriptor tables.

    fds: host, pid, inode, readable (one row per descriptor, inode null for unreadable tables).
    """
    sight = fds.groupBy("host").agg(F.count_distinct("pid").alias("pids"), (F.count_distinct(F.when(F.col("readable"), F.col("pid"))) / F.count_distinct("pid")).alias("share"))
    owner = fds.where("inode IS NOT NULL").groupBy("host", "inode").agg(F.min("pid").alias("owning_pid"))
    out = sockets.join(owner, ["host", "inode"], "left").join(sight, "host", "left")
    sure_ = F.lit(euid == 0) & (F.col("pids") >= least_pids) & (F.col("share") >= least_share)
    return out.withColumn("owner_unresolved", sure(F.col("owning_pid").isNull() & sure_)).drop("pids", "share")


def listen_ports(sockets: DataFrame, fds: DataFrame) -> DataFrame:
    """(host, pid, ports): the ports each process listens on."""
    listening = sockets.where("state = 'LISTEN'").select("host", "inode", "local_port")
    return fds.join(listening, ["host", "inode"]).groupBy("host", "pid").agg(F.array_sort(F.collect_set("local_port")).alias("ports"))


def user_names(rows: DataFrame, passwd: DataFrame) -> DataFrame:
    """username by (host, uid); of several entries the first counts."""
    first = passwd.groupBy("host", "uid").agg(F.min_by("username", "ord").alias("username"))
    return rows.join(first, ["host", "uid"], "left")


# -- integrity and indicators


def integrity_mismatches(files: DataFrame, packages: DataFrame, prefixes: list[str]) -> DataFrame:
    """Files under the prefixes whose MD5 isn't the package's."""
    expected = packages.select("path", F.col("md5").alias("expected_hash"), "package")
    out = files.where(S.starts_any(F.col("path"), prefixes)).join(expected, "path").where(F.lower("md5") != F.lower("expected_hash"))
    return out.select("path", "expected_hash", F.col("md5").alias("actual_hash"), "package")


def login_inversions(records: DataFrame, file: str = "path", order: str = "ord", time: str = "time") -> DataFrame:
    """Records whose time is before the last non-zero time above them."""
    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.nullif(F.col(time), F.lit(0)), ignorenulls=True).over(w)
    return records.withColumn("before", before).where((F.col(time) > 0) & (F.col(time) < F.col("before")))


def log_issues(files: DataFrame, records: DataFrame) -> DataFrame:
    """(path, issue): missing, truncated, zeroed, nul_hole, out_of_order. files: path, present, size, expected_size, zero_bytes, nul_run."""
    issue = F.when(~F.col("present"), "missing").when((F.col("size") > 0) & (F.col("zero_bytes") == F.col("size")), "zeroed").when(F.col("size") < F.col("expected_size"), "truncated").when(F.col("nul_run") >= 384, "nul_hole")
    own = files.withColumn("issue", issue).where("issue IS NOT NULL").select("path", "issue")
    return own.union(login_inversions(records).select("path", F.lit("out_of_order")).distinct())


def directory_anomalies(dirs: DataFrame, staging: list[str] = ("/tmp", "/var/tmp", "/dev/shm")) -> DataFrame:
    """(path, anomaly): link counts that don't fit the listed subdirectories, hidden directories in staging places. dirs: path, nlink, fs_counts."""
    parent = dirs.groupBy(F.regexp_replace("path", "/[^/]+$", "").alias("path")).agg(F.count("*").alias("listed"))
    out = dirs.join(parent, "path", "left").where("fs_counts").where(F.col("nlink") - 2 != F.coalesce("listed", F.lit(0)))
    hidden = dirs.where(S.starts_any(F.col("path"), [s + "/" for s in staging]) & F.substring_index("path", "/", -1).startswith("."))
    return out.select("path", F.lit("link_count_mismatch").alias("anomaly")).union(hidden.select("path", F.lit("dotdir_stash")))


def indicator_hits(files: DataFrame, iocs: DataFrame) -> DataFrame:
    """(path, ioc_kind, ioc_value): files whose path or hash is in the feed. iocs: kind, value."""
    candidates = files.select("path", F.explode(F.array(F.struct(F.lit("path").alias("kind"), F.col("path").alias("value")), F.struct(F.lit("hash").alias("kind"), F.lower("sha256").alias("value")))).alias("c"))
    feed = iocs.select("kind", F.when(F.col("kind") == "hash", F.lower("value")).otherwise(F.col("value")).alias("value")).distinct()
    return candidates.select("path", "c.kind", "c.value").join(feed, ["kind", "value"], "left_semi").select("path", F.col("kind").alias("ioc_kind"), F.col("value").alias("ioc_value"))


def noteworthy_files(files: DataFrame) -> DataFrame:
    """Setuid and setgid files, world-writable executables, large files under /dev. files: path, mode (long), size."""
    bit = lambda m: F.col("mode").bitwiseAND(m) != 0
    return files.where(bit(0o6000) | (bit(0o002) & bit(0o111)) | (F.col("path").startswith("/dev/") & ~F.col("path").startswith("/dev/shm/") & (F.col("size") > 4096)))
