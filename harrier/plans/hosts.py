"""Queries for host inspection: socket owners, names, logs, directories, indicators, reviews. Rows of the trade tables stand in for what hosts report."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrier.operators import correlate, fleet, triage

from .registry import query

_FDS = "SELECT l_suppkey AS host, l_partkey % 20 AS pid, CASE WHEN l_linenumber <= 2 THEN l_orderkey * 10 + l_linenumber END AS inode, CASE WHEN l_suppkey % 2 = 0 THEN (l_partkey % 20) % 2 = 0 ELSE (l_partkey % 20) % 3 = 0 END AS readable FROM lineitem"


def _fds(t):
    pid = F.col("l_partkey") % 20
    return t("lineitem").select(F.col("l_suppkey").alias("host"), pid.alias("pid"), F.when(F.col("l_linenumber") <= 2, F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("inode"), F.when(F.col("l_suppkey") % 2 == 0, pid % 2 == 0).otherwise(pid % 3 == 0).alias("readable"))


def _sockets(t):
    return t("lineitem").where("l_linenumber <= 3").select(F.col("l_suppkey").alias("host"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("inode"), F.when(F.col("l_returnflag") == "A", "LISTEN").otherwise("ESTABLISHED").alias("state"), (F.col("l_partkey") % 100).alias("local_port"))


@query(f"""WITH f AS ({_FDS}), s AS (SELECT l_suppkey AS host, l_orderkey * 10 + l_linenumber AS inode FROM lineitem WHERE l_linenumber <= 3),
v AS (SELECT host, count(DISTINCT pid) AS pids, count(DISTINCT CASE WHEN readable THEN pid END) / count(DISTINCT pid) AS share FROM f GROUP BY 1), o AS (SELECT host, inode, min(pid) AS owning_pid FROM f WHERE inode IS NOT NULL GROUP BY 1, 2)
SELECT s.host, s.inode, owning_pid, owning_pid IS NULL AND pids >= 8 AND share >= 0.4 AS owner_unresolved FROM s LEFT JOIN o USING (host, inode) JOIN v USING (host)""")
def socket_owners(t):
    return correlate.socket_owners(_sockets(t).select("host", "inode"), _fds(t), 0)


@query(f"""WITH f AS ({_FDS}), s AS (SELECT l_suppkey AS host, l_orderkey * 10 + l_linenumber AS inode, l_partkey % 100 AS port FROM lineitem WHERE l_linenumber <= 3 AND l_returnflag = 'A')
SELECT host, pid, array_to_string(list_sort(list(DISTINCT port)), ',') AS ports FROM f JOIN s USING (host, inode) GROUP BY 1, 2""")
def process_listen_ports(t):
    return correlate.listen_ports(_sockets(t), _fds(t)).withColumn("ports", F.array_join("ports", ","))


@query("""WITH p AS (SELECT c_custkey % 7 AS host, c_custkey % 50 AS uid, arg_min(c_name, c_custkey) AS username FROM customer GROUP BY 1, 2)
SELECT o_orderkey, username FROM orders LEFT JOIN p ON host = o_custkey % 7 AND uid = o_custkey % 60""")
def names_of_users(t):
    passwd = t("customer").select((F.col("c_custkey") % 7).alias("host"), (F.col("c_custkey") % 50).alias("uid"), F.col("c_name").alias("username"), F.col("c_custkey").alias("ord"))
    rows = t("orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("host"), (F.col("o_custkey") % 60).alias("uid"))
    return correlate.user_names(rows, passwd).select("o_orderkey", "username")


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS ord, l_suppkey AS host, l_shipdate AS k FROM lineitem), a AS (SELECT *, row_number() OVER (PARTITION BY host, k ORDER BY ord) AS a FROM r WHERE year(k) = 1995),
b AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ord) AS b FROM a WHERE a = 1) SELECT ord, host FROM b WHERE b <= 5""")
def example_rows(t):
    rows = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_suppkey").alias("host"), F.col("l_shipdate").alias("k"))
    return triage.examples(rows, rows.where(F.year("k") == 1995), ["host", "k"], "host").select("ord", "host")


@query("""SELECT r_name AS zone, c_custkey AS host_id FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
UNION SELECT r_name, c_custkey FROM customer, region WHERE r_regionkey = 1 AND c_mktsegment = 'BUILDING'""")
def zone_members(t):
    named = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    hosts = named.select(F.col("c_custkey").alias("host_id"), F.array(F.lower("c_mktsegment")).alias("tags"), F.create_map(F.lit("nation"), F.initcap("n_name")).alias("labels"))
    zones = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("zone"), "r_regionkey").agg(F.collect_set("n_name").alias("_s"))
    return correlate.zone_members(hosts, zones.select("zone", F.array_union("_s", F.when(F.col("r_regionkey") == 1, F.array(F.lit("Building"))).otherwise(F.array().cast("array<string>"))).alias("selectors")))


@query("""WITH e AS (SELECT event_id, user_id, event_type, event_id % 3 AS uid, CASE WHEN event_id % 10 = 0 THEN '/tmp/x' ELSE '/usr/bin/x' END AS path FROM events)
SELECT a.user_id AS machine_id, a.event_type AS name, coalesce(b.event_type, '[unknown:' || (a.event_id - 1) || ']') AS parent_name, a.uid, a.path, false AS is_high_entropy, a.path = '/tmp/x' AS is_suspicious_path, count(*) AS n
FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.event_id = a.event_id - 1 GROUP BY ALL""")
def process_profiles(t):
    event = F.col("event_id")
    rows = t("events").select(F.col("user_id").alias("machine_id"), event.alias("pid"), (event - 1).alias("ppid"), F.col("event_type").alias("name"), (event % 3).alias("uid"), F.when(event % 10 == 0, "/tmp/x").otherwise("/usr/bin/x").alias("path"), F.lit("aa").alias("args"), event.alias("ord"))
    return fleet.process_profile(rows)


@query("""WITH f AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_custkey % 9 = 0 THEN 'zeroed' WHEN o_orderkey % 5 = 0 THEN 'truncated' WHEN o_custkey % 7 = 0 THEN 'nul_hole' END AS issue FROM orders),
r AS (SELECT l_orderkey AS path, epoch(l_shipdate) < lag(epoch(l_shipdate)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS late FROM lineitem)
SELECT path, issue FROM f WHERE issue IS NOT NULL UNION ALL SELECT DISTINCT path, 'out_of_order' FROM r WHERE late""")
def log_integrity(t):
    key, size = F.col("o_orderkey"), F.col("o_custkey") + 100
    files = t("orders").select(key.alias("path"), (key % 11 != 0).alias("present"), size.alias("size"), F.when(key % 5 == 0, size + 1).otherwise(size).alias("expected_size"), F.when(F.col("o_custkey") % 9 == 0, size).otherwise(1).alias("zero_bytes"), F.when(F.col("o_custkey") % 7 == 0, 384).otherwise(383).alias("nul_run"))
    records = t("lineitem").select(F.col("l_orderkey").alias("path"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("ord"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("time"))
    return correlate.log_issues(files, records)


@query("""WITH p AS (SELECT p_partkey % 10 AS k, count(*) AS n FROM part GROUP BY 1) SELECT '/srv/a' || k AS path, 'link_count_mismatch' AS anomaly FROM p WHERE k % 2 = 1
UNION ALL SELECT '/srv/a' || (p_partkey % 10) || '/d' || p_partkey, 'link_count_mismatch' FROM part WHERE p_size = 50 UNION ALL SELECT '/dev/shm/.h' || p_partkey, 'dotdir_stash' FROM part WHERE p_size = 7""")
def hidden_directories(t):
    part, key = t("part"), F.col("p_partkey")
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    above = part.groupBy((key % 10).alias("k")).agg(F.count("*").alias("n")).select(text("/srv/a", F.col("k")).alias("path"), (F.col("n") + 2 + F.col("k") % 2).alias("nlink"), F.lit(True).alias("fs_counts"))
    below = part.select(text("/srv/a", key % 10, "/d", key).alias("path"), F.when(F.col("p_size") == 50, 3).otherwise(2).cast("long").alias("nlink"), F.lit(True).alias("fs_counts"))
    stash = part.where("p_size = 7").select(text("/dev/shm/.h", key).alias("path"), F.lit(9).cast("long").alias("nlink"), F.lit(False).alias("fs_counts"))
    return correlate.directory_anomalies(above.union(below).union(stash))


@query("""SELECT p_name AS path, 'path' AS ioc_kind, p_name AS ioc_value FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size > 45)
UNION ALL SELECT p_name, 'hash', sha256(CAST(p_partkey AS VARCHAR)) FROM part WHERE p_partkey % 17 = 0""")
def indicators_of_compromise(t):
    part, sha = t("part"), F.sha2(F.col("p_partkey").cast("string"), 256)
    feed = part.where("p_size > 45").select(F.lit("path").alias("kind"), F.col("p_name").alias("value")).union(part.where("p_partkey % 17 = 0").select(F.lit("hash"), F.upper(sha)))
    return correlate.indicator_hits(part.select(F.col("p_name").alias("path"), sha.alias("sha256")), feed)


@query("""WITH f AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '/dev/x' WHEN 1 THEN '/dev/shm/x' ELSE '/usr/x' END AS path, p_partkey * 37 % 4096 AS mode, p_size * 200 AS size FROM part)
SELECT p_partkey FROM f WHERE mode & 3072 <> 0 OR (mode & 2 <> 0 AND mode & 73 <> 0) OR (path = '/dev/x' AND size > 4096)""")
def files_worth_a_look(t):
    key = F.col("p_partkey")
    path = F.when(key % 5 == 0, "/dev/x").when(key % 5 == 1, "/dev/shm/x").otherwise("/usr/x")
    return correlate.noteworthy_files(t("part").select(key, path.alias("path"), (key * 37 % 4096).alias("mode"), (F.col("p_size") * 200).alias("size"))).select("p_partkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN array_to_string(list_sort(list_distinct(list_filter([c_mktsegment, 'a', 'b'], lambda x: x <> 'BUILDING'))), ',') ELSE c_mktsegment || ',a' END AS tags FROM customer""")
def tags_edited(t):
    keys = t("customer").select("c_custkey", F.array("c_mktsegment", F.lit("a")).alias("tags"))
    out = correlate.edit_tags(keys, keys.where("c_custkey % 3 = 0"), "c_custkey", add=["b", "a"], remove=["BUILDING"])
    return out.withColumn("tags", F.array_join("tags", ","))


@query("""WITH a AS (SELECT o_orderkey AS id, o_custkey % 20 AS host_id, o_orderpriority AS detector, CASE WHEN o_orderkey % 40 = 0 THEN 'X' ELSE o_orderstatus END AS verdict, CASE WHEN o_orderkey % 40 = 0 THEN TIMESTAMP '2024-02-01' ELSE o_orderdate END AS seen FROM orders)
SELECT id, verdict, strftime(max(seen) OVER (PARTITION BY host_id, detector), '%Y-%m-%d') AS reviewed FROM a""")
def reviews_stamped(t):
    rows = t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("host_id"), F.col("o_orderpriority").alias("detector"), F.lit("g").alias("grp"), F.col("o_orderstatus").alias("verdict"), F.col("o_orderdate").cast("timestamp").alias("reviewed_at"))
    after = rows.withColumn("verdict", F.when(F.col("id") % 40 == 0, "X").otherwise(F.col("verdict")))
    out = triage.stamp_reviews(rows, after, F.lit("2024-02-01").cast("timestamp"))
    return out.select("id", "verdict", F.date_format("reviewed_at", "yyyy-MM-dd").alias("reviewed"))


@query("""WITH e AS (SELECT *, 'h' || user_id AS h FROM events)
SELECT event_id, 'sysmon' AS vendor, h AS machine_id, event_id AS pid, 'x' AS name, '/bin/' || event_type || '.exe' AS path, '--id ' || event_id AS args FROM e WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'osquery', h, 0, event_type, '/opt/' || event_type, 'a b' FROM e WHERE event_id % 3 = 1 UNION ALL SELECT event_id, 'command', 'none', event_id, event_type, '/usr/' || event_type, 'x y ' || event_id FROM e WHERE event_id % 3 = 2""")
def vendor_rows(t):
    from harrier.sources import vendors

    kind, event = F.col("event_type"), F.col("event_id")
    host = F.concat(F.lit("h"), "user_id")
    sysmon = F.struct(host.alias("hostname"), event.alias("ProcessId"), F.lit("").alias("ProcessName"), F.concat(F.lit("/bin/"), kind, F.lit(".exe")).alias("ImagePath"), F.concat(F.lit('"C /x" --id '), event).alias("CommandLine"))
    osquery = F.struct(host.alias("host"), F.lit("x").alias("pid"), F.concat(F.lit("/opt/"), kind, F.lit(" a b")).alias("cmdline"))
    plain = F.struct(event.cast("string").alias("process_id"), F.concat(F.lit("/usr/"), kind, F.lit(' "x y" '), event).alias("cmd"))
    out = []
    for k, (name, body) in enumerate((("sysmon", sysmon), ("osquery", osquery), ("command", plain))):
        lines = t("events").where(event % 3 == k).select("event_id", F.to_json(body).alias("line"))
        rows = vendors.process_rows(lines.select("line", "event_id"), name, "none", keep=("event_id",))
        out.append(rows.select("event_id", F.lit(name).alias("vendor"), "machine_id", "pid", "name", "path", "args"))
    return out[0].union(out[1]).union(out[2])


@query("""WITH s AS (SELECT o_custkey AS host_id, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING' AND o_orderdate BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1995-06-30') SELECT host_id, o_orderkey FROM s WHERE k = 1""")
def newest_scans_of_labelled_hosts(t):
    from harrier.operators import hunt

    scans = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    scans = scans.select(F.col("o_custkey").alias("host_id"), "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("finished_at"), F.array("o_orderstatus", F.lit("all")).alias("tags"), F.create_map(F.lit("segment"), "c_mktsegment").alias("labels"))
    return hunt.newest_labelled(scans, ["F", "all"], labels={"segment": "BUILDING"}, first="1993-01-01", last="1995-06-30", tie="o_orderkey").select("host_id", "o_orderkey")


@query("""WITH b AS (SELECT l_partkey % 50 AS f, l_suppkey AS h, l_returnflag AS u, CASE WHEN l_linestatus = 'O' THEN 'authorized' ELSE 'host' END AS r, l_shipdate AS d, l_orderkey * 10 + l_linenumber AS path FROM lineitem)
SELECT f, h, u, r, strftime(d, '%Y-%m-%d') AS day, path FROM b QUALIFY row_number() OVER (PARTITION BY f, h, u, r ORDER BY d DESC, path) = 1""")
def placements_merged(t):
    from harrier.sources import sinks

    rows = t("lineitem").select((F.col("l_partkey") % 50).cast("string").alias("fingerprint"), F.col("l_suppkey").alias("host_id"), F.col("l_returnflag").alias("username"), F.when(F.col("l_linestatus") == "O", "").otherwise("host").alias("role"), F.col("l_shipdate").alias("seen_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("path"))
    out = sinks.merged_placements(rows.where("path % 2 = 0"), rows.where("path % 2 = 1"))
    return out.select(F.col("fingerprint").cast("long").alias("f"), F.col("host_id").alias("h"), F.col("username").alias("u"), F.col("role").alias("r"), F.date_format("seen_at", "yyyy-MM-dd").alias("day"), "path")


@query("""WITH d AS (SELECT o_orderpriority AS detector, o_custkey % 40 AS reason, CASE o_orderstatus WHEN 'F' THEN 'malicious' WHEN 'O' THEN 'unset' ELSE 'benign' END AS verdict, o_orderdate AS at_, o_orderkey FROM orders),
n AS (SELECT * FROM d WHERE verdict <> 'unset' AND detector <> '5-LOW' QUALIFY row_number() OVER (PARTITION BY detector, reason ORDER BY at_ DESC, o_orderkey, verdict) = 1)
SELECT detector, reason, verdict, true AS fresh FROM n UNION ALL SELECT p, r, 'old', false FROM (SELECT DISTINCT o_orderpriority AS p FROM orders), range(45) AS g(r) WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.detector = p AND n.reason = r)""")
def precedents_merged(t):
    from harrier.sources import sinks

    orders = t("orders")
    verdict = F.when(F.col("o_orderstatus") == "F", "malicious").when(F.col("o_orderstatus") == "O", "unset").otherwise("benign")
    detector = F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    decisions = orders.select(detector.alias("detector"), (F.col("o_custkey") % 40).alias("reason"), verdict.alias("verdict"), F.col("o_orderdate").cast("timestamp").alias("reviewed_at"), F.col("o_orderkey").alias("machine_id"))
    known = orders.select(F.col("o_orderpriority").alias("detector")).distinct().withColumn("reason", F.explode(F.sequence(F.lit(0), F.lit(44)).cast("array<bigint>")))
    nothing = F.lit(None)
    known = known.select("detector", "reason", F.lit("old").alias("verdict"), nothing.cast("timestamp").alias("reviewed_at"), nothing.cast("long").alias("machine_id"), nothing.cast("timestamp").alias("updated_at"))
    out = sinks.merged_precedents(known, decisions, F.lit("2024-01-01").cast("timestamp"))
    return out.select("detector", "reason", "verdict", F.col("updated_at").isNotNull().alias("fresh"))


@query("""WITH f AS (SELECT o_orderkey AS id, o_orderpriority AS detector, o_custkey % 30 AS p, CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'P' THEN 'benign' ELSE 'unset' END AS verdict FROM orders)
SELECT id, CASE WHEN coalesce(verdict, 'unset') <> 'unset' OR (detector = '2-HIGH' AND p = 3) THEN verdict WHEN p < 20 THEN 'exact' ELSE verdict END AS verdict FROM f""")
def precedents_applied(t):
    """Reasons name a process; precedents of a process hold for all reasons that name it."""
    reason = lambda p, v: F.concat(F.lit("RISK DETECTED: name=p"), p, F.lit(" path=/x/"), v)
    p = F.col("o_custkey") % 30
    verdict = F.when(F.col("o_orderstatus") == "P", "benign").when(F.col("o_orderstatus") == "F", "unset")
    found = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("detector"), reason(p, F.col("o_custkey") % 4).alias("reason"), verdict.alias("verdict"))
    known = t("orders").where(p < 20).select(F.col("o_orderpriority").alias("detector"), reason(p, F.lit(1)).alias("reason"), F.lit("exact").alias("verdict")).distinct()
    ignored = found.where((F.col("detector") == "2-HIGH") & F.col("reason").startswith("RISK DETECTED: name=p3 ")).select("detector", "reason")
    return triage.apply_precedents(found, known, ignored).select("id", "verdict")
