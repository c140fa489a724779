"""Queries for file fleets and detection runs. Order lines stand in for rows of file inventories, nations for datasets, orders for what detectors find."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrier.operators import detection, files

from .registry import query

_INVENTORY = """f AS (SELECT 'h' || (l_suppkey % 10) AS machine_id, CASE l_partkey % 3 WHEN 0 THEN '/etc/p' WHEN 1 THEN '/tmp/p' ELSE '/usr/bin/p' END || l_partkey AS path,
CASE WHEN l_returnflag = 'R' AND l_quantity > 40 THEN 0 ELSE 1000 END AS euid, 'u' || (l_linenumber % 3) AS owner, l_linestatus AS grp, CAST(l_quantity AS BIGINT) % 3 AS size, l_quantity > 47 AS world, l_quantity > 44 AS grpw,
CAST(l_shipdate AS TIMESTAMP) AS mtime, {'a': l_orderkey, 'b': l_linenumber, 'c': l_extendedprice, 'd': l_shipdate} AS ord FROM lineitem),
k AS (SELECT machine_id, path, arg_max(mtime, ord) AS mtime, arg_max(owner, ord) AS owner, arg_max(grp, ord) AS grp, arg_max(size, ord) AS size, bool_or(euid = 0) AS root, bool_or(world) AS world, bool_or(grpw) AS grpw FROM f GROUP BY 1, 2)"""


def _inventory(t):
    path = F.concat(F.when(F.col("l_partkey") % 3 == 0, "/etc/p").when(F.col("l_partkey") % 3 == 1, "/tmp/p").otherwise("/usr/bin/p"), F.col("l_partkey"))
    mode = F.when(F.col("l_quantity") > 47, "0666").when(F.col("l_quantity") > 44, "0664").otherwise("0644")
    uid = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40), 0).otherwise(1000)
    return t("lineitem").select(
        F.concat(F.lit("h"), F.col("l_suppkey") % 10).alias("machine_id"), path.alias("path"), uid.alias("uid"), F.concat(F.lit("u"), F.col("l_linenumber") % 3).alias("owner"), F.col("l_linestatus").alias("group"), mode.alias("permissions"),
        (F.col("l_quantity").cast("long") % 3).alias("size"), F.col("l_shipdate").cast("timestamp").alias("mtime"), F.lit(None).cast("timestamp").alias("timestamp"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate").alias("ord"))


def _majority(c: str, said: str, most: str) -> str:
    return f"""SELECT machine_id, 'metadata' AS kind, k.path, 'METADATA ANOMALY: {said} (fleet majority: {most})' AS detail FROM k JOIN (SELECT path, {c} AS best, votes FROM (SELECT path, {c}, count(*) AS votes,
sum(count(*)) OVER (PARTITION BY path) AS hosts, row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, {c}) AS rn FROM k GROUP BY 1, 2) WHERE rn = 1 AND hosts >= 3 AND votes >= 2) b ON k.path = b.path WHERE k.path NOT LIKE '/tmp/%' AND k.{c} <> best"""


def _minority(c: str, where: str, yes: str, no: str) -> str:
    return f"""SELECT machine_id, 'access' AS kind, path, CASE WHEN {c} THEN 'FLEET OUTLIER: {yes} (minority)' ELSE 'FLEET OUTLIER: {no} (minority)' END AS detail FROM (SELECT *, count(*) OVER (PARTITION BY path) AS hosts, count(*) FILTER ({c}) OVER (PARTITION BY path) AS yes FROM k)
WHERE {where} AND hosts >= 3 AND (({c} AND yes < hosts - yes AND hosts - yes >= 2) OR (NOT {c} AND hosts - yes < yes AND yes >= 2))"""


@query(f"""WITH {_INVENTORY}, r AS (SELECT machine_id, path, epoch(mtime) AS s, count(*) OVER w AS n, row_number() OVER (PARTITION BY path ORDER BY mtime) AS rn FROM k WINDOW w AS (PARTITION BY path)), m AS (SELECT path, s AS med FROM r WHERE rn = n // 2 + 1 AND n >= 3)
SELECT machine_id, 'mtime' AS kind, path, 'MTIME ANOMALY: ' || path || ' modified ' || CAST(floor(abs(s - med) / 3600) AS BIGINT) || 'h ' || CASE WHEN s > med THEN 'NEWER' ELSE 'OLDER' END || ' than fleet baseline' AS detail FROM r JOIN m USING (path) WHERE floor(abs(s - med) / 3600) > 24
UNION ALL {_majority("owner", "owner on ' || k.path || ' is ''' || owner || '''", "''' || best || '''")}
UNION ALL {_majority("grp", "group on ' || k.path || ' is ''' || grp || '''", "''' || best || '''")}
UNION ALL {_majority("size", "size on ' || k.path || ' is ' || size || ' bytes", "' || best || ' bytes")}
UNION ALL {_minority("root", "true", "root UID access to ' || path || ' - ' || (hosts - yes) || ' of ' || hosts || ' hosts use non-root for this path", "non-root access to ' || path || ' - ' || yes || ' of ' || hosts || ' hosts use root for this path")}
UNION ALL {_minority("world", "true", "world-writable ' || path || ' - ' || (hosts - yes) || ' of ' || hosts || ' hosts are not world-writable", "non-world-writable ' || path || ' - ' || yes || ' of ' || hosts || ' hosts see world-writable mode")}
UNION ALL {_minority("grpw", "path NOT LIKE '/usr/%'", "group-writable ' || path || ' under /etc or /tmp - ' || (hosts - yes) || ' of ' || hosts || ' hosts are not group-writable", "not group-writable ' || path || ' - ' || yes || ' of ' || hosts || ' hosts see group-writable on this path")}""")
def file_fleet_details(t):
    return files.details(files.last_known(files.flagged(_inventory(t))))


@query(f"""WITH {_INVENTORY}, b AS (SELECT machine_id, path, euid, count(*) AS n FROM f GROUP BY 1, 2, 3), p AS (SELECT machine_id, path, floor(epoch(mtime) / 864000) AS day FROM k), j AS (SELECT b.*, day FROM b JOIN p USING (machine_id, path)),
c AS (SELECT path, euid, day FROM j WHERE path NOT LIKE '/tmp/%' GROUP BY 1, 2, 3 HAVING count(*) >= ceil(0.2 * (SELECT count(DISTINCT machine_id) FROM j)))
SELECT machine_id, path, euid, n FROM j WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.path = j.path AND c.euid = j.euid AND c.day = j.day)""")
def file_fleet_off_baseline(t):
    f = files.flagged(_inventory(t))
    return files.off_baseline(files.buckets(f), files.last_known(f), 0.2, 864_000).select("machine_id", "path", "euid", "n")


_RUN = """d AS (SELECT 'n' || n_nationkey AS dataset_id, CASE n_nationkey % 4 WHEN 0 THEN 'process' WHEN 1 THEN 'file' WHEN 2 THEN 'mixed' ELSE 'other' END AS kind FROM nation WHERE n_regionkey IN (1, 2)),
o AS (SELECT o_orderkey % 3 AS turn, 'n' || c_nationkey || '/c' || c_custkey AS machine_id, kind, CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.75 WHEN '3-MEDIUM' THEN 0.5 ELSE 0.25 END AS s, CAST(o_totalprice AS DOUBLE) / 500000 AS ratio, o_orderpriority AS reason
FROM orders JOIN customer ON o_custkey = c_custkey JOIN d ON dataset_id = 'n' || c_nationkey),
x AS (SELECT machine_id, 'process' AS detector, s AS score, reason FROM o WHERE turn = 0 AND kind IN ('process', 'mixed') UNION ALL SELECT machine_id, 'markov', ratio, reason FROM o WHERE turn = 1 AND kind IN ('process', 'mixed') UNION ALL SELECT machine_id, 'file', s, reason FROM o WHERE turn = 2 AND kind IN ('file', 'mixed')),
g AS (SELECT machine_id, coalesce(max(score) FILTER (detector = 'process'), 0) AS p, coalesce(max(score) FILTER (detector = 'markov'), 0) AS m, coalesce(max(score) FILTER (detector = 'file'), 0) AS f, string_agg(DISTINCT detector, ',' ORDER BY detector) AS detectors, count(DISTINCT reason) AS reasons FROM x GROUP BY 1),
h AS (SELECT *, greatest(p, 0.7 * p + 0.3 * m, f) AS score FROM g)"""


@query(f"WITH {_RUN} SELECT machine_id, round(score, 6) AS score, CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.65 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS severity, detectors, reasons FROM h")
def detection_findings(t):
    n = F.col("n_nationkey")
    kind = F.when(n % 4 == 0, "Process").when(n % 4 == 1, "file").when(n % 4 == 2, "mixed").otherwise("other")
    datasets = t("nation").select(F.concat(F.lit("n"), n).alias("dataset_id"), kind.alias("kind"), F.array(F.concat(F.lit("r"), "n_regionkey"), F.lit("all")).alias("tags"))
    customers = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("n"), "c_nationkey").alias("dataset_id"), F.concat(F.lit("c"), "c_custkey").alias("machine_id"))
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low")
    seen = t("orders").join(customers, "o_custkey").withColumns({"severity": severity, "ratio": F.col("o_totalprice").cast("double") / 500000, "turn": F.col("o_orderkey") % 3})
    chosen = detection.arms(detection.selected(datasets, tags=("r1", "r2")))
    processes, inventory = (detection.rows_of_arm(seen, chosen, arm) for arm in ("process_arm", "file_arm"))
    score, reason = detection.severity_score(F.col("severity")).alias("score"), F.col("o_orderpriority").alias("reason")
    found = processes.where("turn = 0").select("machine_id", F.lit("process").alias("detector"), score, reason)
    found = found.union(processes.where("turn = 1").select("machine_id", F.lit("markov"), "ratio", reason)).union(inventory.where("turn = 2").select("machine_id", F.lit("file"), score, reason))
    return detection.fused(found).withColumns({"score": F.round("score", 6), "detectors": F.array_join("detectors", ",")})
