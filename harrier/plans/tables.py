"""Queries over what the library writes and reads back: indexed tables, tables merged on read, scan files."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrier.operators import sketches
from harrier.sources import envelopes, procfs
from harrier.sources.token_index import TokenIndex
from harrier.sources.versioned import VersionedTable
from harrier.storage import Scratch, make_folder

from .registry import query


def _indexed(rows, column: str, parts: int = 16) -> TokenIndex:
    """An index over the rows, written as ``parts`` files by ranges of the id; half of the files come after the first indexing.

    Which rows come late is told by the id's hash: ranges are drawn anew by each job, so their numbers don't part rows.
    """
    spark, key = rows.sparkSession, rows.columns[0]
    root = Scratch(spark, "indexed").root
    index = TokenIndex(spark, f"{root}/table", column, f"{root}/index", buckets=8)
    for late in (0, 1):
        rows.where(F.pmod(F.xxhash64(key), F.lit(2)) == late).repartitionByRange(parts // 2, key).write.mode("append").parquet(f"{root}/table")
        index.refresh()
    return index


_TOKENS = "regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+')"


@query(f"SELECT doc_id FROM documents WHERE list_has_all({_TOKENS.format('text')}, ['license', 'under'])")
def token_index_of_documents(t):
    return _indexed(t("documents").select("doc_id", "text"), "text").search("LICENSE under").select("doc_id")


@query(f"SELECT page_id, url FROM pages WHERE list_has_all({_TOKENS.format('html')}, ['der', 'und', 'net'])")
def token_index_of_pages(t):
    return _indexed(t("pages").select("page_id", "url", "html"), "html").search("NET: der und").select("page_id", "url")


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, make_date(year(o_orderdate), 1, 1) AS year"


@query(f"""WITH o AS ({_ORDERS} FROM orders), s AS (SELECT *, CASE WHEN o_orderkey % 13 = 0 THEN 'again' WHEN o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0 THEN 'changed' ELSE o_orderstatus END AS status,
 o_orderkey % 13 <> 0 AND o_orderkey % 11 = 0 AS gone FROM o)
SELECT o_orderkey, o_custkey, status, year(year) AS year FROM s WHERE NOT gone AND year(year) >= 1994""")
def table_merged_on_read(t):
    """Orders, then changes, deletes and late old versions, a compaction, more changes, and years dropped."""
    rows = t("orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.trunc("o_orderdate", "year").alias("year"), F.lit(1).cast("long").alias("version"))
    table = VersionedTable(rows.sparkSession, Scratch(rows.sparkSession, "versioned").root, "o_orderkey long, o_custkey long, status string, version long, year date", ["o_orderkey"], "version", day="year", buckets=2)
    every = lambda n: F.col("o_orderkey") % n == 0
    at = lambda df, v: df.withColumn("version", F.lit(v).cast("long"))
    table.upsert(rows)
    table.upsert(at(rows.where(every(7) & ~every(5)), 3).withColumn("status", F.lit("changed")))
    table.upsert(at(rows.where(every(35)), 0).withColumn("status", F.lit("too old")))
    table.delete(at(rows.where(every(11)), 4).drop("status", "o_custkey"))
    table.compact()
    table.upsert(at(rows.where(every(13)), 5).withColumn("status", F.lit("again")))
    table.retain("1994-01-01")
    return table.read().select("o_orderkey", "o_custkey", "status", F.year("year").cast("long").alias("year"))


@query("""SELECT user_id AS scan, count(*) + 2 AS told, count(*) FILTER (event_id % 50 <> 49) AS observations, count(*) FILTER (event_id % 50 = 49) AS errors, 'complete' AS outcome,
count(*) FILTER (event_id % 50 <> 49 AND event_type = 'click') AS clicks, sum(event_id) FILTER (event_id % 50 <> 49) AS pids FROM events GROUP BY 1""")
def scan_files(t):
    """A compressed file of envelopes for each user, with lines that are too long, read back by the bounded reader.

    Lines that are too long are made where they are written, so they pass no shuffle and no sort. The number
    of partitions is given: by what is shuffled, few would do, but each file takes its time.
    """
    events = t("events")
    root = make_folder(events.sparkSession, Scratch(events.sparkSession, "scans").root)
    seen = F.to_json(F.struct(F.lit("obs").alias("kind"), F.col("event_type").alias("c"), F.lit(0).alias("n"), F.struct(F.lit("process").alias("t"), F.col("event_id").alias("pid"), F.col("event_type").alias("comm")).alias("d")))
    lines = events.select("user_id", F.lit(1).alias("place"), F.when(~F.coalesce(F.col("event_id") % 50 == 49, F.lit(False)), seen).alias("line"))
    first = events.select("user_id", F.lit(0).alias("place"), F.lit('{"kind": "hello", "schema": 1, "arch": "x86_64"}').alias("line")).distinct()
    last = events.groupBy("user_id").agg(F.lit(2).alias("place"), F.concat(F.lit('{"kind": "summary", "outcome": "complete", "observation_count": '), F.count("*") + 2, F.lit("}")).alias("line"))
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = lines.unionByName(first).unionByName(last).repartition(parts, "user_id").sortWithinPartitions("user_id", "place")
    written = whole.select("user_id", F.coalesce("line", F.repeat(F.lit("x"), 300_000)).alias("line"))
    written.write.partitionBy("user_id").text(f"{root}/scans", compression="gzip")
    found = envelopes.read_envelopes(events.sparkSession, f"{root}/scans", envelopes.Limits(bytes=1 << 40))
    user = F.regexp_extract("file", r"user_id=(\d+)", 1).cast("long").alias("scan")
    observed = envelopes.observation_lines(found).groupBy(user).agg(F.count_if(F.col("collector") == "click").alias("clicks"), F.sum(F.get_json_object("line", "$.pid").cast("long")).alias("pids"))
    return envelopes.scans(found).select(user, "told", "observations", "errors", "outcome").join(observed, "scan")


# -- the kernel's tables, as lines made from events

_B = "CAST((event_id * {} + {}) % 256 AS BIGINT)"
_HEX = "lpad(upper(hex({})), 2, '0')"


@query(f"""WITH b AS (SELECT event_id, user_id, {", ".join(f"{_B.format(m, a)} AS b{k}" for k, (m, a) in enumerate(((7, 1), (11, 2), (13, 3), (1, 4))))} FROM events)
SELECT event_id, CAST(event_id + 5 AS VARCHAR) AS inode, CASE event_id % 2 WHEN 0 THEN 'ipv4' ELSE 'ipv6' END AS family, CASE event_id % 12 WHEN 1 THEN 'ESTABLISHED' WHEN 10 THEN 'LISTEN' WHEN 11 THEN 'CLOSING' WHEN 7 THEN 'CLOSE' WHEN 3 THEN 'SYN_RECV' ELSE 'other' END AS state,
CASE event_id % 4 WHEN 1 THEN '::ffff:' || concat_ws('.', b0, b1, b2, b3) WHEN 3 THEN concat_ws(':', 'fe80:0:0:0', '0', '1', printf('%x', b0 * 256 + b1), printf('%x', b2 * 256 + b3)) ELSE concat_ws('.', b0, b1, b2, b3) END AS local_ip,
event_id % 65536 AS local_port, CASE event_id % 2 WHEN 0 THEN '0.0.0.0' ELSE '::' END AS remote_ip, 443 AS remote_port, user_id AS uid FROM b""")
def proc_net_sockets(t):
    b = [F.lpad(F.hex((F.col("event_id") * m + a) % 256), 2, "0") for m, a in ((7, 1), (11, 2), (13, 3), (1, 4))]
    word = F.concat(*b[::-1])  # least byte first
    wide = F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("0000000000000000FFFF0000"), word)).otherwise(F.concat(F.lit("000080FE"), F.lit("00000000"), F.lit("01000000"), word))
    state = F.lpad(F.hex(F.col("event_id") % 12), 2, "0")
    line = lambda local, remote: F.concat(F.lit("   0: "), local, F.lit(":"), F.lpad(F.hex(F.col("event_id") % 65536), 4, "0"), F.lit(f" {remote}:01BB "), state, F.lit(" 00000000:00000000 00:00000000 00000000  "), F.col("user_id"), F.lit("        0 "), F.col("event_id") + 5, F.lit(" 1 0000000000000000 100 0 0 10 0"))
    narrow, events = F.col("event_id") % 2 == 0, t("events").select("event_id", "user_id")
    four = events.where(narrow).select("event_id", line(word, "00000000").alias("line"))
    six = events.where(~narrow).select("event_id", line(wide, "0" * 32).alias("line"))
    head = events.limit(1).select("event_id", F.lit("  sl  local_address rem_address   st tx_queue rx_queue tr tm->when retrnsmt   uid  timeout inode").alias("line"))
    found = procfs.net_sockets(four.union(head), "tcp", "ipv4", "event_id").union(procfs.net_sockets(six.union(head), "tcp", "ipv6", "event_id"))
    told = F.when(F.col("state").isin("ESTABLISHED", "LISTEN", "CLOSING", "CLOSE", "SYN_RECV"), F.col("state")).otherwise("other")
    return found.withColumn("state", told).drop("protocol").withColumns({c: F.col(c).cast("long") for c in ("local_port", "remote_port")})


@query("""WITH m AS (SELECT user_id AS pid, event_id, CASE event_id % 3 WHEN 0 THEN 'rwxp' WHEN 1 THEN 'r-xp' ELSE 'rw-p' END AS perms, event_id % 5 AS k, event_id % 10 = 9 AS wide FROM events),
s AS (SELECT *, lag(wide) OVER (PARTITION BY pid ORDER BY event_id) AND lag(event_id) OVER (PARTITION BY pid ORDER BY event_id) = event_id - 1 AS meets FROM m)
SELECT pid, count(*) FILTER (perms = 'rwxp') AS rwx_maps, count(*) FILTER (perms IN ('rwxp', 'r-xp') AND k IN (0, 1, 2)) AS unbacked_exec, count(*) FILTER (meets) AS n_overlapping FROM s GROUP BY 1""")
def proc_memory_maps(t):
    """Ranges of 4 KB, some reaching into the next event's."""
    at = lambda c: F.lower(F.hex(c))
    base, event = F.lit(0x7F0000000000), F.col("event_id")
    perms = F.element_at(F.array(*map(F.lit, ("rwxp", "r-xp", "rw-p"))), (event % 3 + 1).cast("int"))
    path = F.element_at(F.array(*map(F.lit, ("", "[anon:x]", "/lib/a.so (deleted)", "/lib/b c.so", "[heap]"))), (event % 5 + 1).cast("int"))
    size = F.when(event % 10 == 9, 4097).otherwise(4096)
    line = F.concat(at(base + event * 4096), F.lit("-"), at(base + event * 4096 + size), F.lit(" "), perms, F.lit(" 00000000 08:01 77      "), path)
    maps = procfs.memory_maps(t("events").select(F.col("user_id").alias("pid"), line.alias("line")), "pid")
    seen = procfs.overlapping(maps, "pid").groupBy("pid").agg(F.count_if("overlaps").alias("n_overlapping"))
    return procfs.map_flags(maps, "pid").join(seen, "pid")


# -- sketches


@query("""WITH e AS (SELECT * FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'), m AS (SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, count(DISTINCT user_id) AS users FROM e GROUP BY 1)
SELECT event_type, n, ids, users, true AS ids_within, true AS users_within, true AS median_within FROM m""")
def sketches_over_days(t):
    """Estimates from a table of daily sketches, held against exact counts over the same days: 5 % for distinct counts, 5 % of the rank for medians."""
    events = t("events")
    scratch = Scratch(events.sparkSession, "sketches")
    days = scratch.save(sketches.daily(events, "ts", ("event_type",), ("event_id", "user_id"), ("value",)))
    told = sketches.over(days, ("event_type",), "2024-01-05", "2024-01-20")
    inside = events.where(F.to_date("ts").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date")))
    exact = inside.groupBy("event_type").agg(F.count_distinct("event_id").alias("ids"), F.count_distinct("user_id").alias("users"))
    below = inside.join(told.select("event_type", "median_value"), "event_type").groupBy("event_type").agg(F.avg((F.col("value") < F.col("median_value")).cast("int")).alias("low"), F.avg((F.col("value") <= F.col("median_value")).cast("int")).alias("high"))
    off = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.05 * F.col(b) + 1
    joined = told.join(exact, "event_type").join(below, "event_type")
    return joined.select("event_type", "n", "ids", "users", off("distinct_event_id", "ids").alias("ids_within"), off("distinct_user_id", "users").alias("users_within"), ((F.col("low") <= 0.55) & (F.col("high") >= 0.45)).alias("median_within"))
