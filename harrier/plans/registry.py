"""Queries over the driver's tables, each beside the SQL that gives the same rows.

The tables stand in for telemetry: users are hosts, event types kinds, parts
paths or keys, suppliers machines, documents and conversations command lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.functions import predicates as P
from harrier.functions import scalars as S
from harrier.operators import correlate, fleet, hunt, markov, triage
from harrier.storage import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


EVENT_FIELDS = hunt.FieldCatalog({"event_id": "event_id", "timestamp": "ts", "kind": "event_type", "host_id": "user_id", "value": "value"}, "props")

# -- search expressions


@query("SELECT event_id, event_type, value FROM events WHERE event_type <> '' AND value > 100")
def flt_presence_and_compare(t):
    return t("events").where(P.present(F.col("event_type")) & P.compare(F.col("value"), ">", "100")).select("event_id", "event_type", "value")


@query("SELECT event_type, count(*) AS stat FROM events WHERE event_type <> '' AND value > 20 GROUP BY 1 ORDER BY stat DESC, 1 LIMIT 10")
def flagship_stats_by_kind(t):
    df = t("events").where(P.present(F.col("event_type")) & P.compare(F.col("value"), ">", 20))
    return hunt.stats(df, by=("event_type",)).orderBy(F.col("stat").desc(), "event_type").limit(10)


@query("SELECT event_id FROM events WHERE event_type = 'click'")
def flt_eq(t):
    return t("events").where(P.equals(F.col("event_type"), "click")).select("event_id")


@query("SELECT event_id FROM events WHERE event_type <> 'click'")
def flt_ne(t):
    return t("events").where(P.differs(F.col("event_type"), "click")).select("event_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e_'")
def flt_glob(t):
    return t("part").where(P.glob(F.col("p_name"), "*a*e?")).select("p_partkey", "p_name")


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'error') AND event_type NOT IN ('click')")
def flt_in(t):
    return t("events").where(P.one_of(F.col("event_type"), "view", "error") & ~P.one_of(F.col("event_type"), "click")).select("event_id")


@query("SELECT event_id FROM events WHERE (event_type = 'click' OR event_type = 'view') AND NOT (value < 50)")
def flt_boolean_mix(t):
    e = F.col("event_type")
    return t("events").where((P.equals(e, "click") | P.equals(e, "view")) & ~P.compare(F.col("value"), "<", 50)).select("event_id")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50")
def flt_json_field(t):
    k = EVENT_FIELDS.resolve("k")
    return t("events").where(P.compare(k, ">=", 50)).select("event_id", k.alias("k"))


@query("SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'license') AND list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'under')")
def flt_token_search(t):
    return t("documents").where(P.has_tokens(F.col("text"), "LICENSE under")).select("doc_id")


@query("SELECT page_id, url FROM pages WHERE url LIKE '%.org/en/%'")
def flt_bare_wildcard(t):
    return t("pages").where(P.glob(F.col("url"), "*.org/en/*")).select("page_id", "url")


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey = n_regionkey")
def flt_field_to_field(t):
    df = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return df.where(P.same_fields(F.col("c_nationkey"), F.col("n_regionkey"))).select("c_custkey")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-07 12:00:00'")
def flt_time_bounds(t):
    ts = F.col("ts").cast("timestamp")
    return t("events").where(P.in_range(ts, F.to_timestamp(F.lit("2024-01-05")), F.to_timestamp(F.lit("2024-01-07 12:00:00")))).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 36 HOURS AND ts <= TIMESTAMP '2024-01-20'")
def flt_last_span(t):
    return t("events").where(P.last(F.col("ts"), "36h", F.lit("2024-01-20").cast("timestamp_ntz"))).select("event_id")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS stat FROM events GROUP BY 1 HAVING count(*) > 1000")
def where_after_stats(t):
    return hunt.stats(t("events"), by=("event_type",)).where("stat > 1000")


# -- aggregates


@query("SELECT count(*) AS stat FROM events")
def stats_count_all(t):
    return hunt.stats(t("events"))


@query("SELECT event_type, count(DISTINCT user_id) AS stat FROM events GROUP BY 1")
def stats_dc_exact(t):
    return hunt.stats(t("events"), "dc", "user_id", ("event_type",))


@query()
def stats_dc_approximate(t):
    return hunt.stats(t("events"), "approx_dc", "user_id", ("event_type",))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY 1")
def stats_values(t):
    return hunt.stats(t("events"), "values", "event_type", ("user_id",)).select("user_id", F.array_join("stat", ",").alias("kinds"))


@query("SELECT l_orderkey, array_to_string(list_sort(list(l_linenumber)), ',') AS numbers FROM lineitem GROUP BY 1")
def stats_list(t):
    return hunt.stats(t("lineitem"), "list", "l_linenumber", ("l_orderkey",)).select("l_orderkey", F.array_join(F.col("stat").cast("array<string>"), ",").alias("numbers"))


def _stat(fn: str):
    sql = f"SELECT event_type, round({fn}(value), 6) AS stat FROM events GROUP BY 1"

    def f(t):
        return hunt.stats(t("events"), fn, "value", ("event_type",)).withColumn("stat", F.round("stat", 6))

    f.__name__ = f"stats_{fn}"
    query(sql)(f)


for _fn in ("sum", "avg", "min", "max", "stddev", "median"):
    _stat(_fn)


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 25")
def head_latest(t):
    return hunt.head(t("events"), 25, "ts", "event_id").select("event_id", "ts", "event_type")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def sort_desc_head(t):
    return hunt.head(t("orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey"), 40, None).select("o_orderkey", "o_totalprice")


@query("SELECT event_type FROM events ORDER BY ts DESC, event_id LIMIT 7")
def fields_deferred(t):
    return hunt.head(t("events"), 7, "ts", "event_id").select("event_type")


@query("SELECT event_type AS kind, event_id, ts, user_id, value, props FROM events")
def rename_field(t):
    return hunt.rename(t("events"), "event_type", "kind")


@query("SELECT event_id, CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS level FROM events")
def eval_if(t):
    return hunt.evaluate(t("events"), "level", "if(value > 100, 'high', 'low')").select("event_id", "level")


@query(r"SELECT page_id, regexp_extract(url, '://([^/]+)/', 1) AS site FROM pages")
def rex_extract(t):
    return hunt.rex(t("pages"), "site", "://([^/]+)/", "url").select("page_id", "site")


@query("SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) r FROM events) WHERE r = 1")
def dedup_latest(t):
    return hunt.dedup(t("events"), "user_id", tie=("event_id",)).select("event_id", "user_id", "ts")


@query("SELECT o.o_orderkey, o.o_custkey FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_quantity > 45")
def join_inner_multiplicity(t):
    right = t("lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return hunt.join_left_columns(t("orders").select("o_orderkey", "o_custkey"), right, "o_orderkey")


@query("SELECT c.c_custkey, c.c_name FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000")
def join_left(t):
    right = t("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return hunt.join_left_columns(t("customer").select("c_custkey", "c_name"), right, "c_custkey", "left")


@query("SELECT s_suppkey, s_name, coalesce(n_name, 'unknown') AS n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def lookup_dimension(t):
    return hunt.lookup(t("supplier"), t("nation"), "s_nationkey", "n_nationkey", {"n_name": "unknown"}).select("s_suppkey", "s_name", "n_name")


_TOP = "SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2"


@query(f"SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS bucket, CASE WHEN event_type IN ({_TOP}) THEN event_type ELSE 'Other' END AS series, count(*) AS stat FROM events GROUP BY 1, 2")
def timechart_top_other(t):
    return hunt.timechart(t("events"), "1d", by="event_type", limit=2)


@query(f"SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS bucket, event_type AS series, count(*) AS stat FROM events WHERE event_type IN ({_TOP}) GROUP BY 1, 2")
def timechart_without_other(t):
    return hunt.timechart(t("events"), "6h", by="event_type", limit=2, other=False)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS bucket, 'all' AS series, round(avg(value), 6) AS stat FROM events GROUP BY 1")
def timechart_average(t):
    return hunt.timechart(t("events"), "1d", "avg", "value").withColumn("stat", F.round("stat", 6))


@query("SELECT time_bucket(INTERVAL 90 MINUTES, ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS n FROM events GROUP BY 1")
def histogram_90_minutes(t):
    return hunt.histogram(t("events"), 90)


# -- fleet

_COUNTS = "SELECT source, lang AS sig, count(*) AS n FROM documents GROUP BY 1, 2"


def _user_counts(t):
    return t("events").groupBy("user_id", F.concat_ws(":", "event_type", F.floor(F.col("value") / 20)).alias("sig")).agg(F.count("*").alias("n"))


_USER_COUNTS = "SELECT user_id, event_type || ':' || CAST(floor(value / 20) AS BIGINT) AS sig, count(*) AS n FROM events GROUP BY 1, 2"


@query(f"WITH c AS ({_USER_COUNTS}) SELECT sig, count(DISTINCT user_id) AS df FROM c GROUP BY 1")
def document_frequency(t):
    return fleet.document_frequency(_user_counts(t), "user_id", "sig")


_TFIDF = f"""WITH c AS ({_USER_COUNTS}), d AS (SELECT sig, count(*) AS df FROM c GROUP BY 1), h AS (SELECT count(DISTINCT user_id) AS hosts FROM c),
x AS (SELECT user_id, c.sig, n / sum(n) OVER (PARTITION BY user_id) * (ln(hosts / df) + 1) AS w FROM c JOIN d USING (sig), h)"""


@query(_TFIDF + " SELECT user_id, sig, round(w / sqrt(sum(w * w) OVER (PARTITION BY user_id)), 9) AS w FROM x")
def tf_idf(t):
    return fleet.tf_idf(_user_counts(t), "user_id", "sig").withColumn("w", F.round("w", 9))


@query(_TFIDF.replace("WITH c", "WITH RECURSIVE c", 1) + """, v AS (SELECT user_id, sig, w / sqrt(sum(w * w) OVER (PARTITION BY user_id)) AS w FROM x), q AS (SELECT user_id, sum(w * w) AS q FROM v GROUP BY 1),
p AS (SELECT a.user_id AS a, b.user_id AS b, sum(a.w * b.w) AS dot FROM v a JOIN v b ON a.sig = b.sig AND a.user_id <> b.user_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN q qa ON qa.user_id = a JOIN q qb ON qb.user_id = b WHERE qa.q + qb.q - 2 * dot <= 0.36 + 1e-12), k AS (SELECT DISTINCT a AS h FROM e),
reach AS (SELECT h AS x, h AS y FROM k UNION SELECT x, b FROM reach JOIN e ON y = a), l AS (SELECT x, min(y) AS cluster FROM reach GROUP BY 1)
SELECT user_id, cluster FROM q LEFT JOIN l ON user_id = x""")
def dbscan_clusters(t):
    return fleet.dbscan(fleet.tf_idf(_user_counts(t), "user_id", "sig"), "user_id", "sig", eps=0.6)


@query(f"WITH c AS ({_USER_COUNTS}), d AS (SELECT sig, count(*) AS df FROM c GROUP BY 1) SELECT c.user_id, c.sig, c.n FROM c JOIN d USING (sig) WHERE df > 1 AND df < (SELECT count(DISTINCT user_id) FROM c)")
def mid_frequency_features(t):
    return fleet.mid_frequency(_user_counts(t), "user_id", "sig", most=1 << 30).select("user_id", "sig", "n")


_FILES = "SELECT l_suppkey AS machine, l_partkey AS path, max(l_shipdate) AS mtime, max(l_returnflag) AS owner, max(l_quantity) AS size FROM lineitem GROUP BY 1, 2"


def _files(t):
    """Parted by path in a given number, which later steps keep: adaptive execution would merge what is small when shuffled but large in the groups of a task."""
    rows = t("lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_returnflag", "l_quantity")
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "l_partkey")
    return rows.groupBy(F.col("l_suppkey").alias("machine"), F.col("l_partkey").alias("path")).agg(F.max("l_shipdate").alias("mtime"), F.max("l_returnflag").alias("owner"), F.max("l_quantity").alias("size"))


@query(f"""WITH f AS ({_FILES}), r AS (SELECT *, epoch(mtime) AS s, count(*) OVER (PARTITION BY path) AS n, row_number() OVER (PARTITION BY path ORDER BY mtime) AS k FROM f),
m AS (SELECT path, s AS med FROM r WHERE k = n // 2 + 1) SELECT machine, path, CAST(floor(abs(s - med) / 3600) AS BIGINT) AS hours_apart FROM r JOIN m USING (path) WHERE n >= 3 AND floor(abs(s - med) / 3600) > 20000""")
def fleet_median_outlier(t):
    return fleet.median_outliers(_files(t), "machine", "path", "mtime", hours=20000).select("machine", "path", "hours_apart")


@query(f"""WITH f AS ({_FILES}), v AS (SELECT path, owner, count(*) AS votes FROM f GROUP BY 1, 2),
b AS (SELECT *, sum(votes) OVER (PARTITION BY path) AS hosts, row_number() OVER (PARTITION BY path ORDER BY votes DESC, owner) AS k FROM v)
SELECT machine, f.path, f.owner, b.owner AS majority, votes, CAST(hosts AS BIGINT) AS hosts FROM f JOIN b ON f.path = b.path AND k = 1 AND hosts >= 3 AND votes >= 2 WHERE f.owner <> b.owner""")
def fleet_majority_outlier(t):
    return fleet.majority_outliers(_files(t), "machine", "path", "owner")


@query(f"""WITH p AS (SELECT machine, path, bool_or(size > 48) AS flag FROM ({_FILES}) GROUP BY 1, 2), c AS (SELECT *, count(*) FILTER (flag) OVER (PARTITION BY path) AS yes, count(*) OVER (PARTITION BY path) AS hosts FROM p)
SELECT machine, path, flag, yes, hosts - yes AS no FROM c WHERE hosts >= 3 AND ((flag AND yes < hosts - yes AND hosts - yes >= 2) OR (NOT flag AND hosts - yes < yes AND yes >= 2))""")
def fleet_boolean_minority(t):
    return fleet.minority_flags(_files(t), "machine", "path", F.col("size") > 48)


@query("""WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id, rank, greatest(0, n - 20) AS more FROM r WHERE rank <= 20""")
def rare_features_topn(t):
    return fleet.rare_examples(t("documents"), "source", [F.col("n_chars").desc(), F.col("doc_id")]).select("source", "doc_id", "rank", "more")


@query(f"WITH c AS ({_USER_COUNTS}), d AS (SELECT sig, count(*) AS df FROM c GROUP BY 1) SELECT c.user_id, c.sig FROM c JOIN d USING (sig) WHERE df < ceil((SELECT count(DISTINCT user_id) FROM c) * 0.8)")
def baseline_fingerprints_removed(t):
    return fleet.without_baseline(_user_counts(t), "user_id", "sig", 0.8).select("user_id", "sig")


@query(f"WITH c AS ({_USER_COUNTS}) SELECT user_id, sig FROM c WHERE sig NOT IN (SELECT sig FROM c GROUP BY 1 HAVING count(DISTINCT user_id) = (SELECT count(DISTINCT user_id) FROM c))")
def common_inventory_removed(t):
    return fleet.without_common(_user_counts(t), "user_id", "sig").select("user_id", "sig")


@query("""SELECT c.conv_id, c.turn, c.role AS name, coalesce(p.role, '[unknown:' || CAST(c.turn - 1 AS VARCHAR) || ']') AS parent_name
FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1""")
def parent_resolution(t):
    rows = t("conversations").select(F.col("conv_id").alias("machine_id"), F.col("turn").alias("pid"), (F.col("turn") - 1).alias("ppid"), F.col("role").alias("name"), F.col("turn").alias("ord"))
    return fleet.parent_names(rows).select(F.col("machine_id").alias("conv_id"), F.col("pid").alias("turn"), "name", "parent_name")


@query("""WITH f AS (SELECT CAST(o_custkey AS VARCHAR) AS host, 'price' AS detector, least(1.0, o_totalprice / 400000) AS score, 'large order' AS reason FROM orders WHERE o_totalprice > 200000
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'balance', 0.5, 'negative balance' FROM customer WHERE c_acctbal < 0)
SELECT host, round(max(score), 9) AS score, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons,
CASE WHEN max(score) >= 0.85 THEN 'critical' WHEN max(score) >= 0.65 THEN 'high' WHEN max(score) >= 0.4 THEN 'medium' ELSE 'low' END AS severity FROM f GROUP BY 1""")
def detector_fusion(t):
    a = t("orders").where("o_totalprice > 200000").select(F.col("o_custkey").cast("string").alias("host"), F.lit("price").alias("detector"), F.least(F.lit(1.0), F.col("o_totalprice") / 400000).alias("score"), F.lit("large order").alias("reason"))
    b = t("customer").where("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("host"), F.lit("balance").alias("detector"), F.lit(0.5).alias("score"), F.lit("negative balance").alias("reason"))
    return fleet.fuse_detectors(a, b).select("host", F.round("score", 9).alias("score"), F.array_join("reasons", ",").alias("reasons"), "severity")


# -- drift and time

_CUT = "TIMESTAMP '1996-01-01'"


def _halves(t, *cols):
    li = t("lineitem")
    cut = F.lit("1996-01-01").cast("timestamp")
    ts = F.col("l_shipdate").cast("timestamp")
    return li.where(ts < cut).select(*cols), li.where(ts >= cut).select(*cols)


@query(f"SELECT DISTINCT l_suppkey, l_partkey FROM lineitem a WHERE l_shipdate >= {_CUT} AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_shipdate < {_CUT} AND a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey)")
def temporal_new_signatures(t):
    return fleet.new_signatures(*_halves(t, "l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")


@query(f"""WITH a AS (SELECT l_suppkey, l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_shipdate < {_CUT} GROUP BY 1, 2), b AS (SELECT l_suppkey, l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_shipdate >= {_CUT} GROUP BY 1, 2)
SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, coalesce(a.l_partkey, b.l_partkey) AS l_partkey, CASE WHEN a.l_suppkey IS NULL THEN 'added' WHEN b.l_suppkey IS NULL THEN 'removed' ELSE 'changed' END AS change, a.q AS old_value, b.q AS new_value
FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey WHERE a.q IS DISTINCT FROM b.q""")
def baseline_drift(t):
    keys = ["l_suppkey", "l_partkey"]
    a, b = (h.groupBy(*keys).agg(F.max("l_quantity").alias("q")) for h in _halves(t, *keys, "l_quantity"))
    return correlate.drift(a, b, keys, "q")


@query(f"""WITH a AS (SELECT l_partkey, max(l_shipdate) AS m FROM lineitem WHERE l_shipdate < {_CUT} GROUP BY 1), b AS (SELECT l_partkey, max(l_shipdate) AS m FROM lineitem WHERE l_shipdate >= {_CUT} GROUP BY 1)
SELECT l_partkey, a.m AS old_mtime, b.m AS new_mtime FROM a JOIN b USING (l_partkey) WHERE a.m <> b.m""")
def temporal_modified(t):
    a, b = (h.groupBy("l_partkey").agg(F.max("l_shipdate").alias("m")) for h in _halves(t, "l_partkey", "l_shipdate"))
    return fleet.modified_files(a, b, ["l_partkey"], "m")


@query("""WITH r AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id, event_type FROM events), o AS (SELECT day, lag(day) OVER (ORDER BY day) AS before FROM (SELECT DISTINCT day FROM r))
SELECT r.day, r.user_id, r.event_type FROM r JOIN o USING (day) WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r b WHERE b.day = o.before AND b.user_id = r.user_id AND b.event_type = r.event_type)""")
def snapshot_series(t):
    return fleet.snapshot_series(t("events").withColumn("day", F.to_date("ts")), "day", "user_id", "event_type")


# -- keys and credentials


@query("""SELECT l_partkey AS fingerprint, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS hosts, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS users FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2""")
def key_reuse(t):
    p = t("lineitem").select(F.col("l_partkey").alias("fingerprint"), F.col("l_suppkey").alias("host_id"), F.col("l_returnflag").alias("username"))
    return correlate.reused_keys(p).select("fingerprint", F.array_join(F.col("hosts").cast("array<string>"), ",").alias("hosts"), F.array_join("users", ",").alias("users"))


@query("SELECT md5(text) AS hash_fingerprint, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS users FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2")
def duplicate_groups(t):
    d = t("documents").select(F.md5("text").alias("hash_fingerprint"), F.col("doc_id").alias("username"), F.lit(False).alias("locked"), F.lit(False).alias("empty_password"))
    return correlate.shared_credentials(d).select("hash_fingerprint", F.array_join(F.col("users").cast("array<string>"), ",").alias("users"))


def _placements(t):
    return t("lineitem").select(F.col("l_partkey").alias("fingerprint"), F.col("l_suppkey").alias("host_id"), F.col("l_linestatus").alias("username"), F.when(F.col("l_partkey") % 5 == 0, "ssh-rsa").otherwise("ssh-ed25519").alias("key_type"), F.when(F.col("l_partkey") % 10 == 0, 1024).otherwise(4096).alias("bits"))


_PLACEMENTS = "SELECT l_partkey AS fingerprint, l_suppkey AS host_id, l_linestatus AS username, CASE WHEN l_partkey % 5 = 0 THEN 'ssh-rsa' ELSE 'ssh-ed25519' END AS key_type, CASE WHEN l_partkey % 10 = 0 THEN 1024 ELSE 4096 END AS bits FROM lineitem"


@query(f"""WITH p AS ({_PLACEMENTS}), k AS (SELECT fingerprint, count(DISTINCT host_id) AS h, bool_or(key_type = 'ssh-rsa' AND bits < 2048) AS weak FROM p GROUP BY 1)
SELECT count(*) AS keys, count(*) FILTER (h >= 2) AS reused, count(*) FILTER (weak) AS weak, (SELECT count(DISTINCT host_id) FROM p) AS hosts, (SELECT count(DISTINCT username) FROM p) AS users FROM k""")
def key_summary(t):
    return correlate.key_summary(_placements(t))


@query(f"""WITH p AS ({_PLACEMENTS}) SELECT host_id, count(*) AS placements, count(DISTINCT fingerprint) AS keys, count(DISTINCT CASE WHEN key_type = 'ssh-rsa' AND bits < 2048 THEN fingerprint END) AS weak, array_to_string(list_sort(list(DISTINCT key_type)), ',') AS key_types FROM p GROUP BY 1""")
def key_rollup_by_host(t):
    return correlate.key_rollup(_placements(t), "host_id").withColumn("key_types", F.array_join("key_types", ","))


@query(f"""WITH p AS ({_PLACEMENTS}), k AS (SELECT fingerprint, count(DISTINCT host_id) AS h, bool_or(key_type = 'ssh-rsa' AND bits < 2048) AS weak FROM p GROUP BY 1),
f AS (SELECT fingerprint FROM k WHERE h >= 2 OR weak UNION SELECT * FROM (SELECT fingerprint FROM k ORDER BY h DESC, fingerprint LIMIT 20)), s AS (SELECT * FROM p WHERE fingerprint IN (SELECT fingerprint FROM f))
SELECT DISTINCT 'key:' || fingerprint AS source, 'host:' || host_id AS target, 'on' AS kind FROM s UNION SELECT DISTINCT 'key:' || fingerprint, 'user:' || username, 'of' FROM s""")
def key_graph_edges(t):
    return correlate.key_graph(_placements(t))[1]


@query("""SELECT conv_id, turn, time, before FROM (SELECT conv_id, turn, length(text) AS time, last_value(nullif(length(text), 0) IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations) WHERE time > 0 AND time < before""")
def login_inversions(t):
    rows = t("conversations").select("conv_id", "turn", F.length("text").alias("time"))
    return correlate.login_inversions(rows, "conv_id", "turn")


@query("""SELECT p_partkey AS path, p_brand AS expected_hash, p_type AS actual_hash FROM part WHERE lower(p_brand) <> lower(p_type)""")
def integrity_join(t):
    key = F.concat(F.lit("/usr/bin/"), "p_partkey")
    files = t("part").select(key.alias("path"), F.col("p_type").alias("md5"))
    packages = t("part").select(key.alias("path"), F.col("p_brand").alias("md5"), F.lit("base").alias("package"))
    out = correlate.integrity_mismatches(files, packages, ["/usr/bin/"])
    return out.select(F.substring_index("path", "/", -1).cast("bigint").alias("path"), "expected_hash", "actual_hash")


@query("""WITH s AS (SELECT DISTINCT o_custkey AS pid FROM orders WHERE o_totalprice > 200000), c AS (SELECT c_custkey AS pid FROM customer)
SELECT pid, array_to_string(list_sort(list(source)), ',') AS sources FROM (SELECT pid, 'nations' AS source FROM c UNION ALL SELECT pid, 'names' FROM c WHERE pid % 2 = 0) WHERE pid NOT IN (SELECT pid FROM s) GROUP BY 1""")
def hidden_set_difference(t):
    seen = lambda df, c: df.select(F.lit("h").alias("host"), F.col(c).alias("pid"), F.lit(0).alias("starttime"))
    every = seen(t("customer"), "c_custkey")
    out = correlate.hidden_processes(seen(t("orders").where("o_totalprice > 200000"), "o_custkey"), ("nations", every), ("names", every.where("pid % 2 = 0")))
    return out.select("pid", F.array_join("sources", ",").alias("sources"))


@query("""SELECT coalesce(a.k, b.k) AS name, a.k IS NOT NULL AS in_proc_modules, b.k IS NOT NULL AS in_sysfs FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def module_full_outer(t):
    view = lambda df, c: df.select(F.lit("h").alias("host"), F.col(c).alias("name")).distinct()
    return correlate.module_disagreement(view(t("orders"), "o_custkey"), view(t("customer").where("c_custkey % 3 = 0"), "c_custkey")).drop("host")


# -- Markov


def _lines(t):
    return t("conversations").select("conv_id", "turn", F.col("text").alias("line"))


_GRAMS = "SELECT conv_id, turn, substr(x, i, 2) AS ctx, substr(x, i + 2, 1) AS nxt FROM (SELECT conv_id, turn, x, unnest(generate_series(1, length(x) - 2)) AS i FROM (SELECT conv_id, turn, {} AS x FROM conversations) WHERE length(x) > 2)"
_TRAIN = _GRAMS.format("'~~' || text || '~~'")
_MODEL = f"m AS (SELECT ctx, nxt, count(*) AS n FROM ({_TRAIN}) GROUP BY 1, 2), q AS (SELECT *, n / sum(n) OVER (PARTITION BY ctx) AS p FROM m)"


def _model(t):
    model = markov.train(markov.char_grams(_lines(t), "line", 2, True, True))
    return Scratch(model.sparkSession, "markov").save(model, "model")


@query(f"WITH {_MODEL} SELECT ctx, nxt, n, round(p, 9) AS p FROM q")
def markov_transitions(t):
    return _model(t).withColumn("p", F.round("p", 9))


@query(f"WITH {_MODEL} SELECT round(0.01 * min(p), 12) AS prior FROM q")
def markov_prior(t):
    return markov.prior(_model(t)).select(F.round("prior", 12).alias("prior"))


_SCORES = f"""WITH {_MODEL}, r AS (SELECT 0.01 * min(p) AS prior FROM q), g AS ({_GRAMS.format("'~~' || text")}),
s AS (SELECT conv_id, turn, avg(ln(coalesce(p, prior))) AS score, count(*) AS n_grams FROM g LEFT JOIN q USING (ctx, nxt), r GROUP BY 1, 2)"""


def _scores(t, model=None):
    lines = _lines(t)
    return markov.score(lines, markov.char_grams(lines, "line", 2, True, False, "conv_id", "turn"), model or _model(t), "conv_id", "turn")


@query(_SCORES + " SELECT conv_id, turn, round(score, 9) AS score, n_grams FROM s")
def markov_scores(t):
    return _scores(t).withColumn("score", F.round("score", 9))


@query(_SCORES + ", z AS (SELECT conv_id, score < ln(prior) * 0.55 AS suspect FROM s, r) SELECT conv_id, count(*) AS scored, count(*) FILTER (suspect) AS suspects, round(avg(CAST(suspect AS INT)), 9) AS ratio FROM z GROUP BY 1")
def suspect_ratio_by_host(t):
    model = _model(t)
    return markov.host_ratios(markov.suspects(_scores(t, model), model, 55), "conv_id").withColumn("ratio", F.round("ratio", 9))


@query(_SCORES + " SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 9), turn) AS k FROM s) WHERE k <= 5")
def worst_lines_by_host(t):
    return markov.worst_lines(_scores(t).withColumn("score", F.round("score", 9)), "conv_id", "turn").select("conv_id", "turn")


@query(f"""WITH {_MODEL}, r AS (SELECT 0.01 * min(p) AS prior FROM q), g AS ({_GRAMS.format("'~~' || text")}),
o AS (SELECT DISTINCT conv_id, turn, ctx || nxt AS gram FROM g LEFT JOIN q USING (ctx, nxt), r WHERE ln(coalesce(p, prior)) < ln(prior) * 0.55)
SELECT conv_id, turn, string_agg(gram, ' ' ORDER BY gram) AS unusual FROM o GROUP BY 1, 2""")
def markov_explain(t):
    grams = markov.char_grams(_lines(t), "line", 2, True, False, "conv_id", "turn")
    return markov.explain(grams, _model(t), 55, "conv_id", "turn").withColumn("unusual", F.array_join("unusual", " "))


@query("""WITH w AS (SELECT ['~'] || list_filter(string_split(p_name, ' '), lambda x: x <> '') || ['~'] AS w FROM part), g AS (SELECT w[i] AS ctx, w[i + 1] AS nxt FROM w, unnest(range(1, len(w))) AS u(i)), c AS (SELECT ctx, nxt, count(*) AS n FROM g GROUP BY 1, 2)
SELECT ctx, nxt, n, round(n / sum(n) OVER (PARTITION BY ctx), 9) AS p FROM c""")
def markov_token_transitions(t):
    return markov.train(markov.token_grams(t("part"), S.word_tokens(F.col("p_name")), 1)).withColumn("p", F.round("p", 9))


# -- findings


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1 AND o_orderstatus <> 'F'")
def latest_row_tombstone(t):
    rows = t("orders").withColumn("deleted", (F.col("o_orderstatus") == "F").cast("int"))
    return triage.latest(rows, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "o_orderdate")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def retain_newest_n(t):
    return triage.retain_newest(t("orders"), "o_custkey", "o_orderdate", 3, "o_orderkey").select("o_orderkey", "o_custkey")


@query("""WITH k AS (SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k <= 1) SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM k)""")
def cascade_children(t):
    kept = triage.retain_newest(t("orders"), "o_custkey", "o_orderdate", 1, "o_orderkey").select(F.col("o_orderkey").alias("l_orderkey"))
    return triage.cascade(t("lineitem"), kept, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT d.doc_id, CASE WHEN d.source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) THEN 'false_positive' ELSE 'new' END AS status FROM documents d")
def status_inheritance(t):
    known = t("documents").join(t("labels"), "doc_id").select("source", F.when(F.col("toxic") == 1, triage.MUTED).otherwise("new").alias("status"))
    return triage.inherit_status(t("documents").select("doc_id", "source", F.lit("new").alias("status")), known, ["source"]).select("doc_id", "status")


@query("SELECT doc_id, CASE WHEN source = (SELECT source FROM documents WHERE doc_id = 3) AND lang = (SELECT lang FROM documents WHERE doc_id = 3) THEN 'false_positive' ELSE 'new' END AS status FROM documents")
def status_propagation(t):
    f = t("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("host_id"), F.col("lang").alias("check_id"), F.lit("new").alias("status"))
    return triage.set_status(f, 3, triage.MUTED).select(F.col("id").alias("doc_id"), "status")


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'purchase')")
def severity_route(t):
    e = F.col("event_type")
    f = t("events").withColumn("severity", F.when(e == "error", "critical").when(e == "purchase", "high").when(e == "signup", "medium").otherwise("info"))
    return triage.route(f, "high").select("event_id")


@query("""SELECT CAST(c_custkey AS BIGINT) AS host_id, CASE WHEN max(o_totalprice) IS NULL THEN 'clean' WHEN max(o_totalprice) > 300000 THEN 'critical' ELSE 'low' END AS severity, coalesce(max(o_totalprice), 0) AS score, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def honeycomb(t):
    f = t("orders").select(F.col("o_custkey").alias("host_id"), F.when(F.col("o_totalprice") > 300000, "critical").otherwise("low").alias("severity"), F.col("o_totalprice").alias("score"))
    return triage.honeycomb(t("customer").select(F.col("c_custkey").alias("host_id")), f)


@query("SELECT source, CASE WHEN bool_or(toxic = 1) THEN 'malicious' WHEN bool_or(toxic IS NULL) THEN 'unset' ELSE 'false_positive' END AS verdict, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def verdict_aggregation(t):
    f = t("documents").join(t("labels"), "doc_id", "left").select("source", F.when(F.col("toxic") == 1, "malicious").when(F.col("toxic") == 0, triage.MUTED).alias("verdict"))
    return triage.group_verdict(f, "source")


@query("""WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) SELECT user_id AS host_id FROM l WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-30') AND epoch(last) + 1 <= epoch(TIMESTAMP '2024-02-15')""")
def scans_due(t):
    hosts = t("events").groupBy(F.col("user_id").alias("host_id")).agg(F.max("ts").cast("timestamp").alias("last_scan")).withColumns({"enabled": F.lit(True), "every": F.lit("1d")})
    active = t("events").where((F.col("event_type") == "error") & (F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz"))).select(F.col("user_id").alias("host_id"))
    return triage.due_scans(hosts, active, F.lit("2024-02-15").cast("timestamp")).select("host_id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey LIMIT 30")
def lease_jobs(t):
    jobs = t("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "queued").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"))
    return triage.lease(jobs, 30).select("id")


# -- scalars


@query("""WITH c AS (SELECT p_partkey, unnest(string_split(regexp_replace(p_name, '[/._\\s-]', '', 'g'), '')) AS c FROM part), n AS (SELECT p_partkey, c, count(*) AS k, sum(count(*)) OVER (PARTITION BY p_partkey) AS n FROM c GROUP BY 1, 2)
SELECT p_partkey, round(-sum(k / n * log2(k / n)), 9) AS entropy FROM n GROUP BY 1""")
def entropy_text(t):
    return t("part").select("p_partkey", F.round(S.text_entropy(F.col("p_name")), 9).alias("entropy"))


@query("""SELECT page_id, url LIKE 'https:%' AS secure, regexp_extract(url, '[^/]*$') AS base FROM pages WHERE url LIKE 'https:%' OR url LIKE 'http:%'""")
def path_under_predicate(t):
    u = F.col("url")
    return t("pages").where(P.path_under(u, "https:") | P.path_under(u, "http:")).select("page_id", P.path_under(u, "https:").alias("secure"), P.basename(u).alias("base"))


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(text, 'S[-–]1[-–]([0-9]+[-–])+[0-9]+', '<SID>', 'g'), '\b(?:[A-Fa-f0-9]{64}|[A-Fa-f0-9]{40}|[A-Fa-f0-9]{32}|[A-Fa-f0-9]{20})\b', '<HASH>', 'g') AS line FROM conversations""")
def placeholder_normalisation(t):
    return t("conversations").select("conv_id", "turn", S.placeholders(F.col("text")).alias("line"))


@query("SELECT page_id, array_to_string(regexp_extract_all(url, '[/]|[^/]+'), '|') AS tokens FROM pages")
def path_tokens(t):
    return t("pages").select("page_id", F.array_join(S.path_tokens(F.col("url")), "|").alias("tokens"))


@query("""SELECT event_id, CASE WHEN value / 150 >= 1.0 THEN 'critical' WHEN value / 150 >= 0.7 THEN 'high' WHEN value / 150 >= 0.45 THEN 'medium' ELSE 'low' END AS severity FROM events""")
def severity_from_distance(t):
    return t("events").select("event_id", S.severity_of_distance(F.col("value") / 150).alias("severity"))


@query("SELECT event_id, round(greatest(least(1, value / 200), 0.7 * least(1, value / 200) + 0.3 * 0.9), 9) AS score FROM events")
def score_fusion(t):
    return t("events").select("event_id", F.round(S.fused_score(F.least(F.lit(1.0), F.col("value") / 200), F.lit(0.9)), 9).alias("score"))


@query("SELECT kind, n FROM (SELECT 'orders' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events)")
def store_counts(t):
    counts = [t(n).agg(F.lit(n).alias("kind"), F.count("*").alias("n")) for n in ("orders", "lineitem", "events")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT DISTINCT o_custkey AS host FROM orders UNION SELECT c_custkey FROM customer")
def distinct_hosts(t):
    return t("orders").select(F.col("o_custkey").alias("host")).union(t("customer").select("c_custkey")).distinct()


@query("SELECT source, sig, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'a/' || source AS source, sig, n FROM (" + _COUNTS + ") UNION ALL SELECT 'b/' || source, sig, n FROM (" + _COUNTS + ")) GROUP BY 1, 2")
def merged_profiles(t):
    p = t("documents").groupBy(F.col("source").alias("machine_id"), F.col("lang").alias("sig")).agg(F.count("*").alias("n"))
    return fleet.merged_profiles(("a", p), ("b", p)).withColumnRenamed("machine_id", "source")


@query("SELECT line AS command, round(min(score), 6) AS score, count(*) AS seen FROM (SELECT l_shipdate, l_returnflag AS line, l_discount AS score, l_suppkey FROM lineitem) GROUP BY 1")
def scored_grouping(t):
    rows = t("lineitem").select(F.col("l_returnflag").alias("command"), F.col("l_discount").alias("score"), F.col("l_suppkey").alias("machine"))
    return markov.grouped(rows, "command", "machine").select("command", F.round("score", 6).alias("score"), "seen")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events) SELECT user_id, event_id FROM r WHERE k = 2""")
def nth_newest(t):
    return triage.nth_newest(t("events"), "user_id", "ts", 2, "event_id").select("user_id", "event_id")




FLAGSHIP = QUERIES["flagship_stats_by_kind"]
