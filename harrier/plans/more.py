"""More queries over the driver's tables: rules, scalars, triage steps, and files written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrier.functions import predicates as P
from harrier.functions import scalars as S
from harrier.operators import correlate, rules, triage
from harrier.operators.rules import Rule
from harrier.sources import observations, readers, sinks
from harrier.storage import Scratch

from .registry import query

# -- rules

_SUDO = "SELECT c_custkey AS host_id, c_nationkey % 2 = 0 AS nopasswd, c_custkey % 3 = 0 AS all_commands, CASE WHEN c_custkey % 5 = 0 THEN 'Defaults SETENV' ELSE c_name END AS line FROM customer"


@query(f"WITH s AS ({_SUDO}) SELECT host_id, 'RM-USER-0005' AS check_id, 'high' AS severity FROM s WHERE nopasswd AND all_commands UNION ALL SELECT host_id, 'RM-USER-0006', 'high' FROM s WHERE line LIKE '%!authenticate%' OR line LIKE '%SETENV%'")
def rules_of_the_catalogue(t):
    line = F.when(F.col("c_custkey") % 5 == 0, "Defaults SETENV").otherwise(F.col("c_name"))
    sudo = t("customer").select(F.col("c_custkey").alias("host_id"), (F.col("c_nationkey") % 2 == 0).alias("nopasswd"), (F.col("c_custkey") % 3 == 0).alias("all_commands"), line.alias("line"))
    return rules.evaluate(sudo, "sudo_rule", keep=("host_id",)).select("host_id", "check_id", "severity")


OWN_RULES = [
    Rule("equal", "order", "low", rules.eq("o_orderstatus", "F")),
    Rule("differs", "order", "low", rules.ne("o_orderstatus", "F", "O")),
    Rule("number", "order", "high", rules.num("o_totalprice", lambda c: c > 250000)),
    Rule("either", "order", "low", rules.either(rules.starts("o_orderpriority", "1-", "2-"), rules.ends("o_orderpriority", "LOW"))),
    Rule("neither", "order", "low", rules.both(rules.no(rules.has("o_orderpriority", "URGENT", "HIGH")), rules.eq("o_orderstatus", "P"))),
    Rule("pattern", "order", "medium", rules.like("o_orderpriority", "^[34]-.*[DM]$")),
    Rule("known", "order", "low", rules.both(rules.known("o_orderkey"), rules.eq("o_orderstatus", "P"))),
]


@query("""SELECT o_orderkey, 'equal' AS check_id FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'differs' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT o_orderkey, 'number' FROM orders WHERE o_totalprice > 250000 UNION ALL SELECT o_orderkey, 'either' FROM orders WHERE o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%' OR o_orderpriority LIKE '%LOW'
UNION ALL SELECT o_orderkey, 'neither' FROM orders WHERE o_orderpriority NOT LIKE '%URGENT%' AND o_orderpriority NOT LIKE '%HIGH%' AND o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'pattern' FROM orders WHERE regexp_matches(o_orderpriority, '^[34]-.*[DM]$') UNION ALL SELECT o_orderkey, 'known' FROM orders WHERE o_orderstatus = 'P'""")
def rules_by_operator(t):
    return rules.evaluate(t("orders"), "order", OWN_RULES, ("o_orderkey",)).select("o_orderkey", "check_id")


@query("SELECT page_id FROM pages WHERE regexp_extract(url, '^https?://[^/]*', 0) IN ('https://', 'http://') OR url = 'https:' OR url LIKE 'https:/%'")
def rules_path_under(t):
    return t("pages").where(P.under_any(F.col("url"), "https:")).select("page_id")


@query("SELECT event_id FROM events WHERE event_type = 'click'")
def flt_tagged(t):
    return t("events").where(P.tagged(F.to_json(F.struct(F.array("event_type").alias("tags"))), "click")).select("event_id")


# -- scalars


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.8 WHEN 'P' THEN 0.5 ELSE 0.25 END AS score,
CASE WHEN o_totalprice / 400000 >= 0.85 THEN 'critical' WHEN o_totalprice / 400000 >= 0.65 THEN 'high' WHEN o_totalprice / 400000 >= 0.4 THEN 'medium' ELSE 'low' END AS severity FROM orders""")
def severity_and_score(t):
    named = F.when(F.col("o_orderstatus") == "F", "critical").when(F.col("o_orderstatus") == "O", "high").when(F.col("o_orderstatus") == "P", "medium")
    return t("orders").select("o_orderkey", S.score_of_severity(named).alias("score"), S.severity_of_score(F.col("o_totalprice") / 400000).alias("severity"))


@query("""SELECT event_id, strftime(CASE WHEN event_id % 3 = 2 THEN make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS at FROM events""")
def times_of_many_formats(t):
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 3
    text = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(ts, "yyyy/MM/dd HH:mm:ss")).otherwise(F.unix_seconds(ts).cast("string"))
    return t("events").select("event_id", F.date_format(S.parse_time(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""SELECT p_partkey, p_partkey % 2 = 1 AS world, p_partkey % 3 = 1 AS grouped, CASE WHEN p_partkey % 3 = 1 THEN CASE WHEN p_partkey % 2 = 1 THEN '0766' ELSE '0764' END ELSE CASE WHEN p_partkey % 2 = 1 THEN '0746' ELSE '0744' END END AS mode FROM part""")
def file_modes(t):
    text = F.concat(F.lit("-rwxr"), F.when(F.col("p_partkey") % 3 == 1, "w").otherwise("-"), F.lit("-r"), F.when(F.col("p_partkey") % 2 == 1, "w").otherwise("-"), F.lit("-"))
    return t("part").select("p_partkey", S.world_writable(text).alias("world"), S.group_writable(text).alias("grouped"), S.octal_mode(text).alias("mode"))


@query("SELECT page_id, coalesce(string_split(url, '/')[-2], '') AS above, coalesce(string_split(url, '/')[-3], '') AS higher FROM pages")
def parent_directories(t):
    return t("pages").select("page_id", S.parent_directory(F.col("url")).alias("above"), S.parent_directory(F.col("url"), 2).alias("higher"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 60 WHEN 1 THEN p_size * 3600 WHEN 2 THEN p_size * 86400 END AS seconds FROM part")
def intervals(t):
    unit = F.element_at(F.array(*map(F.lit, ("m", "h", "d", " years"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t("part").select("p_partkey", S.interval_seconds(F.concat(F.col("p_size").cast("string"), unit)).alias("seconds"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'sha512crypt' WHEN 1 THEN 'yescrypt' WHEN 2 THEN 'bcrypt' WHEN 3 THEN '!' WHEN 4 THEN 'empty' ELSE 'md5crypt' END AS algorithm, p_partkey % 6 IN (0, 3) AS weak FROM part""")
def credential_strength(t):
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % 6 + 1).cast("int"))
    bits = F.when(F.col("p_partkey") % 6 == 0, 1024).otherwise(4096)
    return t("part").select("p_partkey", S.shadow_algorithm(pick("$6$a$b", "$y$a$b", "$2b$a$b", "!$6$a", "", "$1$a$b")).alias("algorithm"), S.weak_key(pick("ssh-rsa", "ssh-rsa", "ssh-rsa", "ssh-dss", "ssh-ed25519", "ssh-rsa"), bits).alias("weak"))


@query("SELECT s_suppkey, 'Supplier ' || s_name || ' of nation ' || CAST(s_nationkey AS VARCHAR) || ': null' AS title FROM supplier")
def finding_titles(t):
    fields = {"s.name": F.col("s_name"), "nation": F.col("s_nationkey")}
    return t("supplier").select("s_suppkey", S.title("Supplier {{s.name}} of nation {{nation}}: {{missing}}", fields).alias("title"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'cpu:init' ELSE 'cpu:odd load' END AS grp FROM customer")
def triage_keys(t):
    reason = F.when(F.col("c_custkey") % 2 == 0, "Rare process: init").otherwise("odd load")
    return t("customer").select("c_custkey", S.triage_group(F.lit("cpu"), reason).alias("grp"))


# -- triage

_FOUND = "SELECT o_orderkey AS id, o_custkey AS host_id, o_orderpriority AS detector, o_orderstatus AS grp, o_totalprice / 500000 AS score, CASE WHEN o_orderstatus = 'F' THEN 'false_positive' WHEN o_totalprice > 300000 THEN 'malicious' END AS verdict FROM orders"


def _found(t):
    verdict = F.when(F.col("o_orderstatus") == "F", triage.MUTED).when(F.col("o_totalprice") > 300000, "malicious")
    return t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("host_id"), F.col("o_orderpriority").alias("detector"), F.col("o_orderstatus").alias("grp"), (F.col("o_totalprice") / 500000).alias("score"), verdict.alias("verdict"))


@query(f"WITH f AS ({_FOUND}) SELECT host_id, round(CASE WHEN bool_and(coalesce(verdict, '') = 'false_positive') THEN 0 ELSE max(score) END, 9) AS score FROM f GROUP BY 1")
def effective_scores(t):
    return triage.effective_score(_found(t)).withColumn("score", F.round("score", 9))


@query(f"""WITH f AS ({_FOUND}), g AS (SELECT host_id, detector, grp, CASE WHEN bool_or(coalesce(verdict, '') = 'malicious') THEN 'malicious' WHEN bool_or(verdict IS NULL) THEN 'unset' ELSE 'false_positive' END AS v FROM f GROUP BY 1, 2, 3), n AS (SELECT host_id, count(*) AS n FROM g GROUP BY 1)
SELECT id, v AS verdict, n = 1 AND v <> 'unset' AS final FROM f JOIN g USING (host_id, detector, grp) JOIN n USING (host_id)""")
def unified_verdicts(t):
    return triage.unify_verdicts(_found(t)).select("id", "verdict", "final")


@query(f"WITH f AS ({_FOUND}) SELECT detector, grp AS reason, arg_max(verdict, id) AS verdict FROM f WHERE verdict IS NOT NULL GROUP BY 1, 2")
def precedents(t):
    history = _found(t).select("detector", F.col("grp").alias("reason"), "verdict", F.col("id").alias("at"))
    return triage.newest_precedents(history)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderdate DESC, o_orderkey DESC LIMIT 50")
def findings_page(t):
    f = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("host_id"), F.col("o_orderpriority").alias("severity"), F.col("o_orderdate").alias("first_seen"), F.col("o_orderdate").alias("last_seen"))
    return triage.findings_list(f, 50, severity="1-URGENT").select("id")


@query("""WITH s AS (SELECT o_custkey AS host, o_orderkey AS scan_id, o_orderdate AS ts FROM orders WHERE o_orderstatus = 'O'), n AS (SELECT host, max(ts) AS ts FROM s GROUP BY 1), k AS (SELECT host, max(scan_id) AS scan_id FROM s JOIN n USING (host, ts) GROUP BY 1)
SELECT l_orderkey, l_linenumber FROM lineitem JOIN k ON l_orderkey = scan_id""")
def latest_scan_of_kind(t):
    scans = t("orders").select(F.col("o_custkey").alias("host"), F.col("o_orderkey").alias("scan_id"), F.col("o_orderstatus").alias("kind"), F.struct("o_orderdate", "o_orderkey").alias("ts"))
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("host"), F.col("l_orderkey").alias("scan_id"), "l_linenumber")
    return triage.latest_of_kind(rows, scans, "host", "O", "ts").select(F.col("scan_id").alias("l_orderkey"), "l_linenumber")


# -- tables and files


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def upsert_latest(t):
    rows = t("orders").select("o_custkey", "o_orderkey", F.lit(0).alias("deleted"))
    odd = F.col("o_orderkey") % 2 == 1
    return sinks.upserted(rows.where(odd), rows.where(~odd), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAYS AND user_id NOT IN (SELECT user_id FROM events WHERE value > 195)")
def retention_and_deletion(t):
    kept = sinks.retained(t("events"), F.lit("2024-01-20").cast("timestamp_ntz"), "ts", 7)
    return sinks.without(kept, t("events").where("value > 195"), "user_id").select("event_id")


@query("SELECT l_partkey AS fingerprint, max(l_shipdate) AS last_seen, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS tags FROM lineitem GROUP BY 1")
def merged_placements(t):
    rows = t("lineitem").select(F.col("l_partkey").alias("fingerprint"), F.col("l_shipdate").alias("last_seen"), F.array("l_returnflag").alias("tags"))
    open_ = F.col("last_seen") < F.lit("1996-01-01").cast("timestamp")
    return sinks.merged_keys(rows.where(open_), rows.where(~open_)).withColumn("tags", F.array_join("tags", ","))


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-09 12:00:00'")
def event_table_scan(t):
    events = t("events").select("event_id", "event_type", F.col("user_id").alias("host_id"), F.lit("linux").alias("platform"), F.col("ts").cast("timestamp").alias("timestamp"))
    path = Scratch(events.sparkSession, "events").path("events")
    sinks.append_events(events, path)
    return sinks.scan_events(events.sparkSession, path, "2024-01-05 00:00:00", "2024-01-09 12:00:00").select("event_id", "event_type")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'missing kind' WHEN event_id % 11 = 0 THEN 'no JSON object' ELSE 'good' END AS verdict FROM events")
def checked_json_lines(t):
    whole = F.to_json(F.struct("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("kind")))
    lines = t("events").select("event_id", F.when((F.col("event_id") % 11 == 0) & (F.col("event_id") % 7 != 0), "not json").otherwise(whole).alias("line"))
    good, bad = sinks.checked_lines(lines, ("event_id", "kind"))
    return good.select("event_id", F.lit("good").alias("verdict")).unionByName(bad.select("event_id", F.col("error").alias("verdict")))


@query("SELECT conv_id, turn, role AS name, text AS args FROM conversations")
def process_lines_round_trip(t):
    rows = t("conversations").select(F.col("conv_id").cast("string").alias("machine_id"), F.col("turn").alias("pid"), F.col("role").alias("name"), F.col("text").alias("args"))
    path = Scratch(rows.sparkSession, "lines").path("export")
    sinks.export_lines(rows, "process", path)
    back = rows.sparkSession.read.schema("Computer string, ProcessId long, ProcessName string, CommandLine string").json(path)
    return back.select(F.col("Computer").cast("long").alias("conv_id"), F.col("ProcessId").alias("turn"), F.col("ProcessName").alias("name"), F.coalesce("CommandLine", F.lit("")).alias("args"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'acme' ELSE 'web01' END AS host, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def hosts_and_days_of_paths(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    path = F.concat(F.lit("/data/"), day, F.when(F.col("o_orderkey") % 2 == 0, "/acme").otherwise("/web01"), F.lit("/processes.json"))
    return t("orders").select("o_orderkey", readers.host_of_path(path).alias("host"), readers.day_of_path(path).cast("string").alias("day"))


@query("SELECT c_custkey AS uid, coalesce(n_name, 'nobody') AS shell FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def passwd_lines(t):
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    line = F.concat_ws(":", "c_name", F.lit("x"), "c_custkey", F.lit("100"), F.lit(""), F.lit("/home/x"), F.coalesce("n_name", F.lit("nobody")))
    return readers.passwd(rows.select(line.alias("line"))).select("uid", "shell")


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice < 50000)")
def confirmed_twice(t):
    pick = lambda cond: t("orders").where(cond).select(F.lit("h").alias("host"), F.col("o_custkey").alias("pid"), F.lit(0).alias("starttime")).distinct()
    return correlate.confirmed(pick("o_totalprice > 200000"), pick("o_totalprice < 50000")).select(F.col("pid").alias("c_custkey")).distinct()


_TYPES = "SELECT event_id, event_type, CASE WHEN event_id % 11 = 0 THEN 'tombstone_frame' WHEN event_id % 5 = 0 THEN 'log' ELSE event_type END AS data_type FROM events"


@query(f"""WITH e AS ({_TYPES}) SELECT event_id, data_type LIKE 'c%' OR event_type LIKE 'c%' AS c, data_type = 'click' OR event_type = 'click' AS click, data_type = 'tombstone_frame' AS crash FROM e""")
def flt_data_type(t):
    kind = F.when(F.col("event_id") % 11 == 0, "tombstone_frame").when(F.col("event_id") % 5 == 0, "log").otherwise(F.col("event_type"))
    ext = F.to_json(F.struct("event_type"))
    return t("events").select("event_id", P.of_type(kind, ext, "c*").alias("c"), P.of_type(kind, ext, "click").alias("click"), P.of_type(kind, ext, "tombstone_backtrace").alias("crash"))


_PROCESSES = """SELECT c_nationkey AS machine_id, c_custkey AS pid, c_name AS name, c_nationkey AS uid, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '/bin/' || c_name END AS path,
CASE WHEN c_custkey % 2 = 0 THEN ' ' || c_mktsegment ELSE '' END AS args, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN '2020-01-01T00:00:00Z' WHEN c_custkey % 7 = 0 THEN 'yesterday' ELSE '2024-01-01T00:00:00Z' END AS stamp FROM customer"""


@query(f"""WITH p AS ({_PROCESSES}) SELECT machine_id AS host_id, CASE WHEN stamp LIKE '2024%' THEN 1704067200 ELSE 1706745600 END AS at, CAST(uid AS VARCHAR) AS "user", (CASE path WHEN '' THEN name ELSE path END) || (CASE args WHEN '' THEN '' ELSE ' ' || trim(args) END) AS cmdline,
'process pid=' || pid || ' comm=' || name || ' exe=' || (CASE path WHEN '' THEN chr(8212) ELSE path END) || (CASE args WHEN '' THEN '' ELSE ' args=' || trim(args) END) AS message FROM p""")
def inventory_to_events(t):
    key = F.col("c_custkey")
    stamp = F.when(key % 4 == 0, None).when(key % 5 == 0, "2020-01-01T00:00:00Z").when(key % 7 == 0, "yesterday").otherwise("2024-01-01T00:00:00Z")
    path = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("/bin/"), "c_name"))
    args = F.when(key % 2 == 0, F.concat(F.lit(" "), "c_mktsegment")).otherwise("")
    own = t("customer").select(F.col("c_nationkey").alias("machine_id"), key.alias("pid"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("uid"), path.alias("path"), args.alias("args"), stamp.alias("timestamp"))
    found = observations.inventory_events(own, "process", F.timestamp_seconds(F.lit(1706745600)))
    return found.select("host_id", F.unix_seconds("timestamp").alias("at"), "user", "cmdline", "message")
