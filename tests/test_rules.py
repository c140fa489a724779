"""Rules fire and stay silent as their catalogue says; null values fire nothing by accident."""

import json

from conftest import rows
from pyspark.sql import functions as F

from harrier.functions import predicates as P
from harrier.operators import rules
from harrier.sources import observations as O

LINES = [
    {"t": "process", "pid": 1, "ppid": 0, "comm": "[kthreadd]", "exe": {"s": "/tmp/x"}, "uids": [0, 0, 0, 0]},
    {"t": "process", "pid": 2, "ppid": 1, "comm": "sshd", "exe": {"s": "/usr/sbin/sshd"}, "uids": [0, 0, 0, 0], "tty": 0, "listen_ports": [22]},
    {"t": "process", "pid": 3, "comm": "x", "uids": [5, 5, 5, 5]},
    {"t": "process", "pid": 4, "comm": "evil", "exe": {"b": "L29wdC9h"}, "cmdline": [{"s": "/opt/a"}, {"s": "-p"}], "uids": [7, 7, 7, 7], "caps_eff": 1 << 21},
    {"t": "shadow_entry", "username": "a", "algorithm": "md5crypt", "locked": False, "empty_password": False},
    {"t": "account", "username": "backdoor", "uid": 0},
    {"t": "module", "name": "m", "in_sysfs": True, "in_proc_modules": False},
    {"t": "authorized_key", "key_type": "ssh-rsa", "bits": 1024, "fingerprint": "f"},
    {"t": "authorized_key", "key_type": "ssh-rsa", "bits": None, "fingerprint": "g"},
    {"t": "file_meta", "path": {"s": "/tmp/nmap"}, "mode": 0o4777, "setuid": True, "uid": 0, "size": "12"},
    {"t": "hidden_process", "pid": 9, "passes_confirmed": 1},
]


def observed(spark, kind):
    lines = spark.createDataFrame([("h", json.dumps(x)) for x in LINES] + [("h", "{broken"), ("h", "")], "host_id string, line string")
    return O.of_kind(lines, kind, "host_id")


def fired(spark, kind, key):
    out = {}
    for k, rule in rows(rules.evaluate(observed(spark, kind), kind, keep=(key,)).select(key, "check_id")):
        out.setdefault(k, set()).add(rule.removeprefix("RM-"))
    return out


def test_processes(spark):
    got = fired(spark, "process", "pid")
    assert {"PROC-0007", "PROC-0008", "PROC-0016"} <= got[1]
    assert got[2] == {"PROC-0011"}
    assert 3 not in got
    assert {"PROC-0006", "PROC-0012"} == got[4]


def test_other_kinds(spark):
    assert fired(spark, "shadow_entry", "username")["a"] == {"CRED-0001", "CRED-0003"}
    assert fired(spark, "account", "username") == {"backdoor": {"USER-0001"}}
    assert fired(spark, "module", "name") == {"m": {"KERN-0001"}}
    assert fired(spark, "authorized_key", "fingerprint") == {"f": {"CRED-0005", "USER-0008"}, "g": {"USER-0008"}}
    assert fired(spark, "file_meta", "path") == {"/tmp/nmap": {"FILE-0005", "FILE-0006", "FILE-0015"}}
    assert fired(spark, "hidden_process", "pid") == {9: {"PROC-0002"}}


def test_the_whole_catalogue_compiles(spark):
    assert len(rules.CATALOGUE) == 75 and len({r.id for r in rules.CATALOGUE}) == 75
    for kind in {r.kind for r in rules.CATALOGUE if r.where}:
        assert rules.evaluate(observed(spark, kind), kind, keep=("host_id",)).columns == ["host_id", "check_id", "severity", "title"]


def test_two_valued_comparisons(spark):
    df = spark.createDataFrame([(None,), ("x",), ("y",)], "a string")
    got = rows(df.select("a", P.same(F.col("a"), None).alias("n"), P.other(F.col("a"), "x").alias("o"), P.path_under(F.col("a"), "/").alias("u"), P.matches(F.col("a"), "x").alias("m")), F.col("a").asc_nulls_first())
    assert got == [(None, True, True, False, False), ("x", False, False, False, True), ("y", False, True, False, False)]


def test_events_and_inventory(spark):
    e = O.as_events(observed(spark, "process"), "process")
    assert e.where("message LIKE 'process %'").count() == 4
    assert O.as_file_rows(observed(spark, "file_meta")).select("permissions").first()[0] == "4777"
    assert O.as_process_rows(observed(spark, "process"), observed(spark, "hidden_process")).where("name = '(hidden)'").count() == 1


def test_bundles():
    ids = lambda name: {r.id for r in rules.resolve(rules.CATALOGUE, rules.bundle(name))}
    assert ids("pulse") < ids("standard") < ids("deep") == ids("incident") and ids("unheard of") == ids("standard")
    assert {r.kind for r in rules.CATALOGUE if r.id in ids("pulse")} == {"hidden_process", "process"}
    assert not rules.resolve(rules.CATALOGUE, ())
    own = rules.Rule("x", "process", "low", rules.yes("a"), collectors=("net.sockets",))
    assert rules.resolve([own], ["net.sockets"]) == [own] and rules.resolve([own], ["process.inventory"]) == []
    assert rules.collectors_needed([own]) == ["net.sockets"] and rules.collectors_needed([]) == sorted(rules.PULSE)


def test_inventory_files_as_events(spark):
    now = F.timestamp_seconds(F.lit(1706745600))
    files = spark.createDataFrame([("m", "/etc/a", 0, None, "2024-01-31T00:00:00Z"), ("m", "/etc/b", None, "2019-01-01T00:00:00Z", "2024-01-31T00:00:00Z"), ("m", None, 5, None, None)], "machine_id string, path string, uid int, timestamp string, mtime string")
    got = O.inventory_events(files, "file_meta", now).select("host_id", F.unix_seconds("timestamp"), "message", "process_id", "user", "cmdline").collect()
    assert sorted(map(tuple, got)) == [("m", 1706659200, "file_meta /etc/a", 0, "0", ""), ("m", 1706745600, "file_meta ", 0, "5", ""), ("m", 1706745600, "file_meta /etc/b", 0, "", "")]
    assert O.inventory_events(files.limit(0), "file_meta").count() == 0


def resolved(extent):
    return {r.id.removeprefix("RM-") for r in rules.resolve(rules.CATALOGUE, rules.bundle(extent))}


def test_bundles_of_rules():
    pulse = {"ICS-0003", "LOG-0007"} | {f"PROC-00{n:02}" for n in (1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 13, 15, 16, 17, 18, 19)}
    standard = pulse | {"CRED-0005", "KERN-0001", "KERN-0002", "KERN-0004", "NET-0005", "PERSIST-0001", "PERSIST-0002", "PERSIST-0003", "PERSIST-0005", "PERSIST-0009", "USER-0001", "USER-0003", "USER-0005", "USER-0006", "USER-0009"}
    deep = standard | {"CRED-0001", "CRED-0003", "DIR-0001", "DIR-0002", "DIR-0003", "DIR-0005", "DRIFT-0001", "FILE-0001", "FILE-0003", "FILE-0004", "FILE-0006", "FILE-0007", "FILE-0008", "FILE-0009", "FILE-0014", "FILE-0015", "LOG-0001", "LOG-0002", "LOG-0004", "USER-0002"}
    assert (resolved("pulse"), resolved("standard"), resolved("deep")) == (pulse, standard, deep)
    assert resolved("incident") == deep and resolved("no such extent") == standard
    assert {r.id.removeprefix("RM-") for r in rules.CATALOGUE if not r.enabled} == {"CRED-0002", "FILE-0005", "INC-0004", "ML-0001", "NET-0003", "POL-0032", "PROC-0011", "USER-0004", "USER-0008"}


def test_all_kinds_in_one_pass(spark, tmp_path):
    spark.createDataFrame([("h", json.dumps(x)) for x in LINES] + [("h", "{broken"), ("h", ""), ("h", None), ("h", "[1]"), ("h", '{"t": "unheard of"}')], "host_id string, line string").write.parquet(str(tmp_path / "lines"))
    parsed = O.parsed(spark.read.parquet(str(tmp_path / "lines")), "host_id")
    assert parsed.count() == len(LINES)
    every = rules.findings(parsed, rules.CATALOGUE)
    one_by_one = []
    for kind in {x["t"] for x in LINES}:
        one_by_one += rows(rules.evaluate(observed(spark, kind), kind, keep=("host_id",)))
    assert sorted(tuple(r) for r in every.select("host_id", "check_id", "severity", "title").collect()) == sorted(one_by_one)
    assert every._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1 and "Exchange" not in every._jdf.queryExecution().executedPlan().toString()
    on = {r.check_id: r for r in rules.findings(parsed).collect()}
    assert "RM-USER-0008" not in on and "RM-PROC-0011" not in on
    found = on["RM-CRED-0005"]
    assert (found.version, found.type, found.confidence, found.attack, found.match_kind, found.title) == (2, "user", "medium", "T1110", "authorized_key", "Weak SSH key ssh-rsa (1024 bits) for null")
    assert json.loads(found.evidence) == {"username": None, "key_type": "ssh-rsa", "bits": 1024, "fingerprint": "f", "path": None}
    assert json.loads(on["RM-PROC-0012"].evidence) == {"pid": 4, "comm": "evil", "euid": 7, "ruid": 7, "caps_eff": 1 << 21, "exe": "/opt/a"}
