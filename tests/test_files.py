from conftest import rows

from harrier.operators import files

SCHEMA = "machine_id string, path string, uid long, owner string, `group` string, permissions string, size long, mtime string, timestamp string, ord long"


def inventory(spark, extra=()):
    data, k = [], 0
    for h in range(4):
        for p in ("/etc/hosts", "/usr/bin/ls", "/srv/data"):
            data.append((f"h{h}", p, 0, "root", "root", "-rw-r--r--", 10, "2024-01-01 00:00:00", "2024-06-01 00:00:00", k := k + 1))
    data += [(*e, k + i) for i, e in enumerate(extra, 1)]
    f = spark.createDataFrame(data, SCHEMA)
    return f.withColumns({c: f[c].cast("timestamp") for c in ("mtime", "timestamp")})


def test_a_like_fleet_has_no_findings(spark):
    verdicts, told = files.findings(inventory(spark))
    assert verdicts.count() == 0 and told.count() == 0
    verdicts, told = files.findings(inventory(spark).limit(0))
    assert verdicts.count() == 0 and told.count() == 0


def test_what_differs_is_told(spark):
    f = inventory(spark, [
        ("h0", "/etc/hosts", 7, "bob", "root", "-rw-rw-rw-", 11, "2024-01-03 02:00:00", "2024-06-01 00:00:00"),
        ("h1", "/tmp/x", 1000, "eve", None, "-rwxrwxrwx", 5, None, None),
        ("h1", "/home/eve/a", 1000, "eve", " ", "-rw-r--r--", 5, None, None),
        (None, "/etc/shadow", 0, "root", "root", "-rw-rw-rw-", 5, None, None),
    ])
    verdicts, told = files.findings(f)
    got = {(r.machine_id, r.severity, r.distance, r.suspicious) for r in verdicts.collect()}
    assert got == {("h0", "critical", 2.0, 6), ("h1", "high", 0.8, 1)}
    texts = [(r.machine_id, r.kind, r.detail) for r in told.collect()]
    assert ("h0", "mtime", "MTIME ANOMALY: /etc/hosts modified 50h NEWER than fleet baseline") in texts
    assert ("h0", "metadata", "METADATA ANOMALY: owner on /etc/hosts is 'bob' (fleet majority: 'root')") in texts
    assert ("h0", "metadata", "METADATA ANOMALY: size on /etc/hosts is 11 bytes (fleet majority: 10 bytes)") in texts
    assert ("h0", "access", "FLEET OUTLIER: world-writable /etc/hosts - 3 of 4 hosts are not world-writable (minority)") in texts
    assert ("h0", "access", "FLEET OUTLIER: group-writable /etc/hosts under /etc or /tmp - 3 of 4 hosts are not group-writable (minority)") in texts
    assert [t for t in texts if t[0] == "h1"] == [("h1", "rare", "Rare file access: /tmp/x [suspicious_path,world_writable]")]


def test_rare_examples_and_the_rest(spark):
    many = [("h2", f"/tmp/{i:02d}", 5, "bob", None, "-rw-r--r--", 1, None, None) for i in range(9)]
    verdicts, told = files.findings(inventory(spark, many), most=3)
    assert rows(verdicts.select("machine_id", "severity", "suspicious", "more")) == [("h2", "high", 3, 6)]
    assert [r.path for r in told.orderBy("path").collect()] == ["/tmp/00", "/tmp/01", "/tmp/02"]


def test_baseline_and_profile(spark):
    f = files.flagged(inventory(spark, [("h3", "/srv/data", 0, "7", None, "0644", 10, "2024-05-05 00:00:00", None)]))
    known, b = files.last_known(f), files.buckets(f)
    left = files.off_baseline(b, known, 0.75)
    assert rows(left.select("machine_id", "path", "euid")) == [("h3", "/srv/data", 0), ("h3", "/srv/data", 7)]
    assert rows(known.where("machine_id = 'h3' AND path = '/srv/data'").select("owner", "group")) == [("7", "root")]
    p = files.profile(f)
    assert len(p.columns) == 13 - 1 and p.where("n = 1").count() == 13
