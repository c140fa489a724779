import pytest
from conftest import rows
from pyspark.sql import functions as F

from harrier.operators import detection, markov


def tables(spark):
    datasets = spark.createDataFrame([("d1", "process", ["old"]), ("d2", "Mixed", ["new"]), ("d3", "file", ["new", "x"]), ("d4", None, None)], "dataset_id string, kind string, tags array<string>")
    p, f, k = [], [], 0
    for d in ("d1", "d2"):
        for h in ("a", "b", "c"):
            p.append((d, h, 1, 0, "systemd", 0, "/sbin/init", "", k := k + 1))
            p += [(d, h, 100 + i, 1, "nginx", 33, "/usr/sbin/nginx", "-g daemon", k := k + 1) for i in range(20)]
    p.append(("d2", "c", 7, 1, "xmrig", 0, "/tmp/.x/xmrig", "zq!9#zq!9#zq!9#", k + 1))
    for d in ("d2", "d3"):
        for h in ("a", "b", "c", "e"):
            f.append((d, h, "/etc/hosts", 0, "bob" if (d, h) == ("d3", "e") else "root", "root", "-rw-r--r--", 10, None, None, k := k + 1))
    processes = spark.createDataFrame(p, "dataset_id string, machine_id string, pid long, ppid long, name string, uid long, path string, args string, ord long")
    inventory = spark.createDataFrame(f, "dataset_id string, machine_id string, path string, uid long, owner string, `group` string, permissions string, size long, mtime string, timestamp string, ord long")
    return datasets, processes, inventory.withColumns({c: inventory[c].cast("timestamp") for c in ("mtime", "timestamp")})


def test_datasets_and_arms(spark):
    datasets = tables(spark)[0]
    pick = lambda **k: [r[0] for r in rows(detection.selected(datasets, **k).select("dataset_id"))]
    assert pick() == ["d1", "d2", "d3", "d4"] and pick(ids=("d1", "d4")) == ["d1", "d4"]
    assert pick(tags=("new",)) == ["d2", "d3"] and pick(ids=("d1", "d2"), tags=("new", "old")) == ["d1", "d2"]
    by_focus = {f: [(p, q) for _, p, q in rows(detection.arms(datasets, f).select("dataset_id", "process_arm", "file_arm"))] for f in ("auto", "process", "file")}
    assert by_focus["auto"] == [(True, False), (True, True), (False, True), (False, False)]
    assert by_focus["process"] == [(True, False), (True, False), (False, True), (False, False)]
    assert by_focus["file"] == [(True, False), (False, True), (False, True), (False, False)]
    assert [detection.suspect_percent(x) for x in (95.0, 10.0, 200.0, -1.0, float("nan"))] == [95.0, 55.0, 99.999, 95.0, 95.0]


def test_run(spark):
    datasets, processes, inventory = tables(spark)
    findings, told = detection.run(datasets, processes, inventory)
    got = {r.machine_id: (r.severity, r.detectors) for r in findings.collect()}
    assert got == {"d2/c": ("high", ["process"]), "d3/e": ("critical", ["file"])}
    findings, _ = detection.run(datasets, processes, inventory, ids=("d2",))
    assert [r.machine_id for r in findings.collect()] == ["c"]  # one dataset: hosts keep their names
    lines = processes.where("path <> '/tmp/.x/xmrig'").select(F.concat_ws(" ", "path", "args").alias("line"))
    model = markov.train(markov.char_grams(lines, "line", 3, False, False))
    findings, told = detection.run(datasets, processes, inventory, model, 3, tags=("new",), mode="markov")
    assert [(r.machine_id, r.detectors) for r in findings.collect()] == [("c", ["markov"])] and told.count() == 1
    for wrong in ({"ids": ("none",)}, {"mode": "markov"}, {"mode": "other"}, {"ids": ("d4",)}):
        with pytest.raises(ValueError):
            detection.run(datasets, processes, inventory, **wrong)
