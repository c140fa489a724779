import gzip
import json
import os
import tracemalloc
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from harrier.plans import registry, tables  # noqa: F401 - the latter adds its queries
from harrier.sources import envelopes as E
from harrier.sources import observations as O


def lines_of(data, limits, size=7):
    return [(a, None if x is None else x.decode(), e) for a, x, e in E.bounded((data[i : i + size] for i in range(0, len(data), size)), limits)]


def test_bounds():
    data = b"abc\n\n" + b"x" * 30 + b"\r\nlast"
    whole = [(0, "abc", None), (5, "x" * 30, None), (37, "last", None)]
    for size in (1, 2, 7, 1000):
        assert lines_of(data, E.Limits(), size) == whole
        assert lines_of(data, E.Limits(line=20), size) == [whole[0], (5, None, E.TOO_LONG), whole[2]]
        assert lines_of(data, E.Limits(lines=1), size) == [whole[0], (5, None, E.TOO_MANY)]
        assert lines_of(data, E.Limits(lines=2), size) == [*whole[:2], (37, None, E.TOO_MANY)]
        assert lines_of(data, E.Limits(bytes=10), size) == [whole[0], (5, None, E.TOO_LARGE)]
    assert lines_of(b"", E.Limits()) == [] and lines_of(b"\n\r\n", E.Limits()) == []


def test_a_line_of_a_gigabyte():
    def chunks():
        for _ in range(1024):
            yield b"x" * E.CHUNK
        yield b"\nnext\n"

    tracemalloc.start()
    got = list(E.bounded(chunks(), E.Limits(bytes=1 << 40)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(0, None, E.TOO_LONG), ((1 << 30) + 1, b"next", None)]
    assert peak < 4 * E.CHUNK


SMALL = "/root/testdata/sf0.001"
SCAN = [
    {"kind": "hello", "schema": 3, "arch": "x86_64", "caps": {"statx": True, "cgroup_v2": False}},
    {"kind": "obs", "c": "process.inventory", "n": 0, "d": {"t": "process", "pid": 7, "exe": {"s": "/tmp/x"}, "comm": "x"}},
    {"kind": "obs", "c": "process.inventory", "n": 1, "d": {"t": "account", "username": "a", "uid": 0}},
    {"kind": "collector_status", "c": "process.inventory", "status": "ok", "stats": {"observations": 2, "bytes_read": 9}},
    {"kind": "error", "c": None, "code": "E1", "msg": "no"},
    {"kind": "summary", "outcome": "complete", "observation_count": 2},
]


def test_envelopes(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text("\n".join(map(json.dumps, SCAN)) + "\n")
    (tmp_path / "b.ndjson").write_text("{broken\n" + json.dumps({"kind": "what"}) + "\n" + json.dumps(SCAN[1]) + "\n" + "y" * 400 + "\n")
    (tmp_path / "_hidden").write_text(json.dumps(SCAN[1]))
    env = E.read_envelopes(spark, tmp_path.as_uri(), E.Limits(line=300))
    name = F.regexp_extract("file", "([^/]+)$", 1).alias("file")
    assert rows(E.hellos(env).select("schema", "arch", "caps", "euid")) == [(3, "x86_64", ["statx"], None)]
    assert rows(E.collector_statuses(env).select("collector", "status", "observations")) == [("process.inventory", "ok", 2)]
    assert rows(E.summaries(env).select("outcome", "observation_count")) == [("complete", 2)]
    assert rows(E.errors(env).select(name, "code", "msg")) == [("a.ndjson", "E1", "no"), ("b.ndjson", "framing", E.TOO_LONG), ("b.ndjson", "framing", "no JSON"), ("b.ndjson", "framing", "unknown kind")]
    assert rows(E.scans(env).select(name, "told", "observations", "complete")) == [("a.ndjson", 2, 2, True), ("b.ndjson", None, 1, False)]
    seen = O.parsed(E.observation_lines(env), "collector")
    assert rows(seen.select("kind", "process.exe", "account.username")) == [("account", None, "a"), ("process", "/tmp/x", None), ("process", "/tmp/x", None)]
    assert E.read_envelopes(spark, (tmp_path / "nothing").as_uri()).count() == 0


def test_compressed_files(spark, tmp_path):
    text = "\n".join(map(json.dumps, SCAN)) + "\n" + "y" * 400_000 + "\n" + json.dumps(SCAN[1]) + "\n"
    for kind in ("plain", "gz", "broken", "stream"):
        (tmp_path / kind).mkdir()
    (tmp_path / "plain/a").write_text(text)
    (tmp_path / "gz/a.gz").write_bytes(gzip.compress(text[:700].encode()) + gzip.compress(text[700:].encode()))
    (tmp_path / "broken/a.gz").write_bytes(gzip.compress(text.encode())[:-30])
    (tmp_path / "broken/b.gz").write_text("no gzip")
    read = lambda kind: E.read_envelopes(spark, (tmp_path / kind).as_uri()).select("at", "kind", F.to_json("v"), "error")
    assert rows(read("gz")) == rows(read("plain")) and len(rows(read("gz"))) == len(SCAN) + 2
    assert [r[0] for r in rows(read("broken").where(F.col("error") == E.BROKEN).select("kind"))] == ["error", "error"]
    found = E.stream_envelopes(spark, (tmp_path / "stream").as_uri()).select("at", "kind", F.to_json("v"), "error")
    q = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
    for name, kind in (("a.gz", "gz/a.gz"), ("b", "plain/a")):
        (tmp_path / "stream" / name).write_bytes((tmp_path / kind).read_bytes())
        q.processAllAvailable()
    q.stop()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == sorted(rows(read("plain")) * 2)


def test_small_files_share_a_task(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"{k}.ndjson").write_text(json.dumps(SCAN[1] | {"n": k}) + "\n")
    found = E.observation_lines(E.read_envelopes(spark, tmp_path.as_uri()))
    assert found.rdd.getNumPartitions() == 5
    assert rows(found.select("n")) == [(k,) for k in range(300)]


def test_scan_files_take_little_disk(spark):
    """Lines that are too long are neither shuffled nor kept at their length."""
    if not os.path.isdir(SMALL):
        pytest.skip("no tables")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("harrier-scans-*"))
    told = registry.QUERIES["scan_files"](spark, SMALL).agg(F.sum("errors")).first()[0]
    (made,) = set(shared.glob("harrier-scans-*")) - before
    assert told > 5 and sum(f.stat().st_size for f in made.rglob("*") if f.is_file()) < told * 300_000 / 10


def test_a_stream_of_growing_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    obs = lambda n: json.dumps(SCAN[1] | {"n": n}) + "\n"
    (source / "a").write_text(obs(0) + obs(1)[:-20])  # the second line is still being written
    found = E.observation_lines(E.stream_envelopes(spark, source.as_uri()))
    start = lambda: found.select("n", "at").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
    read = lambda: [r.n for r in spark.read.parquet(str(tmp_path / "out")).orderBy("n").collect()]
    q = start()
    q.processAllAvailable()
    assert read() == [0]
    with open(source / "a", "a") as f:
        f.write(obs(1)[-20:])
    (source / "b").write_text("z" * 300_000 + "\n" + obs(2))
    q.processAllAvailable()
    q.stop()
    assert read() == [0, 1, 2]
    (source / "c").write_text(obs(3))
    q = start()  # goes on from its checkpoint
    q.processAllAvailable()
    q.stop()
    assert read() == [0, 1, 2, 3]
