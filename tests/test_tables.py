"""Snapshots, the token index and tables merged on read."""

import datetime as dt
import os
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from harrier.functions import predicates as P
from harrier.plans.tables import _indexed
from harrier.sources.snapshots import Conflict, Snapshots
from harrier.sources.token_index import TokenIndex
from harrier.sources.versioned import VersionedTable


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, (tmp_path / "t").as_uri())
    assert s.latest() == (0, {})
    assert s.commit(0, {"a": 1}) == 1
    with pytest.raises(Conflict):
        s.commit(0, {"a": 2})
    assert s.latest() == (1, {"a": 1})
    assert s.change(lambda c: {"a": c["a"] + 1}) == 2 and s.read(2) == {"a": 2}
    for k in range(30):
        s.change(lambda c: {"a": c["a"] + 1})
    assert s.latest() == (32, {"a": 32}) and len([f for f in os.listdir(tmp_path / "t" / "_snapshots") if f.endswith(".json")]) == 20


def lines(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string").coalesce(1)


def test_token_index(spark, tmp_path):
    table, root = (tmp_path / "table").as_uri(), (tmp_path / "index").as_uri()
    for texts in (["Alpha beta", None, ""], ["beta GAMMA-alpha"], ["delta"], ["x y z"]):
        lines(spark, *texts).write.mode("append").parquet(table)
    index = TokenIndex(spark, table, "text", root, buckets=4, most_batches=2)
    assert index.files("alpha") is None  # nothing is indexed: all is read
    assert index.refresh() == 4 and index.refresh() == 0
    scan = lambda text: rows(spark.read.parquet(table).where(P.has_tokens(F.col("text"), text)))
    for text, files in (("alpha", 2), ("Beta alpha", 2), ("gamma", 1), ("nothing", 0), ("alpha delta", 0), ("x", 4), ("", 4)):
        found = index.search(text)
        assert rows(found) == scan(text)
        assert files == 4 if index.files(text) is None else len(index.files(text)) == files
        if files and index.files(text) is not None:
            assert len(found.inputFiles()) == files  # what the scan reads
    lines(spark, "alpha again").write.mode("append").parquet(table)
    assert len(index.files("gamma")) == 2 and rows(index.search("alpha")) == scan("alpha")  # a file not indexed yet is read
    index.refresh()
    assert len(index.files("gamma")) == 1 and len(index.files("alpha")) == 3
    for k in range(3):
        lines(spark, f"alpha number{k}").write.mode("append").parquet(table)
        index.refresh()
    assert len(Snapshots(spark, root).latest()[1]["batches"]) <= 2
    assert len(index.files("alpha")) == 6 and rows(index.search("alpha number1")) == scan("alpha number1") and len(index.files("number1")) == 1
    assert index.files("alpha", most=3) is None  # too many to name


def test_an_indexed_table_holds_each_row_once(spark):
    """Also where each job draws other ranges, as it does once a partition has more rows than the sample takes."""
    size = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = spark.conf.get(size)
    spark.conf.set(size, "2")
    try:
        data = spark.range(4000).selectExpr("CASE WHEN id % 500 = 7 THEN NULL ELSE id END AS id", "concat('word', id % 3, ' ', id) AS text")
        index = _indexed(data, "text")
        assert rows(spark.read.parquet(index.table)) == rows(data)
        assert rows(index.search("word1")) == rows(data.where("text LIKE 'word1 %'"))
    finally:
        spark.conf.set(size, before)


def model_of(log, first_day=""):
    """{key: row} by a plain reading of the log of (seq, deleted, row)."""
    best = {}
    for seq, deleted, row in log:
        key, rank = row[0], (row[2], seq)
        if key not in best or rank > best[key][0]:
            best[key] = (rank, deleted, row)
    return sorted(r for _, deleted, r in best.values() if not deleted and str(r[3]) >= first_day)


SCHEMA = "id long, name string, v long, d date"


def test_merge_on_read(spark, tmp_path):
    rng, log = random.Random(1), []
    t = VersionedTable(spark, (tmp_path / "t").as_uri(), SCHEMA, ["id"], "v", day="d", buckets=3, most_deltas=100)
    assert t.read().count() == 0 and t.read().columns == ["id", "name", "v", "d"]
    day = lambda i: dt.date(2024, 1, 1 + i % 4)
    first_day = ""
    for step in range(9):
        ids = rng.sample(range(40), 15)
        if step % 3 == 2:
            data = [(i, None, rng.randint(0, 6), day(i)) for i in ids[:6]]
            t.delete(spark.createDataFrame([(i, v, d) for i, _, v, d in data], "id long, v long, d date"))
        else:
            data = [(i, f"n{step}", rng.randint(0, 6), day(i)) for i in ids]
            t.upsert(spark.createDataFrame(data, SCHEMA).withColumn("clash", F.lit(1)))
        log += [(step, step % 3 == 2, r) for r in data]
        assert rows(t.read()) == model_of(log, first_day)
        if step == 4:
            before = t.snapshots.latest()[0]
            held = rows(t.read(before))
            assert t.compact()
            assert rows(t.read(before)) == held == rows(t.read())  # old and new agree, and the old one is still there
            live = set(held)  # what was deleted is forgotten, so an older version may bring its key back
            log = [x for x in log if x[2] in live and not x[1]]
        if step == 6:
            first_day = "2024-01-02"
            t.retain(first_day)
            assert rows(t.read()) == model_of(log, first_day)
    assert t.compact()
    # a compaction forgets what was deleted, so only what is left counts from here
    left = rows(t.read())
    assert left == model_of(log, first_day)
    assert t.vacuum() and rows(t.read()) == left
    t.upsert(spark.createDataFrame([(1000, "new", 1, dt.date(2024, 1, 3))], SCHEMA))
    stale = t.snapshots.latest()[1]["base"]
    assert t.compact()
    kept = t.snapshots.latest()[1]["base"]
    assert sum(kept.get(c) == f for c, f in stale.items()) >= len(stale) - 1  # only the touched cell is new
    assert len(rows(t.read())) == len(left) + 1
    assert rows(t.read().where("d = DATE'2024-01-03'")) == [r for r in rows(t.read()) if str(r[3]) == "2024-01-03"]


def test_half_a_write_is_never_seen(spark, tmp_path):
    t = VersionedTable(spark, (tmp_path / "t").as_uri(), "id long, v long", ["id"], "v", buckets=2)
    t.upsert(spark.createDataFrame([(1, 1), (None, 1)], "id long, v long"))
    before = rows(t.read())
    t._put(t._cells(spark.createDataFrame([(2, 9)], "id long, v long")).withColumns({"_deleted": F.lit(False), "_seq": F.lit(0).cast("long")}), "part=delta-never-committed")
    assert rows(t.read()) == before == [(None, 1), (1, 1)]
    number, content = t.snapshots.latest()
    t.upsert(spark.createDataFrame([(1, 5)], "id long, v long"))
    with pytest.raises(Conflict):
        t.snapshots.commit(number, content)
    assert rows(t.read()) == [(None, 1), (1, 5)]
    assert t.vacuum() == ["part=delta-never-committed"] and rows(t.read()) == [(None, 1), (1, 5)]
