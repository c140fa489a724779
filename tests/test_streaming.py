import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from harrier.functions import predicates as P
from harrier.operators import markov as batch_markov
from harrier.streaming import hunt, markov, scans

SCHEMA = "ts timestamp, kind string, line string"


def source(spark, path):
    data = [("2024-01-01 00:00:00", "a", "abcabc"), ("2024-01-01 00:04:00", "b", "abcabd"), ("2024-01-01 00:06:00", "a", "zzz")]
    spark.createDataFrame(data, "ts string, kind string, line string").selectExpr("to_timestamp(ts) ts", "kind", "line").write.parquet(path)
    return spark.readStream.schema(SCHEMA).parquet(path)


def test_timechart_and_filter(spark, tmp_path):
    stream = source(spark, str(tmp_path / "in"))
    q = hunt.timechart(hunt.realtime_filter(stream, P.equals(F.col("kind"), "a")), "ts", "5m", "kind").writeStream.format("memory").queryName("chart").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r[1], r[2]) for r in rows(spark.table("chart"))] == [("a", 1), ("a", 1)]


def test_training_in_batches(spark, tmp_path):
    q = markov.train_batches(source(spark, str(tmp_path / "in")), "line", 1, str(tmp_path / "model"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = dict(((r.ctx, r.nxt), r.n) for r in markov.trained(spark, str(tmp_path / "model")).collect())
    assert got["a", "b"] == 4 and got["z", "z"] == 2


def test_only_searches_run_in_real_time():
    try:
        hunt.admit(["stats"])
    except ValueError as e:
        assert "stats" in str(e)
    else:
        raise AssertionError


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "line string")


def test_a_trainer_stays_small_and_counts_batches_once(spark, tmp_path):
    trainer = markov.Trainer(spark, (tmp_path / "model").as_uri(), 1, most_deltas=3)
    texts = [f"ab{k % 3}" for k in range(12)]
    for k, t in enumerate(texts):
        assert trainer.add(lines(spark, t), "line", k)
        assert not trainer.add(lines(spark, t), "line", k)  # comes again at once
    assert not trainer.add(lines(spark, texts[0]), "line", 0)  # or after it went into the base
    want = batch_markov.train(batch_markov.char_grams(lines(spark, *texts), "line", 1, True, True))
    assert rows(markov.trained(spark, (tmp_path / "model").as_uri())) == rows(want)
    folders = [f.name for f in (tmp_path / "model").iterdir() if f.name.startswith(("base", "delta"))]
    assert len(folders) <= 4
    trainer.compact()
    trainer.compact()
    assert rows(trainer.model()) == rows(want)


def test_each_batch_knows_its_id(spark, tmp_path):
    seen = []
    q = hunt.each_batch(source(spark, str(tmp_path / "in")), lambda df, k: seen.append((k, df.count())), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert seen == [(0, 3)]


SCANS = "scan_id string, ts timestamp, kind string, host_id string, line string, expected long"


def test_scans_are_told_when_they_end(spark, tmp_path):
    model = batch_markov.train(batch_markov.char_grams(lines(spark, *["ls -l /tmp"] * 9, "ls -a"), "line", 2, True, True))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", scans.PROVIDER)
    path, told, n = tmp_path / "in", [], 0

    def feed(*data):
        nonlocal n
        n += 1
        spark.createDataFrame([(s, f"2024-01-01 {at}", k, "h" + s, x, e) for s, at, k, x, e in data], SCANS.replace("ts timestamp", "ts string")).selectExpr("scan_id", "to_timestamp(ts) ts", "kind", "host_id", "line", "expected").coalesce(1).write.mode("append").parquet(str(path))
        q = scans.score_at_end(spark.readStream.schema(SCANS).parquet(str(path)), model, 2, 55, silence=600, forget=3600).writeStream.foreachBatch(lambda df, _: told.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    try:
        feed(("a", "00:00:00", "obs", "ls -l /tmp", None), ("a", "00:00:01", "obs", "XQZ#%!", None), ("b", "00:00:00", "obs", "ls -a", None), ("a", "00:00:02", "obs", None, None), ("c", "00:00:03", "obs", "QQQ", None), ("a", "00:00:03", "summary", None, 3), ("b", "00:00:04", "summary", None, 2))
        assert [t[:7] for t in told] == [("a", "ha", 2, 1, 3, "summary", True)] and [x[1] for x in json.loads(told[0][7])] == ["XQZ#%!"]
        feed(("a", "00:00:05", "summary", None, 3), ("a", "00:00:06", "obs", "ZZZ", None), ("b", "00:01:00", "obs", "late", None))  # again; what b still lacked
        assert [t[:7] for t in told[1:]] == [("b", "hb", 2, 1, 2, "summary", True)]
        feed(("d", "00:20:00", "obs", "ls -l /tmp", None))  # c has no summary
        feed(("d", "00:20:01", "summary", None, 9))
        assert [t[:7] for t in told[2:]] == [("c", "hc", 1, 1, None, "timeout", False)]
        feed(("e", "00:50:00", "obs", None, None))
        feed(("e", "00:50:01", "summary", None, 1))
        assert sorted(t[:7] for t in told[3:]) == [("d", "hd", 1, 0, 9, "summary", False), ("e", "he", 0, 0, 1, "summary", True)]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_a_model_too_large_for_a_worker_is_refused(spark):
    model = batch_markov.train(batch_markov.char_grams(lines(spark, "abcdef"), "line", 1, True, True))
    with pytest.raises(ValueError, match="transitions"):
        scans.LineScorer(model, 1, 95, most=3)
    batch = batch_markov.score(lines(spark, "abz"), batch_markov.char_grams(lines(spark, "abz"), "line", 1, True, False, "line"), model, "line").first()
    assert scans.LineScorer(model, 1, 95)("abz") == pytest.approx(batch.score)
