from conftest import rows
from pyspark.sql import functions as F

from harrier.functions import bytes as B
from harrier.functions import scalars as S


def one(spark, c, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(c).first()[0]


def test_entropy(spark):
    assert one(spark, S.text_entropy(F.col("a")), a="") == 0.0
    assert abs(one(spark, S.text_entropy(F.col("a")), a="ab/ab") - 1.0) < 1e-12
    assert B.entropy(b"x" * 1024) == 0 and B.entropy(bytes(range(256))) == 8
    assert B.window_entropy(b"\0" * 50 + bytes(range(32)) + b"\0" * 50, 32) == (5.0, 50)


def test_paths_and_modes(spark):
    assert one(spark, S.suspicious_path(F.col("a")), a="/usr/bin/.x") and not one(spark, S.suspicious_path(F.col("a")), a="/usr/bin/x")
    assert one(spark, F.col("a").rlike(S.glob_regex("/var/log/*.log", "/tmp/a?")), a="/tmp/a1") and not one(spark, F.col("a").rlike(S.glob_regex("/tmp/a?")), a="/tmp/b")
    assert one(spark, S.world_writable(F.col("a")), a="-rw-rw-rw-") and one(spark, S.world_writable(F.col("a")), a="0777") and not one(spark, S.world_writable(F.col("a")), a="-rw-rw-r--")
    assert one(spark, S.octal_mode(F.col("a")), a="-rwsr-x--T") == "5750"
    assert one(spark, S.path_tokens(F.col("a")), a="/usr/bin/curl") == ["/", "usr", "/", "bin", "/", "curl"]


def test_names_and_text(spark):
    assert [one(spark, S.kernel_thread(F.col("a")), a=x) for x in ("[nvme-wq]", "  [kthreadd]  ", "[not closed", "a [b] c")] == [True, True, False, False]
    assert one(spark, S.placeholders(F.col("a")), a="my_S-1-0-0") == "my_<SID>"
    assert tuple(one(spark, S.split_command(F.col("a")), a='"/opt/my app/run" -x "a b"')) == ("run", "/opt/my app/run", "-x a b")
    assert one(spark, S.title("{{a}} and {{b}}", {"a": F.col("a")}), a="x") == "x and null"
    assert [one(spark, S.severity_of_distance(F.col("a")), a=x) for x in (1.0, 0.7, 0.45, 0.2)] == ["critical", "high", "medium", "low"]


def test_times(spark):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    texts = ["2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "1704164645", "1704164645000", "no time"]
    got = [str(one(spark, S.event_time(F.col("a"), now), a=x)) for x in texts]
    assert got == ["2024-01-02 03:04:05"] * 4 + ["2024-06-01 00:00:00"]


def test_recent_changes(spark):
    df = spark.createDataFrame([("/etc/shadow", 11, 5), ("/etc/shadow", 13, 5), ("/etc/hosts", 5, 0), ("/etc/hosts", 5, 7), ("/var/log/x", 1, 0), ("/home/a/.x", 2, 9)], "path string, hours int, uid int")
    access = F.lit("2024-06-01 00:00:00").cast("timestamp")
    c = S.recently_modified(F.col("path"), access, F.timestamp_seconds(F.unix_seconds(access) - F.col("hours") * 3600), F.col("uid"), S.suspicious_path(F.col("path")), F.lit(False), F.lit(False))
    assert [r[3] for r in rows(df.select("*", c.alias("r")), "path", "hours", "uid")] == [True, False, True, False, True, False]
