import hashlib

from conftest import rows
from pyspark.sql import functions as F

from harrier.functions import bytes as B
from harrier.operators import sketches
from harrier.sources import procfs


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "line string")


TCP = """  sl  local_address rem_address   st tx_queue rx_queue tr tm->when retrnsmt   uid  timeout inode
   0: 0100007F:1F90 00000000:0000 0A 00000000:00000000 00:00000000 00000000  1000        0 4711 1 0
   1: 0F02000A:C350 08080808:01BB 01 00000000:00000000 00:00000000 00000000     x        0 4712 1 0
   2: 0F02000A:C351 08080808:01BB 06 00000000:00000000 00:00000000 00000000     0        0 0 1 0
short""".split("\n")


def test_sockets(spark):
    got = rows(procfs.net_sockets(lines(spark, *TCP), "tcp", "ipv4"))
    assert got == [("4711", "ipv4", "tcp", "LISTEN", "127.0.0.1", 8080, "0.0.0.0", 0, 1000), ("4712", "ipv4", "tcp", "ESTABLISHED", "10.0.2.15", 50000, "8.8.8.8", 443, 0)]
    assert [r.state for r in procfs.net_sockets(lines(spark, *TCP), "udp", "ipv4").orderBy("inode").collect()] == ["UDP", "ESTABLISHED"]
    six = spark.createDataFrame([(h,) for h in ("0" * 32, "0000000000000000FFFF0000" + "0100007F", "B80D01200000000000000000" + "01000000", "xyz")], "h string")
    assert [r[0] for r in six.select(procfs.ipv6(F.col("h"))).collect()] == ["::", "::ffff:127.0.0.1", "2001:db8:0:0:0:0:0:1", "xyz"]


def test_modules_and_maps(spark):
    got = rows(procfs.modules(lines(spark, "ext4 737280 2 jbd2,mbcache, Live 0xffffffffc0a00000", "x 1 0 - Live 0x0", "")))
    assert got == [("ext4", 737280, 2, ["jbd2", "mbcache"], 0xFFFFFFFFC0A00000), ("x", 1, 0, [], 0)]
    text = ["7f00-7f10 r-xp 00000000 08:01 7 /lib/a b.so", "7f08-7f20 rwxp 00000000 00:00 0 ", "7f20-7f30 r-xp 0 00:00 0 /x (deleted)", "7f30-7f40 rw-p 0 00:00 0 [heap]", "ffffffffff600000-ffffffffff601000 --xp 0 00:00 0 [vsyscall]", "nonsense"]
    maps = procfs.memory_maps(lines(spark, *text).withColumn("pid", F.lit(1)), "pid")
    assert [(r.path, r.rwx, r.unbacked, r.overlaps) for r in procfs.overlapping(maps, "pid").orderBy("start").collect()] == [("/lib/a b.so", False, False, False), ("", True, True, True), ("/x (deleted)", False, True, False), ("[heap]", False, False, False), ("[vsyscall]", False, False, False)]
    assert rows(procfs.map_flags(maps, "pid")) == [(1, 1, 2)]
    r = spark.createDataFrame([(0, 4, 4, 8), (0, 5, 4, 8), (4, 8, 0, 5), (1, 1, 0, 9), (None, 5, 4, 8)], "a long, b long, c long, d long")
    assert [x[0] for x in r.select(procfs.overlap(*map(F.col, "abcd"))).collect()] == [False, True, True, False, False]


# published values: bytes 0, 1, ... 250, 0, 1, ...
BLAKE3 = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
    102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
}


def test_blake3(spark):
    data = {n: bytes(i % 251 for i in range(n)) for n in BLAKE3}
    assert dict(zip(data, B.blake3_many(list(data.values())))) == BLAKE3
    assert dict(zip(data, B.blake3_many(list(data.values()), most=3))) == BLAKE3  # few chunks at a time
    more = [hashlib.sha256(bytes([k])).digest() * k for k in range(130)]
    assert B.blake3_many(more) == [B.blake3_many([m])[0] for m in more] and len(set(B.blake3_many(more))) == 130
    assert B.blake3_many([]) == []
    df = spark.createDataFrame([(n, bytearray(d)) for n, d in data.items()] + [(-1, None)], "n long, content binary")
    assert dict(rows(df.select("n", B.blake3("content")))) == BLAKE3 | {-1: None}


def test_sketches(spark):
    df = spark.range(20_000).selectExpr("id", "timestamp_seconds(86400 * (id % 4)) ts", "id % 7000 u", "if(id % 2 = 0, 'a', 'b') k", "if(id % 10 = 0, null, id) v")
    days = sketches.daily(df, "ts", ("k",), ("u",), ("v",))
    assert days.count() == 4
    one = sketches.over(days, ()).first()
    assert one.n == 20_000 and abs(one.distinct_u - 7000) < 400 and abs(one.median_v - 10_000) < 1000
    part = {r.k: r for r in sketches.over(days, ("k",), "1970-01-02", "1970-01-03").collect()}
    assert {k: r.n for k, r in part.items()} == {"a": 5000, "b": 5000} and sketches.over(days.limit(0), ("k",)).count() == 0
