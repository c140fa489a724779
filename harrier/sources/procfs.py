"""Lines of the kernel's process file system as rows: sockets, modules, memory maps. All of it is column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Socket states by their number
TCP_STATES = ("ESTABLISHED", "SYN_SENT", "SYN_RECV", "FIN_WAIT1", "FIN_WAIT2", "TIME_WAIT", "CLOSE", "CLOSE_WAIT", "LAST_ACK", "LISTEN", "CLOSING")
UDP_STATES = {1: "ESTABLISHED", 7: "UNCONN"}
HEX = r"^[0-9A-Fa-f]+$"


def number(hexadecimal: Column) -> Column:
    """A hexadecimal text of up to 16 digits as a decimal; null for anything else."""
    fits = hexadecimal.rlike(HEX) & (F.length(hexadecimal) <= 16)
    return F.when(fits, F.conv(hexadecimal, 16, 10).cast("decimal(20,0)"))


def _byte(hexadecimal: Column, k: int) -> Column:
    return F.conv(F.substring(hexadecimal, 2 * k + 1, 2), 16, 10)


def ipv4(h: Column) -> Column:
    """Dotted address of eight digits, the least byte first; other texts stay as they are."""
    return F.when((F.length(h) == 8) & h.rlike(HEX), F.concat_ws(".", *(_byte(h, k) for k in (3, 2, 1, 0)))).otherwise(h)


def ipv6(h: Column) -> Column:
    """Address of 32 digits in four words, each with its least byte first: eight groups, :: if all are zero, mapped IPv4 addresses dotted."""
    pair = lambda k: F.substring(h, 2 * k + 1, 2)
    at = [4 * w + b for w in range(4) for b in (3, 2, 1, 0)]  # places of the address's bytes, in its order
    plain = F.concat_ws(":", *(F.lower(F.regexp_replace(F.concat(pair(at[2 * g]), pair(at[2 * g + 1])), "^0{1,3}", "")) for g in range(8)))
    mapped = F.concat(F.lit("::ffff:"), F.concat_ws(".", *(_byte(h, at[k]) for k in range(12, 16))))
    known = F.when(h.rlike("^0{32}$"), "::").when(h.rlike("^(?i)0{16}FFFF0000"), mapped).otherwise(plain)
    return F.when((F.length(h) == 32) & h.rlike(HEX), known).otherwise(h)


def net_sockets(lines: DataFrame, protocol: str, family: str, *keep: str) -> DataFrame:
    """Sockets of net/tcp, udp and their IPv6 kin (column line): inode, family, protocol, state, local and remote address and port, uid. The header and sockets without an inode are left out."""
    p = F.split(F.trim("line"), r"\s+")
    at = lambda k: F.get(p, F.lit(k))
    address = ipv4 if family == "ipv4" else ipv6
    ip = lambda k: address(F.substring_index(at(k), ":", 1))
    port = lambda k: F.coalesce(number(F.substring_index(at(k), ":", -1)), F.lit(0)).cast("int")
    n = F.coalesce(number(at(3)), F.lit(0)).cast("int")
    if protocol == "udp":
        state = F.coalesce(*(F.when(n == k, F.lit(name)) for k, name in UDP_STATES.items()), F.lit("UDP"))
    else:
        state = F.coalesce(F.get(F.array(*map(F.lit, TCP_STATES)), n - 1), F.lit("UNKNOWN"))
    rows = lines.where(at(1).rlike("^[0-9A-Fa-f]+:[0-9A-Fa-f]+$") & at(2).isNotNull() & (F.coalesce(at(9), F.lit("0")) != "0"))
    return rows.select(*keep, at(9).alias("inode"), F.lit(family).alias("family"), F.lit(protocol).alias("protocol"), state.alias("state"), ip(1).alias("local_ip"), port(1).alias("local_port"), ip(2).alias("remote_ip"), port(2).alias("remote_port"), F.coalesce(at(7).try_cast("bigint"), F.lit(0)).alias("uid"))


def modules(lines: DataFrame, *keep: str) -> DataFrame:
    """name, size, refcount, used_by and address of loaded modules."""
    p = F.split(F.trim("line"), r"\s+")
    at = lambda k: F.get(p, F.lit(k))
    used = F.filter(F.split(F.coalesce(at(3), F.lit("")), ","), lambda x: (x != "") & (x != "-"))
    return lines.where(F.trim("line") != "").select(*keep, at(0).alias("name"), at(1).try_cast("bigint").alias("size"), at(2).try_cast("int").alias("refcount"), used.alias("used_by"), number(F.regexp_replace(at(5), "^0x", "")).alias("address"))


def memory_maps(lines: DataFrame, *keep: str) -> DataFrame:
    """start and end (decimals, end excluded), perms, offset, inode, path (empty for anonymous memory), rwx, and unbacked: executable without a file, or with one that is deleted."""
    m = lambda g: F.regexp_extract("line", r"^([0-9a-f]+)-([0-9a-f]+)\s+(\S{4})\s+([0-9a-f]+)\s+\S+\s+(\d+)\s*(.*)$", g)
    path, perms = F.rtrim(m(6)), m(3)
    bare = (path == "") | (path == "[anon]") | path.startswith("[anon:") | path.contains("(deleted)")
    return lines.where(m(1) != "").select(*keep, number(m(1)).alias("start"), number(m(2)).alias("end"), perms.alias("perms"), number(m(4)).alias("offset"), m(5).cast("bigint").alias("inode"), path.alias("path"), perms.startswith("rwx").alias("rwx"), ((F.substring(perms, 3, 1) == "x") & bare).alias("unbacked"))


def overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether two address ranges, ends excluded, share an address."""
    return F.coalesce((start < other_end) & (other_start < end) & (start < end) & (other_start < other_end), F.lit(False))


def overlapping(maps: DataFrame, *process: str) -> DataFrame:
    """maps and ``overlaps``: whether an earlier range of the same process ends after this one starts. A map is sorted and has none; that of a process that was tampered with may."""
    from pyspark.sql import Window

    w = Window.partitionBy(*process).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return maps.withColumn("overlaps", F.coalesce(F.max("end").over(w) > F.col("start"), F.lit(False)))


def map_flags(maps: DataFrame, *process: str) -> DataFrame:
    """(process, rwx_maps, unbacked_exec) as processes are observed."""
    return maps.groupBy(*process).agg(F.count_if("rwx").alias("rwx_maps"), F.count_if("unbacked").alias("unbacked_exec"))
