"""Inventory sources: CSV, JSON and JSON lines of processes and files, vendor field maps, shape rules, configuration files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.functions import scalars as S
from harrier.sources.observations import read_lines

PROCESS_SCHEMA = "machine_id string, pid bigint, ppid bigint, name string, uid bigint, path string, args string, timestamp string"
FILE_SCHEMA = "machine_id string, path string, uid bigint, timestamp string, mtime string, permissions string, owner string, `group` string, size bigint"

# Alias lists of vendors' field names, the first one that has a value counts
FIELD_MAPS = {
    "process": {"machine_id": ["machine_id", "host", "hostname", "hostIdentifier"], "pid": ["pid", "ProcessId"], "ppid": ["ppid", "parent", "ParentProcessId"], "name": ["name", "process_name", "Image"], "uid": ["uid", "user_id"], "path": ["path", "exe", "Image"], "args": ["args", "cmdline", "CommandLine"], "timestamp": ["timestamp", "time", "UtcTime"]},
    "file": {"machine_id": ["machine_id", "host", "hostname", "hostIdentifier"], "path": ["path", "file_path", "target_path"], "uid": ["uid", "user_id"], "timestamp": ["timestamp", "time"], "mtime": ["mtime", "date"], "permissions": ["permissions", "mode"], "owner": ["owner", "user"], "group": ["group"], "size": ["size"]},
}


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of a CSV with a header; columns by name, what doesn't parse is null, rows without a machine go."""
    schema = PROCESS_SCHEMA if kind == "process" else FILE_SCHEMA
    raw = spark.read.csv(path, header=True)
    wanted = spark.createDataFrame([], schema).schema.fields
    cast = lambda f: (F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name)
    return raw.select(*map(cast, wanted)).where(F.coalesce("machine_id", F.lit("")) != "")


def mapped(line: Column, fields: dict[str, list[str]]) -> dict[str, Column]:
    """A Column for each logical field of a JSON text: the first alias with a value that isn't empty."""
    return {k: F.coalesce(*(F.nullif(F.get_json_object(line, f"$.{a}"), F.lit("")) for a in names)) for k, names in fields.items()}


def shape(line: Column) -> Column:
    """process, file or socket, by the keys that a JSON object has."""
    keys = F.json_object_keys(line)
    any_key = lambda *names: F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, names))), F.lit(False))
    event = F.lower(F.coalesce(F.get_json_object(line, "$.event_type"), F.lit("")))
    return (
        F.when(keys.isNull(), None)
        .when(any_key("remote_ip", "remote_address"), "socket")
        .when(any_key("cmdline", "args", "CommandLine"), "process")
        .when(any_key("pid", "ppid", "parent"), "process")
        .when(event.contains("process"), "process")
        .when(event.contains("file"), "file")
        .when(any_key("file_path", "target_path"), "file")
        .when(any_key("path") & any_key("mtime", "mode", "permissions", "size", "owner"), "file")
        .otherwise("process")
    )


def sniff(lines: DataFrame, most: int = 2000) -> str:
    """process, file or mixed, from a bounded number of lines."""
    kinds = {r[0] for r in lines.limit(most).select(shape(F.col("line"))).distinct().collect()} - {None}
    return kinds.pop() if len(kinds) == 1 else "mixed"


def read_json_lines(spark: SparkSession, path: str, kind: str, machine: str | None = None) -> DataFrame:
    """Rows of the kind among JSON lines; a missing machine is the given one or the file's stem."""
    return rows_of(read_lines(spark, path), kind, machine)


def rows_of(lines: DataFrame, kind: str, machine: str | None = None) -> DataFrame:
    fields = mapped(F.col("line"), FIELD_MAPS[kind])
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1) if "file" in lines.columns else F.lit(None).cast("string")
    fields["machine_id"] = F.coalesce(fields["machine_id"], F.lit(machine).cast("string"), stem)
    numbers = {"pid", "ppid", "uid", "size"}
    picked = lines.where(shape(F.col("line")) == kind)
    return picked.select(*(c.try_cast("bigint").alias(k) if k in numbers else c.alias(k) for k, c in fields.items())).where("machine_id IS NOT NULL")


def read_json(spark: SparkSession, path: str, kind: str, machine: str | None = None) -> DataFrame:
    """The same from files that hold one JSON array each."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.explode(F.from_json("value", "array<string>")).alias("line"))
    return rows_of(whole, kind, machine)


def host_of_path(file: Column, rule: str = "whole", delimiter: str = "_", n: int = 0, pattern: str = "") -> Column:
    """Host from the folder that holds a file: its whole name, its n-th segment, or a pattern's first group."""
    folder = F.regexp_extract(file, r"([^/]+)/[^/]+$", 1)
    if rule == "segment":
        return F.coalesce(F.get(F.split(folder, F.lit("\\Q" + delimiter + "\\E")), F.lit(n)), folder)
    return F.regexp_extract(folder, pattern, 1) if rule == "pattern" else folder


def day_of_path(file: Column) -> Column:
    """The ISO day among a path's folders, if any."""
    return F.to_date(F.nullif(F.regexp_extract(file, r"/(\d{4}-\d\d-\d\d)/", 1), F.lit("")))


def strip_command(cmdline: Column, path: Column) -> Column:
    """Arguments of a command line that repeats its path."""
    return F.when(cmdline.startswith(path), F.ltrim(F.substring(cmdline, F.length(path) + 1, F.length(cmdline)))).otherwise(cmdline)


def training_lines(spark: SparkSession, path: str, kind: str, line: str = "line", where: tuple[str, str] | None = None, count: str | None = None) -> DataFrame:
    """(line, n) for Markov training from text, CSV or JSON lines, filtered by field == value, weighted by a count column."""
    if kind == "text":
        return spark.read.text(path).select(F.col("value").alias("line"), F.lit(1).cast("bigint").alias("n"))
    if kind == "csv":
        df = spark.read.csv(path, header=True)
        get = F.col
    else:
        df = spark.read.text(path)
        get = lambda name: F.get_json_object("value", f"$.{name}")
    df = df.where(get(where[0]) == where[1]) if where else df
    n = F.coalesce(get(count).try_cast("bigint"), F.lit(1)) if count else F.lit(1)
    return df.select(get(line).alias("line"), n.cast("bigint").alias("n")).where("line IS NOT NULL")


# -- configuration files, one line a row


def passwd(lines: DataFrame) -> DataFrame:
    p = F.split("line", ":")
    at = lambda k: F.get(p, F.lit(k))
    return lines.where(F.size(p) >= 7).select(at(0).alias("username"), at(2).try_cast("bigint").alias("uid"), at(3).try_cast("bigint").alias("gid"), at(4).alias("gecos"), at(5).alias("home"), at(6).alias("shell"))


def shadow(lines: DataFrame) -> DataFrame:
    p = F.split("line", ":")
    hashed = F.get(p, F.lit(1))
    locked = hashed.startswith("!") | hashed.startswith("*")
    return lines.where(F.size(p) >= 2).select(F.get(p, F.lit(0)).alias("username"), S.shadow_algorithm(hashed).alias("algorithm"), (hashed == "").alias("empty_password"), locked.alias("locked"), F.when(~locked & (hashed != ""), F.sha2(hashed, 256)).alias("hash_fingerprint"))


def authorized_keys(lines: DataFrame) -> DataFrame:
    """options, key_type, fingerprint (SHA-256 of the blob), comment and, for RSA, bits from the modulus's length."""
    m = lambda g: F.regexp_extract("line", r"^(?:(.*?)\s+)?(ssh-(?:rsa|dss|ed25519)|ecdsa-sha2-\S+|sk-\S+)\s+([A-Za-z0-9+/=]+)(?:\s+(.*))?$", g)
    blob = F.unbase64(m(3))
    # an RSA blob: name, exponent, modulus, each after its length; the modulus has a leading zero byte
    name_len = F.conv(F.hex(F.substring(blob, 1, 4)), 16, 10).cast("int")
    exp_len = F.conv(F.hex(F.substring(blob, name_len + 5, F.lit(4))), 16, 10).cast("int")
    mod_len = F.conv(F.hex(F.substring(blob, name_len + exp_len + 9, F.lit(4))), 16, 10).cast("int")
    bits = F.when(m(2) == "ssh-rsa", F.floor((mod_len - 1) / 8) * 64)
    return lines.where(m(2) != "").select(F.filter(F.split(m(1), ","), lambda x: x != "").alias("options"), m(2).alias("key_type"), F.sha2(blob, 256).alias("fingerprint"), m(4).alias("comment"), bits.cast("int").alias("bits"))


def package_sums(lines: DataFrame) -> DataFrame:
    m = lambda g: F.regexp_extract("line", r"^([0-9a-f]{32})\s+(\S.*)$", g)
    return lines.where(m(1) != "").select(F.concat(F.lit("/"), m(2)).alias("path"), m(1).alias("md5"))
