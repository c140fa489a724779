"""Typed observations: one schema for each kind, read from NDJSON with no inference."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 256 * 1024

PATH = "struct<s:string,b:string>"
# The fields of each kind as collected; path fields come as text or base64
SCHEMAS = {
    "process": f"pid int, ppid int, comm string, exe {PATH}, exe_deleted boolean, exe_memfd boolean, cmdline array<{PATH}>, cwd {PATH}, uids array<bigint>, gids array<bigint>, username string, starttime bigint, tty int, state string, caps_eff bigint, unbacked_exec bigint, listen_ports array<int>, environ_flags array<string>",
    "hidden_process": "pid int, sources_present array<string>, sources_absent array<string>, comm string, exe string, uid bigint, starttime bigint, cgroup string, passes_confirmed int, confidence string",
    "socket": "inode string, family string, protocol string, state string, local_ip string, local_port int, remote_ip string, remote_port int, uid bigint, owning_pid int, owning_comm string, owner_unresolved boolean",
    "hidden_socket": "inode string, local_port int, protocol string, sources_present array<string>, sources_absent array<string>, confidence string",
    "module": "name string, size bigint, refcount int, used_by array<string>, in_sysfs boolean, in_proc_modules boolean, taint_flags string",
    "bpf_prog": "id bigint, prog_type string, name string, tag string, orphan boolean",
    "file_meta": f"path {PATH}, mode bigint, uid bigint, gid bigint, size string, inode string, nlink bigint, setuid boolean, setgid boolean, immutable boolean, owner string, `group` string",
    "file_entropy": f"path {PATH}, entropy double, window_max double, window_offset bigint, size string, is_elf boolean, sha256 string",
    "elf_info": f"path {PATH}, machine string, is_static boolean, stripped boolean, interp string, section_count int, has_rwx_segment boolean, packer_hints array<string>, entry string",
    "preload": f"path {PATH}, entries array<{PATH}>, present boolean",
    "scheduled_task": f"kind string, path {PATH}, user string, schedule string, command string",
    "service": f"name string, path {PATH}, exec_start string, unit_type string",
    "account": "username string, uid bigint, gid bigint, home string, shell string, gecos string",
    "shadow_entry": "username string, algorithm string, empty_password boolean, locked boolean, hash_fingerprint string",
    "sudo_rule": f"path {PATH}, line string, nopasswd boolean, all_commands boolean",
    "authorized_key": f"path {PATH}, username string, key_type string, fingerprint string, comment string, options array<string>, bits int",
    "ssh_host_key": f"path {PATH}, key_type string, fingerprint string, changed boolean",
    "dir_anomaly": f"path {PATH}, anomaly string, detail string, confidence string",
    "timestomp": f"path {PATH}, btime bigint, mtime bigint, ctime bigint",
    "mount": f"device string, mountpoint {PATH}, fstype string, options string",
    "log_integrity": f"path {PATH}, issue string, detail string",
    "utmp_session": "user string, line string, host string, pid int, typ int, time bigint",
    "integrity_mismatch": f"path {PATH}, expected_hash string, actual_hash string, package string",
    "ioc_hit": f"path {PATH}, ioc_kind string, ioc_value string, severity string",
    "container_info": "in_container boolean, runtime string, privileged boolean, docker_sock_mounted boolean, host_pid_ns boolean",
    "recon": "category string, data map<string,string>",
    "policy": "code string, detail string, severity string",
}


def flat_path(c) -> "F.Column":
    """Text of a path that came as text or as base64."""
    return F.coalesce(c["s"], F.decode(F.unbase64(c["b"]), "UTF-8"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file): lines of bounded length; blank ones and comments are skipped."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    text = F.trim("line")
    return lines.where((F.octet_length("line") <= MOST_BYTES) & (text != "") & ~text.startswith("#") & ~text.startswith("//"))


def of_kind(lines: DataFrame, kind: str, *keep: str) -> DataFrame:
    """The observations of one kind among NDJSON lines, paths flattened; broken lines are no observations. A hidden module counts as a module."""
    wanted = ["module", "hidden_module"] if kind == "module" else [kind]
    parsed = lines.where(F.get_json_object("line", "$.t").isin(wanted)).select(*keep, F.from_json("line", SCHEMAS[kind]).alias("o")).where("o IS NOT NULL")
    return parsed.select(*keep, *(_flat(F.col("o")[f.name], f) for f in parsed.schema["o"].dataType.fields))


HIDDEN_MODULE = "hidden_module"
KINDS = (*SCHEMAS, HIDDEN_MODULE)


def parsed(lines: DataFrame, *keep: str) -> DataFrame:
    """(keep, line, kind, one struct column for each kind): all observations of NDJSON lines, each line parsed once.

    A row has the struct of its kind, with the fields that rules derive; the others are null. A hidden module
    has the struct ``module``. Broken lines, lines that are no objects and unknown kinds are no observations.
    """
    from harrier.operators.rules import derived_fields, fields_of

    read = lines.select(*keep, "line", F.try_parse_json("line").alias("_v")).withColumn("kind", F.try_variant_get("_v", "$.t", "string")).where(F.col("kind").isin(*KINDS))
    raw = {k: F.when(F.col("kind").isin(*([k, HIDDEN_MODULE] if k == "module" else [k])), F.try_variant_get("_v", "$", f"struct<{_colons(s)}>")).alias(k) for k, s in SCHEMAS.items()}
    read = read.select(*keep, "line", "kind", *raw.values())
    whole = {}
    for k in SCHEMAS:
        with fields_of(k):
            more = derived_fields(k)
        own = [_flat(F.col(k)[f.name], f) for f in read.schema[k].dataType.fields if f.name not in more]
        whole[k] = F.when(F.col(k).isNotNull(), F.struct(*own, *(c.alias(n) for n, c in more.items()))).alias(k)
    return read.select(*keep, "line", "kind", *whole.values())


def _colons(schema: str) -> str:
    """Fields of a table as those of a struct type."""
    return re.sub(r"(^|, )(`?\w+`?) ", r"\1\2: ", schema)


def _flat(c: Column, f) -> Column:
    is_path = lambda t: t.typeName() == "struct" and t.fieldNames() == ["s", "b"]
    if is_path(f.dataType):
        return flat_path(c).alias(f.name)
    if f.dataType.typeName() == "array" and is_path(f.dataType.elementType):
        return F.transform(c, flat_path).alias(f.name)
    return c.alias(f.name)


# -- observations as events and as inventory rows


def _quoted(names: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(names, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("")), F.lit("]"))


def _maybe(c: Column, quote: str = "") -> Column:
    return F.when(c.isNull(), "None").otherwise(F.concat(F.lit(f"Some({quote}"), c.cast("string"), F.lit(f"{quote})")))


def _event_fields(kind: str) -> dict[str, Column]:
    """The columns of the hunting table that an observation of the kind fills; texts may be null."""
    o = lambda name: F.col(f"{kind}.{name}")
    t = lambda name: F.coalesce(o(name).cast("string"), F.lit(""))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    pid = lambda name: F.greatest(F.coalesce(o(name).cast("long"), F.lit(0)), F.lit(0))
    if kind == "process":
        parts = F.filter(o("cmdline"), lambda x: x != "")
        full, exe = F.coalesce(F.array_join(parts, " "), F.lit("")), t("exe")
        rest = F.array_join(F.filter(F.slice(o("cmdline"), F.lit(2), F.greatest(F.size(o("cmdline")), F.lit(1))), lambda x: x != ""), " ")
        args = F.when(full == "", "").when(F.size(o("cmdline")) > 1, rest).when((exe != "") & full.startswith(exe), F.ltrim(F.substring(full, F.length(exe) + 1, F.length(full)))).otherwise("")
        shown = say("process pid=", o("pid"), " comm=", o("comm"), " exe=", F.when(exe == "", "\u2014").otherwise(exe))
        high = F.coalesce(o("exe_memfd"), F.lit(False)) | F.coalesce(o("exe_deleted"), F.lit(False))
        return {"process_name": t("comm"), "process_id": pid("pid"), "user": F.coalesce(F.get(o("uids"), F.lit(0)), F.lit(0)).cast("string"), "path": exe, "args": args, "cmdline": F.when(full == "", exe).otherwise(full), "exe_memfd": F.coalesce(o("exe_memfd").cast("int"), F.lit(0)), "severity": F.when(high, "high").otherwise("info"), "message": F.when(args == "", shown).otherwise(say(shown, " args=", args))}
    if kind == "hidden_process":
        return {"process_name": t("comm"), "process_id": pid("pid"), "user": t("uid"), "path": t("exe"), "severity": F.lit("critical"), "message": say("hidden process pid=", o("pid"), " sources_absent=", _quoted(o("sources_absent")))}
    if kind == "socket":
        src, dest = say(o("local_ip"), ":", o("local_port")), say(o("remote_ip"), ":", o("remote_port"))
        return {"process_id": pid("owning_pid"), "user": t("uid"), "src_ip": src, "dest_ip": dest, "message": say(o("protocol"), " ", o("state"), " ", src, " \u2192 ", dest, " (pid=", _maybe(o("owning_pid")), ")")}
    if kind == "hidden_socket":
        return {"src_ip": say("*:", o("local_port")), "severity": F.lit("high"), "message": say("hidden socket ", o("protocol"), ":", o("local_port"), " absent=", _quoted(o("sources_absent")))}
    if kind == "module":
        return {"process_name": t("name"), "severity": F.when(F.col("kind") == HIDDEN_MODULE, "critical").otherwise("info"), "message": say("module ", o("name"), " size=", _maybe(o("size")))}
    if kind == "bpf_prog":
        return {"process_name": t("name"), "severity": F.when(o("orphan"), "high").otherwise("info"), "message": say("bpf prog id=", o("id"), " type=", o("prog_type"))}
    path, user, at = {"path": t("path")}, {"user": t("username")}, t("path")
    high = {"severity": F.lit("high")}
    if kind == "ioc_hit":
        return path | {"severity": F.lower(t("severity")), "message": say("ioc ", o("ioc_kind"), "=", o("ioc_value"))}
    if kind == "policy":
        return {"check_id": t("code"), "severity": F.lower(t("severity")), "message": say("policy ", o("code"), ": ", o("detail"))}
    return {
        "file_meta": lambda: path | {"user": t("uid"), "message": say("file_meta ", at)},
        "file_entropy": lambda: path | high | {"file_hash": t("sha256"), "message": say("entropy=", F.format_string("%.2f", o("entropy")), " ", at)},
        "elf_info": lambda: path | {"message": say("elf ", at, " static=", o("is_static"))},
        "preload": lambda: path | high | {"message": say("preload ", at)},
        "scheduled_task": lambda: path | {"user": t("user"), "message": say("scheduled ", o("kind"), " ", at)},
        "service": lambda: path | {"process_name": t("name"), "message": say("service ", o("name"), " ", o("unit_type"))},
        "account": lambda: user | {"path": t("shell"), "message": say("account uid=", o("uid"), " ", o("username"))},
        "shadow_entry": lambda: user | {"severity": F.lit("medium"), "message": say("shadow ", o("username"))},
        "sudo_rule": lambda: path | {"message": say("sudo ", o("line"))},
        "authorized_key": lambda: path | user | {"process_name": F.lit("sshd"), "severity": F.lit("medium"), "message": say("authorized_key ", o("username"), " ", o("fingerprint"))},
        "ssh_host_key": lambda: path | {"message": say("ssh_host_key ", o("key_type"))},
        "dir_anomaly": lambda: path | high | {"message": say("dir_anomaly ", o("anomaly"), ": ", o("detail"))},
        "timestomp": lambda: path | high | {"message": say("timestomp ", at)},
        "mount": lambda: {"path": t("mountpoint"), "message": say("mount ", o("device"), " ", o("mountpoint"), " ", o("fstype"))},
        "log_integrity": lambda: path | high | {"message": say("log_integrity ", o("issue"), ": ", o("detail"))},
        "utmp_session": lambda: {"user": t("user"), "process_id": pid("pid"), "src_ip": t("host"), "message": say("session ", o("user"), "@", o("line"), " pid=", o("pid"))},
        "integrity_mismatch": lambda: path | {"file_hash": t("actual_hash"), "severity": F.lit("critical"), "message": say("integrity mismatch ", at)},
        "container_info": lambda: {"message": say("container in=", o("in_container"), " runtime=", _maybe(o("runtime"), '"'), " privileged=", o("privileged"))},
        "recon": lambda: {"message": say("recon ", o("category"))},
    }[kind]()


_EMPTY = {"process_name": "", "process_id": 0, "user": "", "path": "", "args": "", "cmdline": "", "src_ip": "", "dest_ip": "", "file_hash": "", "severity": "info", "exe_memfd": 0, "check_id": "", "message": ""}


def observation_events(rows: DataFrame, timestamp: Column, host_id: Column, host_name: Column, scan_id: Column, collector: Column, source_type: str = "probe", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, the 24 columns of the hunting table) for observations of all kinds (``parsed``), in one pass; ``ext`` is the line as it came."""
    fields = {k: _event_fields(k) for k in SCHEMAS}

    def column(name: str, default) -> Column:
        cases = [F.when(F.col(k).isNotNull(), F.coalesce(own[name], F.lit(default))) for k, own in fields.items() if name in own]
        return F.coalesce(*cases, F.lit(default)).cast({"process_id": "long", "exe_memfd": "int"}.get(name, "string")).alias(name)

    told = {n: column(n, d) for n, d in _EMPTY.items()}
    text = lambda v, n: F.lit(v).alias(n)
    return rows.select(
        *keep, timestamp.cast("timestamp").alias("timestamp"), told["message"], text(source_type, "source_type"), text("scan", "source"), text("linux", "platform"), host_id.cast("string").alias("host_id"), host_name.alias("host_name"),
        scan_id.cast("string").alias("scan_id"), collector.alias("collector"), "kind", told["check_id"], F.col("kind").alias("data_type"), *(told[n] for n in ("process_name", "process_id", "user", "path", "args", "cmdline", "src_ip", "dest_ip", "file_hash", "severity", "exe_memfd")),
        F.col("line").alias("ext"),
    )


def as_events(obs: DataFrame, kind: str, host: str = "host_id") -> DataFrame:
    """(host_id, kind, severity, process_name, path, message) of one kind, whose fields are columns (``of_kind``)."""
    rows = obs.select(host, F.lit(kind).alias("kind"), F.lit("").alias("line"), F.struct(*(c for c in obs.columns if c != host)).alias(kind))
    own = {k: F.coalesce(_event_fields(kind)[k], F.lit(d)).alias(k) if k in _event_fields(kind) else F.lit(d).alias(k) for k, d in _EMPTY.items()}
    return rows.select(F.col(host).alias("host_id"), "kind", own["severity"], own["process_name"], own["path"], own["message"])


def inventory_events(rows: DataFrame, kind: str, now: Column | None = None, source: str = "inventory", days: int = 90) -> DataFrame:
    """Events of inventory rows, for the hunting table; kind is process or file_meta.

    A process's command line is its path, or its name without one, and its
    arguments. Times that are missing, unreadable or older than the table's
    retention become ``now``; files without a timestamp go by their mtime.
    ``ext`` is the whole row as JSON.
    """
    if kind not in ("process", "file_meta"):
        raise ValueError(f"inventories have processes and files, not {kind}")
    now = F.current_timestamp() if now is None else now
    have = set(rows.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    stamps = [F.col(c).try_cast("timestamp") for c in (("timestamp",) if kind == "process" else ("timestamp", "mtime")) if c in have]
    stamp = F.coalesce(*stamps, F.lit(None).cast("timestamp"))
    ts = F.when(stamp >= now - F.make_dt_interval(F.lit(days)), stamp).otherwise(now)
    name, path, args = text("name"), text("path"), F.trim(text("args"))
    tail = lambda lead: F.when(args == "", "").otherwise(F.concat(F.lit(lead), args))
    if kind == "process":
        message = F.concat(F.lit("process pid="), text("pid"), F.lit(" comm="), name, F.lit(" exe="), F.when(path == "", "\u2014").otherwise(path), tail(" args="))
        cmdline = F.concat(F.when(path == "", name).otherwise(path), tail(" "))
    else:
        message, cmdline, name, args = F.concat(F.lit("file_meta "), path), F.lit(""), F.lit(""), F.lit("")
    number = F.coalesce(F.col("pid").cast("long"), F.lit(0)) if kind == "process" else F.lit(0).cast("long")
    return rows.select(
        F.col("machine_id").alias("host_id"), ts.alias("timestamp"), message.alias("message"), F.lit(source).alias("source"), F.lit(kind).alias("kind"), F.lit(kind).alias("data_type"),
        name.alias("process_name"), number.alias("process_id"), text("uid").alias("user"), path.alias("path"), args.alias("args"), cmdline.alias("cmdline"), F.lit("info").alias("severity"), F.to_json(F.struct("*")).alias("ext"),
    )


def as_process_rows(obs: DataFrame, hidden: DataFrame | None = None, host: str = "host_id") -> DataFrame:
    """Inventory rows of processes; hidden ones are named (hidden)."""
    rows = obs.select(F.col(host).alias("machine_id"), "pid", "ppid", F.col("comm").alias("name"), F.get("uids", F.lit(0)).alias("uid"), F.coalesce("exe", F.lit("")).alias("path"), F.array_join(F.slice("cmdline", 2, 1 << 20), " ").alias("args"))
    if hidden is None:
        return rows
    more = hidden.select(F.col(host).alias("machine_id"), "pid", F.lit(0).alias("ppid"), F.lit("(hidden)").alias("name"), F.coalesce("uid", F.lit(0)).cast("bigint").alias("uid"), F.coalesce("exe", F.lit("")).alias("path"), F.lit("").alias("args"))
    return rows.unionByName(more)


def as_file_rows(obs: DataFrame, host: str = "host_id") -> DataFrame:
    return obs.select(F.col(host).alias("machine_id"), "path", "uid", F.lpad(F.conv(F.col("mode").cast("string"), 10, 8), 4, "0").alias("permissions"), "owner", "group", F.col("size").try_cast("long").alias("size"))


def as_connection_rows(obs: DataFrame, host: str = "host_id") -> DataFrame:
    """Sockets with a remote end."""
    far = F.coalesce("remote_ip", F.lit(""))
    return obs.where(~far.isin("", "0.0.0.0", "::")).select(F.col(host).alias("machine_id"), "remote_ip", "local_ip", "remote_port", F.col("owning_comm").alias("process_name"))
