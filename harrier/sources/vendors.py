"""Vendors' process and file rows: ordered aliases for each field, presets of them, and ways to compose a command from its parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.functions.scalars import kernel_thread, split_command

from .readers import mapped

# Aliases of the fields, the first one with a value counts
PROCESS = {
    "pid": ["pid", "process_id", "ProcessId"],
    "ppid": ["ppid", "parent_pid", "parent", "ParentProcessId"],
    "name": ["name", "comm", "process", "process_name", "ProcessName"],
    "path": ["path", "exe", "executable", "Image", "image", "ImagePath"],
    "args": ["args", "arguments", "params"],
    "command": ["command", "cmd", "cmdline", "commandline", "CommandLine", "command_line", "ProcessCommandLine"],
    "uid": ["uid", "user", "user_id", "userid"],
    "machine_id": ["machine_id", "hostname", "host", "server", "node"],
    "timestamp": ["timestamp", "time", "datetime", "start_time"],
}
FILE = {
    "path": ["file_path", "path", "TargetFilename"],
    "machine_id": PROCESS["machine_id"],
    "timestamp": PROCESS["timestamp"],
    "mtime": ["date", "mtime", "modified"],
    "permissions": ["permissions", "mode"],
    "owner": ["owner", "user"],
    "group": ["group"],
    "size": ["size"],
}
# What presets change, and how they compose a command
PRESETS = {
    "command": ({}, {}, "command"),
    "osquery": ({"command": ["cmdline"], "path": ["path", "cwd"], "name": ["name", "comm"]}, {"path": ["path"]}, "path_then_args"),
    "sysmon": ({"command": ["CommandLine", "ParentCommandLine"], "path": ["Image", "ImagePath"], "name": ["ProcessName", "Image"], "pid": ["ProcessId", "pid"], "ppid": ["ParentProcessId", "ppid"]}, {"path": ["TargetFilename", "path"]}, "command"),
}
OTHER_NAMES = {"windows": "sysmon"}
COMPOSE = ("command", "path_then_args", "name_then_args")


def preset(name: str) -> tuple[dict, dict, str]:
    """(process aliases, file aliases, compose mode); an unknown name is ``command``."""
    key = name.strip().lower()
    process, file, compose = PRESETS.get(OTHER_NAMES.get(key, key), PRESETS["command"])
    return PROCESS | process, FILE | file, compose


def process_name(token: Column) -> Column:
    """The last part of a path; a kernel thread's name stays whole."""
    t = F.trim(token)
    return F.when(kernel_thread(t), t).otherwise(F.regexp_extract(t, "([^/]*)/*$", 1))


def process_rows(lines: DataFrame, preset_name: str = "command", machine: str = "", compose: str | None = None, aliases: dict[str, list[str]] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep and) process rows of JSON lines by a preset, or by aliases of one's own on top of it; lines that name no process are left out.

    compose ``command``: a full command line fills what name, path and args lack;
    ``path_then_args`` and ``name_then_args``: only where there is no path, or no name.
    """
    fields, _, mode = preset(preset_name)
    mode = compose or mode
    if mode not in COMPOSE:
        raise ValueError(f"no way to compose a command: {mode}")
    # each field is read once, then composed
    found = mapped(F.col("line"), fields | (aliases or {}))
    rows = lines.where(F.json_object_keys("line").isNotNull()).select(*keep, *(c.alias(f"_{k}") for k, c in found.items()))
    rows = rows.select("*", F.when(~kernel_thread(F.trim("_command")), split_command(F.trim("_command"))).alias("_s"))
    text = lambda k: F.coalesce(F.col(f"_{k}"), F.lit(""))
    fill = lambda own, other: F.when(own != "", own).otherwise(other)
    name, path, args, command = text("name"), text("path"), text("args"), F.col("_command")
    n, p, a = F.coalesce("_s.name", F.trim(command)), F.coalesce("_s.path", F.lit("")), F.coalesce("_s.args", F.lit(""))
    if mode == "command":
        split = command.isNotNull()
        out = {"name": F.when(split, fill(name, n)).otherwise(fill(name, process_name(path))), "path": F.when(split, fill(path, p)).otherwise(path), "args": F.when(split, fill(args, a)).otherwise(args)}
    elif mode == "path_then_args":
        split = command.isNotNull() & (path == "")
        out = {"name": F.when(split, fill(name, n)).otherwise(fill(name, process_name(path))), "path": F.when(split, p).otherwise(path), "args": F.when(split, fill(args, a)).otherwise(args)}
    else:
        split = command.isNotNull() & (name == "")
        rows = rows.where((name != "") | command.isNotNull())
        out = {"name": F.when(split, n).otherwise(name), "path": path, "args": F.when(split, fill(args, a)).otherwise(args)}
    number = lambda k: F.coalesce(F.col(f"_{k}").try_cast("bigint"), F.lit(0)).alias(k)
    rows = rows.select(*keep, F.coalesce("_machine_id", F.lit(machine)).alias("machine_id"), number("pid"), number("ppid"), out["name"].alias("name"), number("uid"), out["path"].alias("path"), out["args"].alias("args"), F.col("_timestamp").alias("timestamp"))
    return rows.where("name <> '' OR path <> ''")


def file_rows(lines: DataFrame, preset_name: str = "command", machine: str = "", aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """File rows of JSON lines; those without a path are left out."""
    m = mapped(F.col("line"), preset(preset_name)[1] | (aliases or {}))
    path = F.trim(m["path"])
    rows = lines.where(F.coalesce(path, F.lit("")) != "")
    return rows.select(F.coalesce(m["machine_id"], F.lit(machine)).alias("machine_id"), path.alias("path"), F.lit(0).cast("bigint").alias("uid"), m["timestamp"].alias("timestamp"), m["mtime"].alias("mtime"), m["permissions"].alias("permissions"), m["owner"].alias("owner"), m["group"].alias("group"), m["size"].try_cast("bigint").alias("size"))
