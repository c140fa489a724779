"""Declarative detection rules: predicates over typed observations, compiled to Columns and evaluated in one pass per kind.

A rule is data: id, kind of observation, severity, predicate, title. Predicates
are two-valued Columns, so ``~`` of a null comparison is true only where the
rule says so. Users add rules as more ``Rule`` objects.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrier.functions import scalars as S
from harrier.functions.predicates import all_of, any_of, basename, contains, contains_any, ends_any, length, list_contains, matches, other, present, same, sure, under_any

from .catalogue import DETAILS

_root: ContextVar[str] = ContextVar("root", default="")


@contextmanager
def fields_of(root: str):
    """Within it, predicates read the fields of the struct column ``root``; outside, columns."""
    token = _root.set(root)
    try:
        yield
    finally:
        _root.reset(token)


def C(name: str) -> Column:
    return F.col(f"{_root.get()}.{name}" if _root.get() else name)


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    severity: str
    where: Callable[[], Column] | None  # None: produced by a correlator
    title: str = ""  # {{kind.field}} stands for the observation's field
    collectors: tuple[str, ...] = ()
    evidence: tuple[str, ...] = field(default=())
    enabled: bool = True
    version: int = 1
    type: str = "custom"
    confidence: str = "medium"
    attack: tuple[str, ...] = ()


def eq(name: str, *values) -> Callable[[], Column]:
    return lambda: any_of(*(same(C(name), v) for v in values))


def yes(name: str) -> Callable[[], Column]:
    return eq(name, True)


def both(*parts: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: all_of(*(p() for p in parts))


def either(*parts: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: any_of(*(p() for p in parts))


def no(part: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: ~part()


def ne(name: str, *values) -> Callable[[], Column]:
    return lambda: all_of(*(other(C(name), v) for v in values))


def known(name: str) -> Callable[[], Column]:
    return lambda: C(name).isNotNull()


def num(name: str, test: Callable[[Column], Column]) -> Callable[[], Column]:
    return lambda: sure(test(C(name)))


def under(name: str, *prefixes: str) -> Callable[[], Column]:
    return lambda: under_any(C(name), *prefixes)


def has(name: str, *texts: str) -> Callable[[], Column]:
    return lambda: contains_any(C(name), *texts)


def holds(name: str, *texts: str) -> Callable[[], Column]:
    """On a list: an element is or holds one of the texts."""
    return lambda: any_of(*(list_contains(C(name), t) for t in texts))


def ends(name: str, *suffixes: str) -> Callable[[], Column]:
    return lambda: ends_any(C(name), *suffixes)


def like(name: str, pattern: str) -> Callable[[], Column]:
    return lambda: matches(C(name), pattern)


def starts(name: str, *prefixes: str) -> Callable[[], Column]:
    return lambda: S.starts_any(C(name), list(prefixes))


# Lists that the predicates below share
STAGING = ("/tmp", "/dev/shm", "/var/tmp")
SHELL_TOOLS = (
    "find", "nmap", "vim", "vi", "nano", "python", "python3", "perl", "ruby", "lua", "awk", "less", "more", "env", "bash", "dash", "sh", "cp", "tar", "gdb", "strace", "tcpdump", "docker", "podman", "nsenter", "unshare",
)
ROOT_TOOLS = (
    "find", "nmap", "vim", "vi", "nano", "python", "python3", "perl", "ruby", "lua", "awk", "less", "more", "man", "env", "bash", "dash", "cp", "tar", "zip", "gdb", "strace", "tcpdump", "docker", "podman", "nsenter", "unshare",
)
SETUID_PROGRAMS = (
    "sudo", "su", "pkexec", "passwd", "chpasswd", "unix_chkpwd", "sudoedit", "newuidmap", "newgidmap", "mount", "umount", "fusermount", "fusermount3", "polkit-agent-helper-1", "dbus-daemon-lau", "ssh-keysign", "snap-confine", "crontab", "chage", "chfn", "chsh", "gpasswd", "newgrp",
)
INTERPRETERS = ("python", "java", "gjs", "node", "ruby", "perl", "php")
NO_LOGIN = ("/usr/sbin/nologin", "/sbin/nologin", "/bin/false", "/usr/bin/false", "/bin/sync", "/sbin/sync", "/usr/sbin/sync")
IMPLANT_DIRS = ("/data/.icscap", "/home/root/data/.icscap")
IMPLANT_FILES = ("/tmp/ml.py", "/tmp/rq5.py", "/tmp/mk.py", "/tmp/rr.py", "/tmp/pu.txt", "/tmp/sp_out.txt", "/tmp/spray_hits.json", "/data/.icscap/h.py", "/data/.icscap/dsstatmond")
IMPLANT_SCRIPTS = ("/ml.py", "/rq5.py", "/mk.py", "/rr.py", "/sp_run.py", "/h.py")
IMPLANT_COMMANDS = ("/.icscap/", "dsstatmond", "/tmp/ml.py", "/tmp/rq5.py", "/tmp/mk.py", "/tmp/rr.py", "/tmp/sp_run.py", "/data/.icscap/h.py", "ics-root-run-inband", "ics-root-result-inband")


def _renamed_process() -> Column:
    """A command name that doesn't fit its executable, outside system folders and interpreters."""
    base, comm = basename(C("exe")), C("comm")
    cut = same(length(comm), 15) & sure(base.startswith(comm))
    return all_of(
        C("exe").isNotNull(), other(C("exe"), ""), other(comm, base), ~matches(comm, r"^\[.*\]$"), ~matches(comm, r"^\(.*\)$"), ~cut,
        ~sure(comm.startswith(base)), ~S.starts_any(base, list(INTERPRETERS)), ~under_any(C("exe"), "/usr", "/lib", "/bin", "/sbin", "/snap"),
    )


ROOT_FROM_USER = both(eq("euid", 0), ne("ruid", 0))

# The rule catalogue (id, kind, severity, predicate)
PREDICATES = [
    Rule("RM-CRED-0001", "shadow_entry", "high", eq("algorithm", "descrypt", "md5crypt", "sha1crypt")),
    Rule("RM-CRED-0002", "shadow_entry", "medium", None),
    Rule("RM-CRED-0003", "shadow_entry", "medium", both(eq("locked", False), eq("empty_password", False), ne("algorithm", "!"))),
    Rule("RM-CRED-0005", "authorized_key", "medium", either(eq("key_type", "ssh-dss"), both(eq("key_type", "ssh-rsa"), num("bits", lambda c: c < 2048)))),
    Rule("RM-DIR-0001", "dir_anomaly", "high", eq("anomaly", "link_count_mismatch", "nlink_mismatch")),
    Rule("RM-DIR-0002", "dir_anomaly", "high", eq("anomaly", "getdents_mismatch")),
    Rule("RM-DIR-0003", "dir_anomaly", "medium", eq("anomaly", "dotdir_stash")),
    Rule("RM-DIR-0005", "dir_anomaly", "critical", eq("anomaly", "unlisted_open_file")),
    Rule("RM-DRIFT-0001", "integrity_mismatch", "high", lambda: other(C("expected_hash"), C("actual_hash"))),
    Rule("RM-FILE-0001", "file_entropy", "high", both(num("entropy", lambda c: c > 7.2), yes("is_elf"), under("path", *STAGING, "/home"))),
    Rule("RM-FILE-0002", "elf_info", "high", either(yes("has_rwx_segment"), has("packer_hints_joined", "upx"), holds("packer_hints", "UPX"))),
    Rule("RM-FILE-0003", "file_entropy", "high", num("window_max", lambda c: c > 7.0)),
    Rule("RM-FILE-0004", "integrity_mismatch", "critical", lambda: other(C("expected_hash"), C("actual_hash"))),
    Rule("RM-FILE-0005", "file_meta", "low", both(either(yes("setuid"), yes("setgid")), eq("uid", 0))),
    Rule("RM-FILE-0006", "file_meta", "high", both(yes("setuid"), under("path", *STAGING, "/home/", "/opt", "/root", "/var/www"))),
    Rule("RM-FILE-0007", "ioc_hit", "critical", eq("ioc_kind", "hash")),
    Rule("RM-FILE-0008", "ioc_hit", "high", eq("ioc_kind", "path")),
    Rule("RM-FILE-0009", "file_entropy", "medium", both(yes("is_elf"), under("path", *STAGING))),
    Rule("RM-FILE-0010", "file_meta", "high", both(under("path", "/dev"), no(under("path", "/dev/shm")), num("size", lambda c: c > 4096))),
    Rule("RM-FILE-0011", "file_meta", "medium", both(yes("immutable"), under("path", *STAGING))),
    Rule("RM-FILE-0012", "timestomp", "medium", yes("btime_after_mtime")),
    Rule("RM-FILE-0013", "elf_info", "high", both(known("interp"), no(under("interp", "/lib", "/usr/lib")))),
    Rule("RM-FILE-0014", "ioc_hit", "high", eq("ioc_kind", "string")),
    Rule("RM-FILE-0015", "file_meta", "critical", both(yes("setuid"), ends("path", *("/" + t for t in SHELL_TOOLS)))),
    Rule("RM-ICS-0001", "file_meta", "critical", either(eq("path", *IMPLANT_FILES), ends("path", "/sp_run.py"), like("path", r"/tmp/(ml|rq5|mk|rr|sp_run)\.py$"), like("path", "/home/runtime/tmp/ics-root-(run|result)-inband-"), like("path", "/tmp/ics-root-(run|result)-inband-"))),
    Rule("RM-ICS-0002", "file_meta", "critical", either(under("path", *IMPLANT_DIRS), has("path", "/.icscap/"))),
    Rule("RM-ICS-0003", "process", "critical", either(has("exe", "/.icscap/"), ends("exe", "/dsstatmond"), under("exe", *IMPLANT_DIRS), both(under("exe", "/tmp"), ends("exe", *IMPLANT_SCRIPTS)), holds("cmdline", *IMPLANT_COMMANDS), eq("comm", "dsstatmond"))),
    Rule("RM-ICS-0004", "file_meta", "high", both(under("path", "/home/runtime/tmp"), either(has("path", "ics-root-"), ends("path", ".pl"), like("path", "/[0-9a-f]{32}$")))),
    Rule("RM-INC-0004", "authorized_key", "critical", None),
    Rule("RM-KERN-0001", "module", "critical", either(both(eq("in_sysfs", True), eq("in_proc_modules", False)), both(eq("in_sysfs", False), eq("in_proc_modules", True)))),
    Rule("RM-KERN-0002", "module", "high", has("taint_flags", "E", "O")),
    Rule("RM-KERN-0004", "module", "critical", like("name", "(?i)diamorphine|reptile|kit|rootkit")),
    Rule("RM-KERN-0006", "bpf_prog", "critical", yes("orphan")),
    Rule("RM-LOG-0001", "log_integrity", "high", both(has("path", "wtmp", "utmp"), eq("issue", "zeroed", "out_of_order", "truncated"))),
    Rule("RM-LOG-0002", "log_integrity", "high", either(eq("issue", "nul_hole"), has("issue", "deletion"))),
    Rule("RM-LOG-0004", "log_integrity", "high", eq("issue", "missing")),
    Rule("RM-LOG-0007", "process", "medium", holds("environ_flags", "HISTFILE_NULL", "HISTFILE=/dev/null", "HISTFILE=null")),
    Rule("RM-ML-0001", "command_score", "high", None),
    Rule("RM-NET-0001", "hidden_socket", "critical", num("local_port", lambda c: c >= 0)),
    Rule("RM-NET-0002", "socket", "critical", both(eq("state", "LISTEN"), no(known("owning_pid")), yes("owner_unresolved"))),
    Rule("RM-NET-0003", "socket", "high", both(eq("state", "LISTEN"), num("local_port", lambda c: c > 0))),
    Rule("RM-NET-0005", "socket", "high", eq("protocol", "RAW", "PACKET")),
    Rule("RM-PERSIST-0001", "preload", "critical", yes("present")),
    Rule("RM-PERSIST-0002", "preload", "high", both(yes("present"), has("path", "ld.so.conf"))),
    Rule("RM-PERSIST-0003", "scheduled_task", "high", has("command", "curl", "wget", "base64", "/tmp/")),
    Rule("RM-PERSIST-0005", "service", "high", has("exec_start", "/tmp/", "/dev/shm/")),
    Rule("RM-PERSIST-0009", "service", "high", both(has("exec_start", "LD_PRELOAD", "LD_AUDIT", "curl ", "wget "), either(under("path", "/etc/profile.d"), has("path", "bashrc", "profile")))),
    Rule("RM-POL-0001", "ssh_host_key", "critical", yes("changed")),
    Rule("RM-POL-0021", "policy", "high", eq("code", "RM-POL-0021")),
    Rule("RM-POL-0032", "file_meta", "medium", both(yes("world_writable"), under("path", "/usr/bin", "/usr/local/bin", "/bin"))),
    Rule("RM-PROC-0001", "hidden_process", "critical", num("passes_confirmed", lambda c: c >= 2)),
    Rule("RM-PROC-0002", "hidden_process", "high", eq("passes_confirmed", 1)),
    Rule("RM-PROC-0004", "process", "high", either(yes("exe_deleted"), has("exe", "(deleted)"))),
    Rule("RM-PROC-0005", "process", "critical", yes("exe_memfd")),
    Rule("RM-PROC-0006", "process", "high", _renamed_process),
    Rule("RM-PROC-0007", "process", "high", both(like("comm", r"^\[.*\]$"), lambda: present(C("exe")))),
    Rule("RM-PROC-0008", "process", "high", under("exe", *STAGING, "/home/")),
    Rule("RM-PROC-0009", "process", "high", holds("environ_flags", "LD_PRELOAD", "LD_AUDIT")),
    Rule("RM-PROC-0010", "process", "medium", num("unbacked_exec", lambda c: c > 0)),
    Rule("RM-PROC-0011", "process", "medium", both(eq("uid", 0), eq("ppid", 1), eq("tty", 0), lambda: length(C("listen_ports"), "list") > 0)),
    Rule("RM-PROC-0012", "process", "medium", both(ne("euid", 0), yes("dangerous_caps"))),
    Rule("RM-PROC-0013", "process", "medium", under("cwd", *STAGING)),
    Rule("RM-PROC-0015", "process", "high", both(ROOT_FROM_USER, ne("comm", *SETUID_PROGRAMS))),
    Rule("RM-PROC-0016", "process", "high", both(eq("euid", 0), under("exe", *STAGING, "/run/user/", "/home/"))),
    Rule("RM-PROC-0017", "process", "critical", both(eq("euid", 0), eq("comm", "bash", "sh", "dash", "zsh"), holds("cmdline", "-p"))),
    Rule("RM-PROC-0018", "process", "high", both(ROOT_FROM_USER, eq("comm", *ROOT_TOOLS))),
    Rule("RM-PROC-0019", "process", "high", both(ROOT_FROM_USER, starts("comm", "python"), under("cwd", *STAGING, "/home/", "/run/user/", "/var/www"))),
    Rule("RM-USER-0001", "account", "critical", both(eq("uid", 0), ne("username", "root"))),
    Rule("RM-USER-0002", "shadow_entry", "critical", yes("empty_password")),
    Rule("RM-USER-0003", "account", "high", both(num("uid", lambda c: c < 1000), ne("uid", 0), ne("shell", *NO_LOGIN), no(ends("shell", "/nologin", "/false")))),
    Rule("RM-USER-0004", "account", "medium", None),
    Rule("RM-USER-0005", "sudo_rule", "high", both(yes("nopasswd"), yes("all_commands"))),
    Rule("RM-USER-0006", "sudo_rule", "high", has("line", "!authenticate", "SETENV")),
    Rule("RM-USER-0008", "authorized_key", "high", ne("fingerprint", "")),
    Rule("RM-USER-0009", "authorized_key", "medium", both(has("options_joined", "command="), has("options_joined", "/bin/sh", "/bin/bash"))),
]


def described(rule: Rule) -> Rule:
    d = DETAILS[rule.id]
    return replace(rule, title=d.title, collectors=d.collectors, evidence=d.evidence, enabled=d.enabled, version=d.version, type=d.type, confidence=d.confidence, attack=d.attack)


CATALOGUE = [described(r) for r in PREDICATES]


def enabled(rules: Iterable[Rule] = CATALOGUE) -> list[Rule]:
    return [r for r in rules if r.enabled]


def derived_fields(kind: str) -> dict[str, Column]:
    """Fields that rules expect besides the collected ones."""
    if kind == "process":
        caps = sum(1 << b for b in (16, 19, 21, 39))
        return {"uid": F.get(C("uids"), F.lit(0)), "ruid": F.get(C("uids"), F.lit(0)), "euid": F.get(C("uids"), F.lit(1)), "suid": F.get(C("uids"), F.lit(2)), "dangerous_caps": C("caps_eff").bitwiseAND(F.lit(caps)) != 0}
    if kind == "elf_info":
        return {"packer_hints_joined": F.lower(F.array_join(C("packer_hints"), ","))}
    if kind == "authorized_key":
        return {"options_joined": F.array_join(C("options"), ",")}
    if kind == "timestomp":
        return {"btime_after_mtime": sure(C("btime") > C("mtime"))}
    if kind == "file_meta":
        return {"world_writable": C("mode").bitwiseAND(0o002) != 0, "size": C("size").try_cast("long")}
    return {}


def derived(observations: DataFrame, kind: str) -> DataFrame:
    """The observations of one kind with the fields that rules expect besides the collected ones."""
    return observations.withColumns(derived_fields(kind)) if derived_fields(kind) else observations


def _said(field: T.StructField) -> Column:
    """A field as titles show it: null is the word, lists stand in brackets."""
    c = C(field.name)
    text = F.concat(F.lit("["), F.array_join(c, ", ", "null"), F.lit("]")) if isinstance(field.dataType, T.ArrayType) else c.cast("string")
    return F.coalesce(text, F.lit("null"))


def rendered(rule: Rule, fields: dict[str, T.StructField]) -> Column:
    """The rule's title with its fields filled in; a field that observations don't have is null."""
    parts = re.split(r"\{\{\s*([a-zA-Z0-9_.]+)\s*\}\}", rule.title or rule.id)
    filled = [F.lit(x) if k % 2 == 0 else _said(fields[name]) if (name := x.split(".")[-1]) in fields else F.lit("null") for k, x in enumerate(parts)]
    return F.concat(*filled)


def evidence(rule: Rule, fields: dict[str, T.StructField]) -> Column:
    """A JSON object of the rule's evidence fields, nulls included."""
    named = [(C(n) if n in fields else F.lit(None).cast("string")).alias(n) for n in rule.evidence]
    return F.to_json(F.struct(*named), {"ignoreNullFields": "false"}) if named else F.lit("{}")


def _hits(rules: list[Rule], fields: dict[str, T.StructField]) -> Column:
    """An array of the findings that the rules make of one observation."""

    def hit(r: Rule) -> Column:
        told = {"check_id": F.lit(r.id), "version": F.lit(r.version), "type": F.lit(r.type), "severity": F.lit(r.severity), "confidence": F.lit(r.confidence), "title": rendered(r, fields), "evidence": evidence(r, fields), "attack": F.lit(",".join(r.attack)), "match_kind": F.lit(r.kind)}
        return F.when(r.where(), F.struct(*(c.alias(n) for n, c in told.items())))

    return F.array_compact(F.array(*map(hit, rules)))


FINDING = ("check_id", "version", "type", "severity", "confidence", "title", "evidence", "attack", "match_kind")


def evaluate(observations: DataFrame, kind: str, rules: Iterable[Rule] = CATALOGUE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, check_id, severity, title): one row for each rule that an observation of the kind meets, enabled or not, in one pass over them."""
    mine = [r for r in rules if r.kind == kind and r.where is not None]
    if not mine:
        return observations.select(*keep, *(F.lit("").alias(n) for n in ("check_id", "severity", "title"))).where("false")
    full = derived(observations, kind)
    df = full.select(*keep, F.explode(_hits(mine, {f.name: f for f in full.schema})).alias("f"))
    return df.select(*keep, "f.check_id", "f.severity", "f.title")


def evaluate_all(by_kind: dict[str, DataFrame], rules: Iterable[Rule] = CATALOGUE, keep: tuple[str, ...] = ("host_id",)) -> DataFrame:
    """Findings of all kinds, in the order of check and title."""
    found = [evaluate(df, kind, rules, keep) for kind, df in by_kind.items()]
    return reduce(lambda a, b: a.unionByName(b), found).orderBy("check_id", "title")


def findings(parsed: DataFrame, rules: Iterable[Rule] | None = None, keep: tuple[str, ...] = ("host_id",)) -> DataFrame:
    """(keep, check_id, version, type, severity, confidence, title, evidence, attack, match_kind) of all kinds, in one pass.

    parsed: as ``observations.parsed`` gives it, a struct column for each kind, of which a row has one. Without ``rules``, the
    enabled ones of the catalogue. A row's rules are only those of its kind; no row is read twice and nothing is shuffled.
    """
    rules, by_kind = list(enabled() if rules is None else rules), []
    for f in parsed.schema:
        mine = [r for r in rules if r.kind == f.name and r.where is not None]
        if not mine or not isinstance(f.dataType, T.StructType):
            continue
        with fields_of(f.name):
            by_kind.append(F.when(F.col(f.name).isNotNull(), _hits(mine, {x.name: x for x in f.dataType})))
    df = parsed.select(*keep, F.explode(F.coalesce(*by_kind)).alias("f"))
    return df.select(*keep, *(f"f.{n}" for n in FINDING))


# What a rule of a kind needs where it names no collectors, and the collectors of a scan's extent
KIND_COLLECTORS = {
    "hidden_process": ("decloak.process",),
    "process": ("process.inventory",),
    "command_score": ("process.inventory",),
    "hidden_socket": ("decloak.socket",),
    "socket": ("net.sockets",),
    "file_entropy": ("entropy",),
    "elf_info": ("file.elf",),
    "preload": ("persistence.preload",),
    "account": ("persistence.accounts",),
    "shadow_entry": ("cred.audit",),
    "sudo_rule": ("persistence.services",),
    "authorized_key": ("ssh.keys",),
    "module": ("modules.lkm",),
    "bpf_prog": ("ebpf",),
    "file_meta": ("file.ioc", "fs.anomaly"),
    "timestomp": ("file.ioc", "fs.anomaly"),
    "ioc_hit": ("file.ioc",),
    "integrity_mismatch": ("file.integrity",),
    "dir_anomaly": ("dir.hidden",),
    "log_integrity": ("log.integrity",),
    "scheduled_task": ("persistence.scheduled",),
    "service": ("persistence.services",),
    "utmp_session": ("log.integrity",),
    "mount": ("mount.anomaly",),
    "container_info": ("container.escape",),
}
PULSE = ("decloak.process", "process.inventory", "recon.inventory")
STANDARD = (*PULSE, "persistence.preload", "persistence.accounts", "modules.lkm", "net.sockets", "persistence.services", "persistence.scheduled", "ssh.keys")
DEEP = (*STANDARD, "file.integrity", "file.ioc", "entropy", "dir.hidden", "log.integrity", "modules.ebpf", "cred.audit", "session.inventory", "mounts.inventory", "container.inventory")
BUNDLES = {"pulse": PULSE, "standard": STANDARD, "deep": DEEP, "incident": DEEP}


def needs(rule: Rule) -> tuple[str, ...]:
    """The collectors that feed a rule: its own, or those of its kind."""
    return rule.collectors or KIND_COLLECTORS.get(rule.kind, ())


def resolve(rules: Iterable[Rule], collectors: Iterable[str]) -> list[Rule]:
    """The enabled observation rules that the collectors can feed; a rule that no collector feeds is not among them."""
    have = set(collectors)
    return [r for r in rules if r.enabled and r.kind != "command_score" and needs(r) and set(needs(r)) <= have]


def bundle(name: str) -> tuple[str, ...]:
    """The collectors of a scan's extent; an unknown name is standard."""
    return BUNDLES.get(name, STANDARD)


def collectors_needed(rules: Iterable[Rule]) -> list[str]:
    """All collectors of the rules; those of the quickest scan where none is needed."""
    return sorted({c for r in rules for c in needs(r)}) or sorted(PULSE)


__all__ = ["CATALOGUE", "Rule", "bundle", "collectors_needed", "contains", "derived", "enabled", "evaluate", "evaluate_all", "findings", "needs", "resolve"]
