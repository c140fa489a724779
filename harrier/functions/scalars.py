"""Scalar functions over security telemetry, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import sure

# Default path lists and patterns
SUSPICIOUS_PATHS = ["/tmp/", "/dev/shm/", "/var/tmp/", r"/home/[^/]+/\.[^/]+", r"^\./", r"/(?:bin|sbin|usr/bin|usr/sbin)/\.[^/]+"]
VOLATILE_PREFIXES = ["/var/log/", "/var/cache/", "/var/lib/dpkg/", "/var/lib/apt/", "/var/tmp/", "/tmp/", "/run/", "/proc/", "/sys/", "/dev/"]
SYSTEM_PREFIXES = ["/etc/", "/bin/", "/sbin/", "/usr/bin/", "/usr/sbin/", "/root/"]
NOTED_PREFIXES = [*SYSTEM_PREFIXES, "/boot/", "/var/spool/cron/"]
PSEUDO_ROOTS = ["/proc", "/sys", "/dev"]
COMMON_ROOT = [
    "systemd", "init", "sshd", "cron", "crond", "rsyslogd", "dockerd", "containerd", "kubelet", "networkd", "systemd-networkd", "systemd-resolved",
    "systemd-journald", "systemd-logind", "systemd-udevd", "dbus-daemon", "polkitd", "snapd", "unattended-upgr", "accounts-daemon", "rtkit-daemon",
    "cups-browsed", "cupsd", "avahi-daemon",
]
SEVERITIES = ["info", "low", "medium", "high", "critical"]
PLACEHOLDERS = [
    (r"S[-–]1[-–]([0-9]+[-–])+[0-9]+", "<SID>"),
    (r"\{?[0-9A-Fa-f]{8}[-–]([0-9A-Fa-f]{4}[-–]){3}[0-9A-Fa-f]{12}\}?", "<GUID>"),
    (r"\b(?:[A-Fa-f0-9]{64}|[A-Fa-f0-9]{40}|[A-Fa-f0-9]{32}|[A-Fa-f0-9]{20})\b", "<HASH>"),
    (r"(?i)(C:\\Users)\\[^\\]*\\", r"$1\\<USER>\\"),
]


def starts_any(c: Column, prefixes: list[str]) -> Column:
    return sure(c.rlike("^(?:" + "|".join(map(re.escape, prefixes)) + ")"))


def text_entropy(c: Column) -> Column:
    """Shannon entropy in bits of the characters, without white space and path punctuation; 0 for none."""
    chars = F.array_sort(F.filter(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"[/._\-\s]", ""), ""), lambda x: x != ""))
    n = F.size(chars)
    counts = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)).cast("double"))
    return F.coalesce(F.aggregate(counts, F.lit(0.0), lambda a, k: a - k / n * F.log2(k / n)), F.lit(0.0))


def glob_regex(*globs: str) -> str:
    """One anchored alternation of globs, for rlike."""
    one = lambda g: "".join({"*": ".*", "?": "."}.get(x, re.escape(x)) for x in g)
    return "^(?:" + "|".join(map(one, globs)) + ")$"


def suspicious_path(c: Column, patterns: list[str] = SUSPICIOUS_PATHS) -> Column:
    return sure(c.rlike("|".join(f"(?:{p})" for p in patterns)))


def excluded_path(c: Column, path_patterns: list[str], name_patterns: list[str]) -> Column:
    hit = lambda x, ps: sure(x.rlike("|".join(f"(?:{p})" for p in ps))) if ps else F.lit(False)
    return hit(c, path_patterns) | hit(F.substring_index(c, "/", -1), name_patterns)


def parse_time(c: Column) -> Column:
    """RFC 3339, three naive formats, or epoch seconds as text; null for anything else."""
    naive = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss"]
    known = [F.when(c.rlike(r"^\d{4}-\d\d-\d\dT.*(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(c)), *(F.try_to_timestamp(c, F.lit(f)) for f in naive)]
    return F.coalesce(*known, F.when(c.rlike(r"^\d{9,10}$"), F.timestamp_seconds(c.try_cast("long"))))


def event_time(c: Column, now: Column) -> Column:
    """Epoch seconds or milliseconds, RFC 3339 or naive text; ``now`` where none fits."""
    epoch = c.try_cast("double")
    return F.coalesce(F.when(epoch > 1e11, F.timestamp_millis(epoch.cast("long"))).when(epoch > 0, F.timestamp_seconds(epoch)), parse_time(c), now)


def fresh_time(c: Column, now: Column, most_days: int = 80) -> Column:
    """``now`` for times more than so many days old, by a calendar of 31-day months."""
    ordinal = lambda t: F.year(t) * 372 + F.month(t) * 31 + F.dayofmonth(t)
    return F.when(ordinal(now) - ordinal(c) > most_days, now).otherwise(F.coalesce(c, now))


def group_writable(mode: Column) -> Column:
    """From ls -l text of ten characters at least, or octal text."""
    return _writable(mode, 6, 0o020)


def world_writable(mode: Column) -> Column:
    return _writable(mode, 9, 0o002)


def _writable(mode: Column, place: int, bit: int) -> Column:
    octal = F.when(mode.rlike("^[0-7]{3,6}$"), F.conv(mode, 8, 10).cast("int").bitwiseAND(bit) != 0)
    return F.coalesce(octal, sure((F.length(mode) >= 10) & (F.substring(mode, place, 1) == "w")))


def kernel_thread(name: Column) -> Column:
    return sure(F.trim(name).rlike(r"^\[[^\]]*\]$"))


def split_command(c: Column) -> Column:
    """struct(name, path, args) of a command line; quotes keep blanks together."""
    parts = F.transform(F.regexp_extract_all(c, F.lit(r"""("[^"]*"|'[^']*'|[^\s"']+)""")), lambda x: F.regexp_replace(x, r"""^["']|["']$""", ""))
    path = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    return F.struct(F.substring_index(path, "/", -1).alias("name"), path.alias("path"), F.array_join(F.slice(parts, 2, 1 << 20), " ").alias("args"))


def placeholders(c: Column) -> Column:
    """Security ids, GUIDs, hashes and user folders replaced, in that order."""
    for pattern, mark in PLACEHOLDERS:
        c = F.regexp_replace(c, pattern, mark)
    return c


def path_tokens(c: Column) -> Column:
    """Segments of a path, separators kept."""
    return F.regexp_extract_all(c, F.lit(r"([/\\]|[^/\\]+)"))


def word_tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def title(template: str, fields: dict[str, Column]) -> Column:
    """{{name}} replaced by the field's text, null by ``null``."""
    parts = [fields.get(p[2:-2], F.lit(None)).cast("string") if p.startswith("{{") else F.lit(p) for p in re.split(r"(\{\{[\w.]+\}\})", template) if p]
    return F.concat(*(F.coalesce(p, F.lit("null")) for p in parts))


def volatile_path(path: Column) -> Column:
    return starts_any(path, VOLATILE_PREFIXES)


def critical_credential(path: Column) -> Column:
    return sure(path.isin("/etc/shadow", "/etc/gshadow") | path.startswith("/etc/sudoers") | path.startswith("/boot/") | path.endswith("/authorized_keys"))


def recently_modified(path: Column, access: Column, mtime: Column, uid: Column, suspicious: Column, world: Column, group: Column) -> Column:
    """Changed within 12 hours (credentials), 6 hours (system paths with risk) or 3 hours (suspicious paths) before the access; 5 minutes of skew."""
    age = F.unix_seconds(access) - F.unix_seconds(mtime)
    risky = sure(uid == 0) | suspicious | world | (group & sure(path.contains("/etc") | path.contains("/tmp")))
    system = starts_any(path, SYSTEM_PREFIXES) | sure(path == "/etc")
    hours = F.when(critical_credential(path), 12).when(system & risky, 6).when(suspicious, 3)
    return sure(~volatile_path(path) & (age >= -300) & (F.greatest(age, F.lit(0)) <= hours * 3600))


def root_outside_pseudo(path: Column, has_root: Column) -> Column:
    return has_root & ~starts_any(path, PSEUDO_ROOTS)


def rare_file_interesting(path: Column, suspicious: Column, world: Column, group: Column, recent: Column, has_root: Column) -> Column:
    return suspicious | world | group | recent | root_outside_pseudo(path, has_root) | starts_any(path, [*NOTED_PREFIXES, "/usr/local/bin/", "/usr/local/sbin/"])


def rare_file_priority(path: Column, suspicious: Column, world: Column, group: Column, recent: Column, has_root: Column) -> Column:
    score = lambda p, k: F.when(p, k).otherwise(0)
    return score(suspicious, 5) + F.when(world, 4).when(group, 2).otherwise(0) + score(recent, 3) + score(root_outside_pseudo(path, has_root), 2) + score(starts_any(path, NOTED_PREFIXES), 1)


def rare_file_qualifier(suspicious: Column, world: Column, group: Column, recent: Column, has_root: Column) -> Column:
    tags = F.array_compact(F.array(F.when(suspicious, "suspicious_path"), F.when(world, "world_writable").when(group, "group_writable"), F.when(recent, "recent_mtime"), F.when(has_root, "uid=0")))
    return F.when(F.size(tags) > 0, F.concat(F.lit(" ["), F.array_join(tags, ","), F.lit("]"))).otherwise("")


def effective_uid(uid: Column, owner: Column) -> Column:
    """uid, or what the owner says: root is 0, digits are the uid."""
    return F.coalesce(uid.cast("long"), F.when(owner == "root", F.lit(0)).otherwise(owner.try_cast("long")))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower(severity)).cast("int")


def severity_of_distance(d: Column) -> Column:
    return F.when(d >= 1.0, "critical").when(d >= 0.7, "high").when(d >= 0.45, "medium").otherwise("low")


def severity_of_score(s: Column) -> Column:
    return F.when(s >= 0.85, "critical").when(s >= 0.65, "high").when(s >= 0.4, "medium").otherwise("low")


def score_of_severity(severity: Column) -> Column:
    return F.when(severity == "critical", 1.0).when(severity == "high", 0.8).when(severity == "medium", 0.5).otherwise(0.25)


def fused_score(score: Column, ratio: Column) -> Column:
    """max(s, 0.7 s + 0.3 ratio); what is no finite number counts as 0."""
    finite = lambda x: F.when(F.abs(x) < F.lit(float("inf")), F.nanvl(x, F.lit(0.0))).otherwise(0.0)
    s, r = finite(score.cast("double")), finite(ratio.cast("double"))
    return F.greatest(s, 0.7 * s + 0.3 * r)


def shadow_algorithm(hashed: Column) -> Column:
    """Algorithm tag of a shadow password field."""
    tag = F.get(F.split(hashed, r"\$"), F.lit(1))
    named = F.when(tag == "1", "md5crypt").when(tag.isin("2a", "2b", "2y"), "bcrypt").when(tag == "5", "sha256crypt").when(tag == "6", "sha512crypt").when(tag == "y", "yescrypt").when(tag == "sha1", "sha1crypt")
    return F.when(hashed.startswith("!") | hashed.startswith("*"), "!").when(hashed == "", "empty").otherwise(F.coalesce(named, F.when(F.length(hashed) == 13, "descrypt").otherwise("unknown")))


def weak_key(key_type: Column, bits: Column) -> Column:
    return sure((key_type == "ssh-dss") | ((key_type == "ssh-rsa") & (bits < 2048)))


def interval_seconds(c: Column) -> Column:
    """Seconds of 30m, 6h, 1d and the like; null for anything else."""
    n, unit = F.regexp_extract(c, r"^(\d+)\s*([mhdw])$", 1).try_cast("long"), F.regexp_extract(c, r"^(\d+)\s*([mhdw])$", 2)
    return n * F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800)


def octal_mode(text: Column) -> Column:
    """Permission bits of ls -l text such as -rwxr-x---, as octal text."""
    bit = lambda k, x, v: F.when(F.substring(text, k, 1).isin(*x), v).otherwise(0)
    bits = sum((bit(k, "rwxst", 1 << (10 - k)) for k in range(2, 11)), F.lit(0)) + bit(4, "sS", 0o4000) + bit(7, "sS", 0o2000) + bit(10, "tT", 0o1000)
    return F.when(F.length(text) >= 10, F.lpad(F.conv(bits.cast("string"), 10, 8), 4, "0"))


def inventory_checksum(path: Column, mode: Column) -> Column:
    """Equal for files of one name and mode."""
    return F.xxhash64(F.substring_index(path, "/", -1), F.coalesce(mode, F.lit("")))


def process_of_reason(reason: Column) -> Column:
    """The process that a finding's reason names, if it names one."""
    return F.coalesce(F.nullif(F.regexp_extract(reason, r"\bname=(\S+)", 1), F.lit("")), F.nullif(F.regexp_extract(reason, r"^Rare process: (.+)$", 1), F.lit("")))


def triage_group(detector: Column, reason: Column) -> Column:
    """Key under which findings are judged together: detector and process, or the reason itself."""
    return F.concat_ws(":", detector, F.coalesce(process_of_reason(reason), reason))


def host_has_tag(tags: Column, wanted: str) -> Column:
    """tags: map; matches a key, a value, key:value, or one of a comma-separated list of values."""
    w = wanted.lower()
    hit = lambda e: (F.lower(e["key"]) == w) | (F.lower(e["value"]) == w) | (F.lower(F.concat(e["key"], F.lit(":"), e["value"])) == w) | F.array_contains(F.split(F.lower(e["value"]), r"\s*,\s*"), w)
    return sure(F.exists(F.map_entries(tags), hit))


def parent_directory(path: Column, level: int = 1) -> Column:
    """The name of the directory so many levels above."""
    return F.coalesce(F.get(F.reverse(F.split(path, "/")), F.lit(level)), F.lit(""))
