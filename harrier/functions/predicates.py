"""Search and rule predicates as two-valued Columns: never null, so NOT is safe."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = {"process_id", "exe_memfd", "local_port", "remote_port", "ppid"}


def sure(p: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(p, F.lit(False))


def all_of(*ps: Column) -> Column:
    return reduce(lambda a, b: a & b, ps, F.lit(True))


def any_of(*ps: Column) -> Column:
    return reduce(lambda a, b: a | b, ps, F.lit(False))


# -- search expressions


def equals(c: Column, value: str) -> Column:
    return sure(c.cast("string") == value)


def differs(c: Column, value: str) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) != value


def compare(c: Column, op: str, value, kind: str = "double") -> Column:
    """Ordered comparison after try_cast to the column's type; what can't be cast matches nothing."""
    a, b = c.try_cast(kind), F.lit(value).try_cast(kind)
    return sure({">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op])


def like_pattern(glob: str) -> str:
    """LIKE pattern of a glob: * and ? are wildcards, all else is literal."""
    return re.sub(r"[\\%_]", lambda m: "\\" + m[0], glob).replace("*", "%").replace("?", "_")


def glob(c: Column, pattern: str) -> Column:
    return sure(c.cast("string").like(like_pattern(pattern)))


def present(c: Column, numeric: bool = False) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0)) != 0 if numeric else F.coalesce(c.cast("string"), F.lit("")) != ""


def one_of(c: Column, *values: str) -> Column:
    return sure(c.cast("string").isin(*values))


def tokens_of(text: str) -> list[str]:
    """Lower-case runs of letters and digits of two characters at least."""
    return [t for t in re.split(r"[\W_]+", text.lower()) if len(t) > 1]


def has_tokens(message: Column, text: str) -> Column:
    """All tokens of the text are whole tokens of the message, in any case."""
    words = F.split(F.lower(message), r"[^\p{L}\p{N}]+")
    return all_of(*(sure(F.array_contains(words, t)) for t in tokens_of(text)))


def same_fields(a: Column, b: Column) -> Column:
    return sure(a == b)


def tagged(ext: Column, tag: str, path: str = "$.tags") -> Column:
    """Membership in a JSON array; a tag with wildcards is matched against the joined tags."""
    tags = F.from_json(F.get_json_object(ext, path), "array<string>")
    return glob(F.array_join(tags, ","), tag) if set("*?") & set(tag) else sure(F.array_contains(tags, tag))


def of_type(data_type: Column, ext: Column, pattern: str) -> Column:
    """A data type that matches, or an event type in the JSON of ext; traces of crashes also go by the names of their frames."""
    found = glob(data_type, pattern) | glob(F.get_json_object(ext, "$.event_type"), pattern)
    if "tombstone_backtrace" not in pattern:
        return found
    return found | sure(data_type.contains("tombstone") & (data_type.contains("frame") | data_type.contains("backtrace")))


def in_range(ts: Column, start=None, end=None) -> Column:
    """Both bounds inclusive, either may be missing."""
    return all_of(*([sure(ts >= F.lit(start))] if start is not None else []), *([sure(ts <= F.lit(end))] if end is not None else []))


UNITS = {"s": "seconds", "sec": "seconds", "m": "minutes", "min": "minutes", "h": "hours", "hr": "hours", "d": "days", "day": "days", "w": "weeks"}


def span(text: str) -> str:
    """Interval text of 5m, 24h, 7d and the like; the longest unit name counts."""
    m = re.fullmatch(r"(\d+)\s*([a-z]+?)s?", text.strip().lower())
    if not m or m[2] not in UNITS and m[2] + "s" not in UNITS.values():
        raise ValueError(f"not a time span: {text!r}")
    return f"{m[1]} {UNITS.get(m[2], m[2] + 's')}"


def last(ts: Column, text: str, now: Column) -> Column:
    """From ``now`` back by the span; now is given, so a rerun sees the same rows."""
    return sure((ts >= now - F.expr(f"INTERVAL {span(text)}")) & (ts <= now))


# -- rule expressions


def same(a: Column, b) -> Column:
    """Null equals null and nothing else."""
    return a.eqNullSafe(b)


def other(a: Column, b) -> Column:
    return ~a.eqNullSafe(b)


def path_under(c: Column, prefix: str, strict: bool = False) -> Column:
    """The path itself or below it; a prefix that ends in a colon is a scheme. strict keeps a trailing slash as it is."""
    p = prefix if strict else prefix.rstrip("/") or "/"
    return sure((c == p) | c.startswith(p + "/") | (c.startswith(p) if p.endswith(":") else F.lit(False)))


def under_any(c: Column, *prefixes: str) -> Column:
    return any_of(*(path_under(c, p) for p in prefixes))


def contains(c: Column, text: str) -> Column:
    return sure(c.contains(text))


def contains_any(c: Column, *texts: str) -> Column:
    return any_of(*(contains(c, t) for t in texts))


def list_contains(c: Column, text: str) -> Column:
    """An element is the text or holds it in any ASCII case."""
    return sure(F.exists(c, lambda e: (e == text) | F.contains(F.lower(e), F.lit(text.lower()))))


def ends_any(c: Column, *suffixes: str) -> Column:
    return any_of(*(sure(c.endswith(s)) for s in suffixes))


def matches(c: Column, pattern: str) -> Column:
    if len(pattern.encode()) > 512:
        raise ValueError("pattern over 512 bytes")
    return sure(c.rlike(pattern))


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def length(c: Column, kind: str = "string") -> Column:
    """Bytes of a string, elements of a list; 0 for null."""
    return F.coalesce(F.octet_length(c) if kind == "string" else F.size(c), F.lit(0))
