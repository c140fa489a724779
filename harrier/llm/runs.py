"""Periodic runs of words: LZ factors, leftmost runs across their borders, the rest copied.

A run is a longest stretch of words with a smallest period q that holds at
least ``power`` periods. The words of a text are factorised by a suffix
automaton (each factor is the longest one that also starts earlier). A run that
touches a factor's border is found by longest common extensions from that
border; one strictly inside a factor is the image of a run in the factor's
earlier occurrence, and copied from there.

Before that, stretches that can't hold a run are set aside, without loss: with
at least four periods and six words, each three words in a row of a run occur
three times or more in their text. What is left between such places is
factorised stretch by stretch.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, POWER = 6, 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, start of an earlier occurrence or -1) of the LZ factors of s; occurrences may overlap."""
    after, link, longest, first = [{}], [-1], [0], [-1]
    last = 0
    for i, c in enumerate(s):
        new = len(after)
        after.append({}), link.append(0), longest.append(longest[last] + 1), first.append(i)
        p, last = last, new
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if longest[q] != longest[p] + 1:
                twin = len(after)
                after.append(dict(after[q])), link.append(link[q]), longest.append(longest[p] + 1), first.append(first[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = twin
                    p = link[p]
                link[q], q = twin, twin
            link[new] = q
    out, i, n = [], 0, len(s)
    while i < n:
        state = size = 0
        while i + size < n:
            to = after[state].get(s[i + size], 0)
            if not to or first[to] - size >= i:
                break
            state, size = to, size + 1
        out.append((i, size or 1, first[state] - size + 1 if size else -1))
        i += size or 1
    return out


def _prefix_matches(s: list[int]) -> list[int]:
    """At each place, how much of the start of s stands there."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    z[0] = n
    return z


def _across(s: list[int], low: int, border: int, high: int, least: int, power: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of stretches of s[low:high] that touch the border and can't be extended in s."""
    t, v = s[low:border], s[border:high]
    most = (len(t) + len(v)) // power
    ahead = _prefix_matches([*v, -1, *t, *v])
    behind = _prefix_matches([*t[::-1], -1, *v[::-1], *t[::-1]])
    for p in range(1, most + 1):
        spans = []
        if p <= len(v):  # a period stands to the right of the border
            spans.append((border - behind[len(t) + 1 + len(v) - p], border + p + (ahead[p] if p < len(v) else 0)))
        if p <= len(t):  # a period stands to its left
            spans.append((border - p - (behind[p] if p < len(t) else 0), border + ahead[len(v) + 1 + len(t) - p]))
        for start, end in spans:
            if end - start >= max(least, power * p) and (start == 0 or s[start - 1] != s[start - 1 + p]) and (end == len(s) or s[end] != s[end - p]):
                yield start, end, p


def stretch_runs(s: list[int], least: int = LEAST, power: int = POWER) -> dict[tuple[int, int], int]:
    """{(start, end): smallest period} of all runs of s.

    A run whose last word is in a factor u, and that began before it, starts no
    more than the factor w before u and a third of both before u: a longer one would
    hold w and the next word a period earlier, though w is the longest that occurs earlier.
    """
    found: dict[tuple[int, int], int] = {}
    starts: dict[int, dict[int, int]] = defaultdict(dict)

    def add(start: int, end: int, p: int) -> None:
        if p < found.get((start, end), p + 1):
            found[start, end] = starts[start][end] = p

    parts = factors(s)
    for k, (a, size, _) in enumerate([*parts, (len(s), 0, -1)]):
        before = parts[k - 1][1] if k else 0
        low = max(0, a - before - (size + before) // (power - 1) - 1)
        if a + size - low >= least:
            for run in _across(s, low, a, a + size, least, power):
                add(*run)
    for a, size, earlier in parts:
        if size > least + 1:
            shift = a - earlier
            for x in range(a + 1, a + size - least):
                for end, p in list(starts.get(x - shift, {}).items()):
                    if end + shift < a + size:
                        add(x, end + shift, p)
    return found


def _stretches(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches (start, end) whose every three words occur three times in the text; all runs of at least four periods lie in them."""
    v = int(ids.max()) + 1
    if v < 1 << 20:
        triples = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:
        triples = np.unique(ids[:-2] * v + ids[1:-1], return_inverse=True)[1] * v + ids[2:]
    _, at, counts = np.unique(triples, return_inverse=True, return_counts=True)
    often = counts[at] >= 3
    if not often.any():
        return []
    inside = np.zeros(len(ids) + 2, bool)
    for k in range(3):
        inside[1 + k : 1 + k + len(often)] |= often
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= least]


def text_runs(words: list[bytes], least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs, by start, then period."""
    if len(words) < max(least, 3):
        return []
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    if 2 * (len(ids) - len(number)) < least:  # words of a run occur twice at least
        return []
    out = []
    for a, b in _stretches(np.array(ids, np.int64), least):
        out += [(a + start, end - start, p) for (start, end), p in stretch_runs(ids[a:b], least, power).items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        kept = bytearray(b"\1") * len(words)
        for start, length, p in runs:
            kept[start + p : start + length] = bytes(length - p)
        words = [w for w, k in zip(words, kept) if k]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period, by start, then period) and collapsed, the text without the repeats.

    docs: doc_id, text; other columns are ignored. Words are
    ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch with smallest
    period q (words q apart are equal) of at least ``power`` * q words and at
    least ``least`` that no neighbour extends; the bounds may not be under 4
    and 6. ``collapsed`` leaves out every word that some run holds after its
    first q words, and joins the others by one space.

    Null and empty texts have no words and no runs, and collapse to an empty
    text. Null and repeated doc_ids are fine, each row stands for itself. There
    is no shuffle. A task holds one Arrow batch of texts; beyond that, a text
    takes about 100 bytes a word, and 500 more a word of its longest
    stretch that may hold a run; time is linear but for sorting.
    """
    if power < POWER or least < LEAST:
        raise ValueError("stretches are chosen for at least 4 periods and 6 words")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, collapsed = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or b"").split()  # splits bytes at exactly these six
                found = text_runs(words, least, power)
                sizes.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                collapsed.append(_collapsed(words, found))
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(collapsed, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "runs", "collapsed"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(rows, SCHEMA)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """docs, one text in ten with its words from some place on replaced by a few repeats of those that follow that place.

    With h = crc32(doc_id as text) and g = h div 10, texts with h % 10 = 0
    become: words up to a = g % n, then word a + (i - a) % p at each i, where
    p = 1 + (n - a) div (3 + g % 8). Null doc_ids and texts without words stay.
    """
    words = F.array_remove(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+"), "")
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    chosen = docs.withColumns({"_h": h, "_w": F.when(h % 10 == 0, words)})
    a = F.expr("(_h div 10) % size(_w)")
    p = F.expr("1 + (size(_w) - _a) div (3 + (_h div 10) % 8)")
    chosen = chosen.withColumn("_a", F.when(F.size("_w") > 0, a).cast("int")).withColumn("_p", p.cast("int"))
    rest = F.size("_w") - F.col("_a")
    many = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.ceil(rest / F.col("_p")).cast("int")))
    planted = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.slice(many, F.lit(1), rest)), " ")
    return chosen.withColumn("text", F.when(F.col("_a").isNotNull(), planted).otherwise(F.col("text"))).drop("_h", "_w", "_a", "_p")


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the greatest length / period (ties: smallest start, then period) and digests of the runs and the collapsed text."""
    by = lambda x, y: F.when(x.length * y.period > y.length * x.period, -1).when(x.length * y.period < y.length * x.period, 1)
    order = lambda x, y: by(x, y).when(x.start != y.start, F.when(x.start < y.start, -1).otherwise(1)).otherwise(F.signum(x.period - y.period).cast("int"))
    top = F.get(F.array_sort("runs", order), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    told = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = found.withColumns({"_top": top, "n_runs": F.size("runs").cast("long"), "runs_sha256": sha(told), "collapsed_sha256": sha(F.col("collapsed"))})
    milli = F.expr("_top.length * 1000 div _top.period").alias("exponent_milli")
    return out.select("doc_id", "n_runs", "_top.start", "_top.length", "_top.period", milli, "runs_sha256", "collapsed_sha256")
