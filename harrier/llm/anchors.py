"""Repeated windows of long token sequences, found through a content-defined sample of their positions.

Two equal windows hold the same grams, so each window's least-hashed gram, its
anchor, is the same gram at the same place in both. Only anchors are shuffled:
about one position in ``(window - gram) / 2``. The windows that share one
anchor occurrence are consecutive and are named together by a hash of all the
tokens they cover. Names that are equal settle all their windows at once;
where one anchor has different names, as at the ends of a match, its windows
are named one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_broadcast
from .minhash import mix

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 5)
SLICE = 1 << 19  # tokens that are hashed at once
HOT, SALTS = 1000, 16
BROADCAST_IDS = 2_000_000

_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> list[np.ndarray]:
    """BASE**i and its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        inverse = U(pow(int(BASE), -1, 1 << 64))
        for k, base in enumerate((BASE, inverse)):
            table = np.full(max(n, SLICE), base, U)
            table[0] = 1
            _powers[k] = np.cumprod(table)
    return _powers


class Hashes:
    """Hashes of any stretch of a token sequence; a token is a random 64-bit value."""

    def __init__(self, tokens: np.ndarray):
        up, self.down = powers(len(tokens) + 1)
        self.sums = np.zeros(len(tokens) + 1, U)
        np.cumsum(tokens * up[: len(tokens)], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a])

    def every(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.empty(0, U)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    n, have = len(keys) - width + 1, 1
    while have * 2 <= width:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    return np.minimum(keys[:n], keys[width - have : width - have + n])


def find_anchors(tokens: np.ndarray, lengths: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of documents laid end to end: document, first window, number of windows, anchor's place after the first window, anchor hash, name."""
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U, U))
    if len(tokens) < window:
        return none
    h = Hashes(tokens)
    grams = h.every(gram)
    bits = U(max(24, len(tokens).bit_length()))
    keys = (grams >> bits << bits) | np.arange(len(grams), dtype=U)
    anchor = (sliding_least(keys, window - gram + 1) & ((U(1) << bits) - U(1))).astype(np.int64)
    ends = np.cumsum(lengths)
    end = np.repeat(ends, lengths)[: len(anchor)]
    starts = np.flatnonzero(np.arange(len(anchor)) + window <= end)
    if not len(starts):
        return none
    own = anchor[starts]
    cut = np.flatnonzero(own[1:] != own[:-1]) + 1
    first, last = starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])]
    p = anchor[first]
    doc = np.searchsorted(ends, first, side="right")
    name = mix(h(first, last + window) + (p - first).astype(U) * U(0xD6E8FEB86659FD93) + (last - first).astype(U))
    return doc, first - (ends - lengths)[doc], last - first + 1, p - first, grams[p], name


Row = ("kind", "a", "c", "doc", "start", "n", "off")
ROW = "kind int, a long, c long, doc long, start long, n long, off long"
_ROW = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in Row[1:])])
NAMED, SPAN, ASK = 0, 1, 2


def _rows(kind: int, a, c, doc, start, n, off) -> pa.RecordBatch:
    columns = [np.full(len(doc), kind, np.int32), *(x.astype(U).view(np.int64) if x.dtype == U else x.astype(np.int64) for x in (a, c, doc, start, n, off))]
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, _ROW)], schema=_ROW)


def slices(texts: Iterator, tokens_of: Callable[[bytes], np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Documents' tokens in runs of about SLICE: their numbers, the tokens end to end, the lengths."""
    numbers, parts, size = [], [], 0
    for k, text in enumerate(texts):
        t = tokens_of(text.as_py() or b"")
        if len(t):
            numbers.append(k)
            parts.append(t)
            size += len(t)
        if size >= SLICE:
            yield numbers, np.concatenate(parts), np.array([len(x) for x in parts])
            numbers, parts, size = [], [], 0
    if parts:
        yield numbers, np.concatenate(parts), np.array([len(x) for x in parts])


def _later(doc: np.ndarray, start: np.ndarray, first: np.ndarray, within: bool) -> np.ndarray:
    """Whether a row comes after the first of its group: in a later document, or (within) later in the same one."""
    later = doc > doc[first]
    return later | ((doc == doc[first]) & (start > start[first])) if within else later


def _groups(*keys: np.ndarray) -> np.ndarray:
    """For rows sorted by keys: the index of the first row of each row's group."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def named(docs: DataFrame, tokens_of, window: int, gram: int, within: bool) -> DataFrame:
    """NAMED rows of all anchors; of equal names of one batch only the first goes on, later ones are SPAN rows at once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0).to_numpy(), []
            for numbers, tokens, lengths in slices(batch.column(1), tokens_of):
                doc, *rest = find_anchors(tokens, lengths, window, gram)
                found.append((ids[np.array(numbers)[doc]] if len(doc) else doc, *rest))
            if not found:
                continue
            doc, start, n, off, a, c = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((start, doc, c))
            doc, start, n, off, a, c = (x[order] for x in (doc, start, n, off, a, c))
            later = _later(doc, start, _groups(c), within)
            yield _rows(NAMED, *(x[~later] for x in (a, c, doc, start, n, off)))
            apart = mix(doc.astype(U) * U(0x9E3779B97F4A7C15) + start.astype(U))  # settled rows need no company
            yield _rows(SPAN, *(x[later] for x in (apart, c, doc, start, n, off)))

    return docs.mapInArrow(read, ROW)


def settle(rows: DataFrame, within: bool) -> DataFrame:
    """From NAMED rows (kind below 0: known from before, -1): SPAN rows for repeats, ASK rows where an anchor has several names, NAMED rows that are new to an index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), _ROW)
        if not len(table):
            return
        kind, a, c, doc, start, n, off = (table[x].to_numpy() for x in Row)
        spans = kind == SPAN
        if spans.any():
            yield _rows(SPAN, *(x[spans] for x in (a, c, doc, start, n, off)))
            kind, a, c, doc, start, n, off = (x[~spans] for x in (kind, a, c, doc, start, n, off))
        if not len(kind):
            return
        by_name, by_anchor = _groups(a, c), _groups(a)
        later = _later(doc, start, by_name, within)
        size = np.bincount(by_anchor, minlength=len(a))[by_anchor]
        mixed = np.zeros(len(a), bool)
        mixed[by_anchor[c != c[by_anchor]]] = True
        fresh = np.zeros(len(a), bool)
        fresh[by_anchor[kind == NAMED]] = True  # groups with a row that is not known from before
        new = (kind == NAMED) & (np.arange(len(a)) == by_name)
        yield _rows(NAMED, *(x[new] for x in (a, c, doc, start, n, off)))
        repeat = later & (kind == NAMED)
        yield _rows(SPAN, *(x[repeat] for x in (a, c, doc, start, n, off)))
        ask = ~later & mixed[by_anchor] & fresh[by_anchor]
        hot = (size > HOT).astype(np.int64)
        yield _rows(ASK, *(x[ask] for x in (a, hot, doc, start, n, off)))

    return rows.repartition("a").sortWithinPartitions("a", "c", "doc", "start").mapInArrow(read, ROW)


def one_by_one(asked: DataFrame, docs: DataFrame, tokens_of, window: int, within: bool, payload, unfold, scratch: Scratch) -> DataFrame:
    """SPAN rows for the single windows of ASK rows that repeat an earlier one of the same anchor.

    payload(hashes, tokens, start, n) -> bytes gives what is shuffled of an ASK
    row, unfold(payloads, n) -> hashes the windows' hashes from that. Windows
    at different places of the anchor never match, so a hot anchor's rows go
    to several tasks, each with its share of the places.
    """
    per_doc = asked.groupBy("doc").agg(F.collect_list(F.struct("a", "c", "start", "n", "off")).alias("asked"))
    per_doc = scratch.save(per_doc, "asked")
    few = docs.join(_ids(per_doc, scratch), "doc_id", "left_semi")
    joined = few.join(per_doc, few.doc_id == per_doc.doc).select("doc_id", "text", "asked")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, asks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                tokens = tokens_of(text.as_py() or b"")
                hashes = None
                for x in asks:
                    if x["start"] + x["n"] + window - 1 > len(tokens):
                        continue  # another text under the same doc_id
                    hashes, data = payload(hashes, tokens, text, x["start"], x["n"])
                    for salt in range(SALTS if x["c"] else 1):
                        rows.append((x["a"], salt if x["c"] else -1, doc, x["start"], x["n"], x["off"], data))
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, [pa.int64()] * 6 + [pa.binary()])], names=["a", "salt", "doc", "start", "n", "off", "data"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        for at in _anchor_cuts(table["a"].to_numpy(), 1 << 15):
            part = table.slice(*at)
            a, salt, doc, start, n, off = (part[x].to_numpy() for x in ("a", "salt", "doc", "start", "n", "off"))
            h = unfold(part["data"], n)
            row = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            place = off[row] - k
            mine = (salt[row] < 0) | (np.mod(place, SALTS) == salt[row])
            row, k, place, h = (x[mine] for x in (row, k, place, h))
            order = np.lexsort((start[row] + k, doc[row], h, place, a[row]))
            row, k, place, h = (x[order] for x in (row, k, place, h))
            later = _later(doc[row], start[row] + k, _groups(a[row], place, h), within)
            one = np.ones(int(later.sum()), np.int64)
            d, s = doc[row][later], (start[row] + k)[later]
            yield _rows(SPAN, one, one, d, s, one, one)

    return joined.mapInArrow(read, "a long, salt long, doc long, start long, n long, off long, data binary").repartition("a", "salt").sortWithinPartitions("a", "salt").mapInArrow(compare, ROW)


def _anchor_cuts(a: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of stretches of about so many rows that don't part an anchor's rows."""
    at = 0
    while at < len(a):
        to = min(at + rows, len(a))
        while to < len(a) and a[to] == a[to - 1]:
            to += 1
        yield at, to - at
        at = to


def merged(spans: DataFrame, window: int) -> DataFrame:
    """(doc, spans): per document the maximal runs [from, to) that SPAN rows cover, as one list of numbers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, runs, out = None, [], ([], [])
        for batch in batches:
            for d, s, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                e = s + n - 1 + window
                if d != doc:
                    if runs:
                        out[0].append(doc)
                        out[1].append(runs)
                    doc, runs = d, [s, e]
                elif s <= runs[-1]:
                    runs[-1] = max(runs[-1], e)
                else:
                    runs += [s, e]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64()))], names=["doc", "spans"])
            out = ([], [])
        if runs:
            yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([runs], pa.list_(pa.int64()))], names=["doc", "spans"])

    return spans.select("doc", "start", "n").repartition("doc").sortWithinPartitions("doc", "start").mapInArrow(read, "doc long, spans array<long>")


def _ids(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The doc_ids of rows (one each), to be broadcast where they are few enough; then texts are shuffled only where they are asked for."""
    ids = scratch.save(rows.select(F.col("doc").alias("doc_id")), "ids")
    return bounded_broadcast(ids, ids.count(), BROADCAST_IDS)


def with_spans(docs: DataFrame, spans: DataFrame, scratch: Scratch) -> DataFrame:
    """docs (doc_id, text) with their spans, null where there are none."""
    ids = _ids(spans, scratch)
    touched = docs.join(ids, "doc_id", "left_semi")
    touched = touched.join(spans, touched.doc_id == spans.doc).select("doc_id", "text", "spans")
    rest = docs.join(ids, "doc_id", "left_anti").select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("spans"))
    return touched.unionByName(rest)


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id as long and the whole text as UTF-8 bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("text"))
