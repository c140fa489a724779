"""Removal of bytes that earlier text has already, by repeated strings of a fixed length.

The sorted order of all suffixes would say for each one whether its first 100
bytes stand elsewhere, but a difference cover by residues keeps two suffixes in
three at its first level and shuffles many times the input. Here the sampled
positions are chosen by content: equal strings of 100 bytes hold a sampled
position at the same place, as they would share one in a difference cover.
Sampled strings are sorted and named, the names settle whole runs of suffixes,
suffixes between differing names are named in a second round, and neighbours
in each sorted order are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors
from .common import Scratch

BYTE_CODES = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
FULL = DIGEST + ", kept binary"


def byte_tokens(text: bytes) -> np.ndarray:
    return BYTE_CODES[np.frombuffer(text, np.uint8)]


def repeated_byte_spans(docs: DataFrame, window: int, gram: int, scratch: Scratch) -> DataFrame:
    """(doc, spans): what strings of ``window`` bytes that also start earlier cover. docs: doc_id, text as bytes."""
    usable = docs.where("doc_id IS NOT NULL")
    rows = anchors.named(usable, byte_tokens, window, gram, within=True)
    first = scratch.save(anchors.settle(rows, within=True).where(f"kind <> {anchors.NAMED}"), "settled")

    def payload(hashes, tokens, text, start, n):
        return None, text.as_buffer().slice(start, n + window - 1).to_pybytes()

    def unfold(data: pa.ChunkedArray, n: np.ndarray) -> np.ndarray:
        joined = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
        h = anchors.Hashes(BYTE_CODES[joined])
        at = np.repeat(np.cumsum(n + window - 1) - (n + window - 1), n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return h(at, at + window)

    second = anchors.one_by_one(first.where(f"kind = {anchors.ASK}"), usable, byte_tokens, window, True, payload, unfold, scratch)
    spans = first.where(f"kind = {anchors.SPAN}").unionByName(second)
    return scratch.save(anchors.merged(spans, window), "spans")


def remove_repeated_bytes(docs: DataFrame, window: int = 100, gram: int = 32, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and on request kept, the remaining bytes) for every row of docs.

    A byte goes if a string of ``window`` bytes covers it that also starts in a
    document with a smaller doc_id, or earlier in its own. Null texts are
    empty; texts shorter than ``window`` stay. doc_ids are taken as unique:
    rows that repeat one with the same text are one document, and all stay or
    lose the same. Documents without a doc_id neither lose bytes nor make
    others lose any. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "bytes")
    own = anchors.encoded(docs)
    spans = repeated_byte_spans(own, window, gram, scratch)
    return anchors.with_spans(own, spans, scratch).mapInArrow(_cut(texts), FULL if texts else DIGEST)


def _cut(texts: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                b, s = text.as_py(), spans.as_py() or []
                kept, at, removed = [], 0, 0
                for x, y in zip(s[::2], s[1::2]):
                    y = min(y, len(b))
                    kept.append(b[at:x])
                    removed += max(0, y - x)
                    at = y
                rest = b"".join([*kept, b[at:]])
                out.append((len(b), removed, len(s) // 2, hashlib.sha256(rest).hexdigest(), rest))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = [pa.array(v, t) for v, t in zip(zip(*out) if out else [[]] * 5, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns[: 5 if texts else 4]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if texts else 5])

    return read
