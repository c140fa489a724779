"""Incremental substring removal over a log-structured index of window fingerprints.

The index is a set of immutable runs: bucketed Parquet tables of anchor
fingerprints and the names of their windows, sorted by both. A new batch is
merge-joined with every run: an equal fingerprint is a candidate, the name, a
hash of all the words that its windows cover, verifies it. What is new becomes
one more run, and runs of one level are compacted into one of the next.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrier.sources.snapshots import Snapshots

from . import anchors
from .common import Scratch, make_folder

DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
FULL = DIGEST + ", kept string"
COLUMNS = ["a", "c", "doc", "start", "n", "off"]


def word_tokens(text: bytes) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in text.split()], np.uint64) * np.uint64(2) + np.uint64(1)


class FingerprintIndex:
    """A log-structured index in a folder. ``add`` gives the repeated spans of a batch and takes the batch in.

    Every run is a Parquet table of ``buckets`` hash buckets by fingerprint,
    sorted within each. A batch is merge-joined with each run bucket by bucket:
    only the batch's fingerprints are shuffled, and of the history only rows
    that share one leave their bucket. Runs have levels: ``fan`` runs of one
    level are merged into one of the next, so a row is written again only
    with the logarithm of the number of batches. The folder's newest snapshot
    names the runs and is committed last: another session that opens the
    folder goes on from there, and a batch that failed half-way isn't in.

    Batches come in the order of doc_id; one that doesn't follow all those
    taken in before is refused. ``history`` must hold the texts of all, as
    windows at the ends of matches are verified one by one. ``fan`` and
    ``buckets`` count when the folder is new; buckets is as many as Spark's
    shuffle partitions if not given, and should rise with the history that is
    expected, as one bucket is one task.
    """

    def __init__(self, scratch: Scratch, root: str, window: int = 50, gram: int = 8, fan: int = 4, buckets: int | None = None):
        self.scratch, self.spark, self.root = scratch, scratch.spark, root.rstrip("/")
        self.snapshots = Snapshots(self.spark, make_folder(self.spark, self.root))
        self.at, self.content = self.snapshots.latest()
        if not self.content:
            self.content = {"window": window, "gram": gram, "fan": fan, "buckets": buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions")), "last": None, "runs": []}
        if (self.content["window"], self.content["gram"]) != (window, gram):
            raise ValueError(f"{root} is an index of windows of {self.content['window']} and grams of {self.content['gram']}")
        self.window, self.gram = window, gram

    def add(self, batch: DataFrame, history: DataFrame) -> DataFrame:
        """SPAN rows of the batch. batch, history: doc_id, text as bytes; history includes the batch."""
        window = self.window
        first, last = batch.agg(F.min("doc_id"), F.max("doc_id")).first()
        if first is None:
            return self.spark.createDataFrame([], "doc long, start long, n long")
        if self.content["last"] is not None and first <= self.content["last"]:
            raise ValueError(f"the batch starts at doc_id {first}, the index holds documents to {self.content['last']}")
        fresh = self.scratch.save(anchors.named(batch, word_tokens, window, self.gram, within=False), "named")
        rows, asking = fresh, fresh.where(f"kind = {anchors.NAMED}").select("a")
        for run in self.content["runs"]:
            known = self.run(run["name"]).join(asking.hint("merge"), "a", "left_semi")
            rows = rows.unionByName(known.select(F.lit(-1).alias("kind"), *COLUMNS))
        settled = self.scratch.save(anchors.settle(rows, within=False), "settled")
        self.scratch.drop(fresh)

        def payload(hashes, tokens, text, start, n):
            hashes = anchors.Hashes(tokens) if hashes is None else hashes
            at = np.arange(start, start + n)
            return hashes, hashes(at, at + window).tobytes()

        def unfold(data: pa.ChunkedArray, n: np.ndarray) -> np.ndarray:
            return np.frombuffer(b"".join(data.to_pylist()), np.uint64)

        asked = settled.where(f"kind = {anchors.ASK}")
        ends = anchors.one_by_one(asked, history, word_tokens, window, False, payload, unfold, self.scratch)
        spans = settled.where(f"kind = {anchors.SPAN}").unionByName(ends.where(F.col("doc") >= F.lit(first)))
        found = self.scratch.save(spans.select("doc", "start", "n"), "repeats")
        self._append(settled.where(f"kind = {anchors.NAMED}"), last)
        self.scratch.drop(settled)
        return found

    def run(self, name: str) -> DataFrame:
        """A run as a bucketed table; the session's catalog is told of it where it doesn't know it."""
        self.spark.sql(f"""CREATE TABLE IF NOT EXISTS {name} (a BIGINT, c BIGINT, doc BIGINT, start BIGINT, n BIGINT, off BIGINT) USING parquet
            CLUSTERED BY (a) SORTED BY (a, c, doc, start) INTO {self.content["buckets"]} BUCKETS LOCATION '{self.snapshots.root}/{name}'""")
        return self.spark.table(name)

    def _write(self, rows: DataFrame) -> str:
        name = f"harrier_run_{uuid.uuid4().hex}"
        n = self.content["buckets"]
        out = rows.select(*COLUMNS).repartition(n, "a").write.bucketBy(n, "a").sortBy("a", "c", "doc", "start")
        out.option("path", f"{self.snapshots.root}/{name}").saveAsTable(name)
        return name

    def _append(self, rows: DataFrame, last: int) -> None:
        self._commit([*self.content["runs"], {"name": self._write(rows), "level": 0}], last)
        while full := self._full_level():
            whole = self.run(full[0]["name"])
            for run in full[1:]:
                whole = whole.unionByName(self.run(run["name"]))
            least = whole.groupBy("a", "c", "n", "off").agg(F.min(F.struct("doc", "start")).alias("first"))
            merged = self._write(least.select("a", "c", "first.doc", "first.start", "n", "off"))
            self._commit([r for r in self.content["runs"] if r not in full] + [{"name": merged, "level": full[0]["level"] + 1}], last)
            self._forget(full, delete=True)

    def _full_level(self) -> list[dict]:
        """The runs of the lowest level that has ``fan`` of them, else none."""
        runs = self.content["runs"]
        for level in sorted({r["level"] for r in runs}):
            same = [r for r in runs if r["level"] == level]
            if len(same) >= self.content["fan"]:
                return same
        return []

    def _commit(self, runs: list[dict], last: int) -> None:
        content = {**self.content, "runs": runs, "last": last}
        self.at = self.snapshots.commit(self.at, content)
        self.content = content

    def _forget(self, runs: list[dict], delete: bool) -> None:
        for r in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {r['name']}")
            if delete:
                self.snapshots.delete(r["name"])

    def close(self, delete: bool = False) -> None:
        """Take the runs out of the session's catalog; with ``delete`` their files go too."""
        self._forget(self.content["runs"], delete)


def remove_repeated_words(docs: DataFrame, window: int = 50, gram: int = 8, batches: int = 3, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and on request kept, the remaining words) for every row of docs.

    A word goes if a window of ``window`` words covers it whose words also start
    in a document with a smaller doc_id. The documents go through the index in
    ``batches`` ranges of doc_id. Null texts have no words. doc_ids are taken
    as unique: rows that repeat one with the same text are one document.
    Documents without a doc_id neither lose words nor make others lose any.
    Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "words")
    own = anchors.encoded(docs)
    usable = own.where("doc_id IS NOT NULL")
    cuts = usable.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)] or [1.0], 1000)).first()[0] or []
    bounds = [None, *sorted(set(cuts[: batches - 1])), None]
    index, spans = FingerprintIndex(scratch, f"{scratch.root}/index", window, gram, fan=2), []
    for low, high in zip(bounds, bounds[1:]):
        part = usable if low is None else usable.where(F.col("doc_id") > low)
        part = part if high is None else part.where(F.col("doc_id") <= high)
        if part.isEmpty():
            continue
        known = usable if high is None else usable.where(F.col("doc_id") <= high)
        spans.append(index.add(part, known))
    index.close(delete=True)
    found = docs.sparkSession.createDataFrame([], "doc long, start long, n long")
    for s in spans:
        found = found.unionByName(s)
    merged = scratch.save(anchors.merged(found, window), "spans")
    return anchors.with_spans(own, merged, scratch).mapInArrow(_cut(texts), FULL if texts else DIGEST)


def _cut(texts: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                words, s = text.as_py().split(), spans.as_py() or []
                kept, at, removed = [], 0, 0
                for x, y in zip(s[::2], s[1::2]):
                    y = min(y, len(words))
                    kept += words[at:x]
                    removed += max(0, y - x)
                    at = y
                rest = b" ".join(kept + words[at:])
                out.append((len(words), removed, hashlib.sha256(rest).hexdigest(), rest.decode() if texts else ""))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(v, t) for v, t in zip(zip(*out) if out else [[]] * 4, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns[: 4 if texts else 3]], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 5 if texts else 4])

    return read
