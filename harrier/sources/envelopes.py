"""Scan envelopes: a data source for lines of bounded length, in batch and as a stream, and the rows that the lines hold.

A scan's file is NDJSON from a host that isn't trusted. Lines are cut while they
are read: of one that is too long no more than the bound is ever held, whatever
its length. A file ends for the reader at its bound of lines or bytes, and that is told by a row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "bounded_lines"
SCHEMA = "file string, at long, line string, error string"
# The bounds of a scan's file
MOST_LINE, MOST_LINES, MOST_BYTES = 256 * 1024, 2_000_000, 64 * 1024 * 1024
TOO_LONG, TOO_MANY, TOO_LARGE, BROKEN = "line too long", "max lines exceeded", "max bytes exceeded", "compressed data broken"
CHUNK = 1 << 20
COMPRESSED = (".gz", ".bz2", ".zst")
# Files share a task up to so many bytes, where opening one counts as OPEN
PACK, OPEN = 64 << 20, 1 << 20


@dataclass
class Limits:
    line: int = MOST_LINE
    lines: int = MOST_LINES
    bytes: int = MOST_BYTES

    @classmethod
    def of(cls, options: dict) -> "Limits":
        return cls(*(int(options.get(n, d)) for n, d in (("maxline", MOST_LINE), ("maxlines", MOST_LINES), ("maxbytes", MOST_BYTES))))


def bounded(chunks: Iterator[bytes], limits: Limits, at: int = 0) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(place, line, error) of the lines that aren't empty; ``at`` is the place of the first byte. It holds one chunk and a line of the bound at most."""
    start, held, skipping, n, total = at, b"", False, 0, at
    for chunk in chunks:
        pos = 0
        while pos < len(chunk):
            end = chunk.find(b"\n", pos)
            part = chunk[pos : end if end >= 0 else len(chunk)]
            if not skipping:
                if len(held) + len(part) > limits.line:
                    skipping, held = True, b""
                else:
                    held += part
            total += len(part)
            if end < 0:
                break
            for row in _ended(start, held, skipping):
                n += 1
                if n > limits.lines:
                    yield start, None, TOO_MANY
                    return
                if total > limits.bytes:
                    yield start, None, TOO_LARGE
                    return
                yield row
            pos, total = end + 1, total + 1
            start, held, skipping = total, b"", False
    for row in _ended(start, held, skipping):
        yield (start, None, TOO_MANY) if n >= limits.lines else (start, None, TOO_LARGE) if total > limits.bytes else row


def _ended(start: int, held: bytes, skipping: bool):
    if skipping:
        yield start, None, TOO_LONG
    elif held.removesuffix(b"\r"):
        yield start, held.removesuffix(b"\r"), None


@dataclass
class Piece:
    """Bytes ``begin`` up to ``end`` of a file; end -1: all there is."""

    file: str
    begin: int = 0
    end: int = -1


@dataclass
class Pack(InputPartition):
    """Pieces that one task reads."""

    pieces: list[Piece]


def _packed(sized: list[tuple[Piece, int]]) -> list[Pack]:
    """The pieces, each with its bytes, in order, as packs."""
    packs, room = [], 0
    for piece, size in sized:
        if size + OPEN > room:
            packs.append(Pack([]))
            room = PACK
        packs[-1].pieces.append(piece)
        room -= size + OPEN
    return packs


class _Files:
    def __init__(self, options: dict):
        self.path, self.limits = options["path"], Limits.of(options)

    def sizes(self) -> dict[str, int]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        hidden = lambda p: any(x.startswith(("_", ".")) for x in p.removeprefix(path).split("/"))
        return {f.path: f.size for f in found if f.type == fs.FileType.File and not hidden(f.path)}

    def read(self, pack: Pack | None) -> Iterator[tuple]:
        from pyarrow import fs

        if pack is None:  # what Spark reads where there are no files
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        for piece in pack.pieces:
            at = piece.begin
            try:
                for at, line, error in bounded(self._chunks(system, piece), self.limits, piece.begin):
                    yield piece.file, at, None if line is None else line.decode("utf-8", "replace"), error
            except OSError:
                if not piece.file.endswith(COMPRESSED):
                    raise
                yield piece.file, at, None, BROKEN

    @staticmethod
    def _chunks(system, piece: Piece) -> Iterator[bytes]:
        if piece.file.endswith(COMPRESSED):
            with system.open_input_stream(piece.file) as f:  # decompresses by the name's end
                while part := f.read(CHUNK):
                    yield part
            return
        with system.open_input_file(piece.file) as f:
            f.seek(piece.begin)
            at = piece.begin
            while part := f.read(CHUNK if piece.end < 0 else min(CHUNK, piece.end - at)):
                at += len(part)
                yield part


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def partitions(self):
        return _packed([(Piece(f), size) for f, size in sorted(self.files.sizes().items())])

    def read(self, partition):
        yield from self.files.read(partition)


class _StreamReader(DataSourceStreamReader):
    """An offset is how far each file has been read: after a line feed, so that a line still being written waits for its end. Compressed files are read once and whole."""

    def __init__(self, options: dict):
        self.files = _Files(options)

    def initialOffset(self):
        return {}

    def _last_line_end(self, file: str, size: int) -> int:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.files.path)
        with system.open_input_file(file) as f:
            begin = max(0, size - self.files.limits.line - 1)
            f.seek(begin)
            return begin + f.read(size - begin).rfind(b"\n") + 1 if size else 0

    def latestOffset(self, *_):
        out = {}
        for file, size in self.files.sizes().items():
            if file.endswith(COMPRESSED):
                out[file] = size
                continue
            end = self._last_line_end(file, size)
            out[file] = end if end > max(0, size - self.files.limits.line - 1) or end == size else 0
        return out

    def partitions(self, start, end):
        whole = lambda f: f.endswith(COMPRESSED)
        new = [(f, start.get(f, 0), to) for f, to in sorted(end.items()) if to > start.get(f, 0) and not (whole(f) and f in start)]
        return _packed([(Piece(f) if whole(f) else Piece(f, begin, to), to - begin) for f, begin, to in new])

    def read(self, partition):
        yield from self.files.read(partition)

    def commit(self, end):
        pass


class BoundedLines(DataSource):
    """``spark.read.format("bounded_lines").load(path)``: file, at (the line's first byte), line, error; small files share a task, none is split.

    Options maxLine (262,144 bytes), maxLines (2,000,000) and maxBytes (67,108,864) bound
    a file. An overlong line is a row with an error and no line; beyond the other bounds one
    row tells so and the file ends. Empty lines are skipped, bytes that aren't
    UTF-8 are replaced. Files named .gz, .bz2 or .zst are decompressed chunk by chunk, and bounds and places
    are those of the text; where such data is broken, a row tells so and the file ends. As a stream, files may grow; a line counts once its line feed is there, a line
    that is longer than the bound once another line follows, and maxLines counts within a micro-batch;
    compressed files must be put there whole.
    Paths are those that pyarrow opens.
    """

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema):
        return _Reader(self._options())

    def streamReader(self, schema):
        return _StreamReader(self._options())


def _options(limits: Limits | None) -> dict:
    limits = limits or Limits()
    return {"maxLine": limits.line, "maxLines": limits.lines, "maxBytes": limits.bytes}


def read_envelopes(spark: SparkSession, path: str, limits: Limits | None = None) -> DataFrame:
    """Envelopes of the files below the path: see ``envelopes``."""
    spark.dataSource.register(BoundedLines)
    return envelopes(spark.read.format(NAME).options(**_options(limits)).load(path))


def stream_envelopes(spark: SparkSession, path: str, limits: Limits | None = None) -> DataFrame:
    spark.dataSource.register(BoundedLines)
    return envelopes(spark.readStream.format(NAME).options(**_options(limits)).load(path))


# The kinds of envelopes
KINDS = ("hello", "obs", "collector_status", "summary", "error")


def envelopes(lines: DataFrame) -> DataFrame:
    """(file, at, kind, v, error): each line parsed once. A line that is cut, no JSON or of no known kind is an envelope ``error`` of code ``framing``."""
    v = F.try_parse_json("line")
    kind = F.try_variant_get("v", "$.kind", "string")
    out = lines.withColumn("v", v).withColumn("error", F.coalesce("error", F.when(F.col("v").isNull(), "no JSON").when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "unknown kind")))
    return out.select("file", "at", F.when(F.col("error").isNull(), kind).otherwise("error").alias("kind"), "v", "error")


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("v", f"$.{path}", kind)


def observation_lines(rows: DataFrame) -> DataFrame:
    """(file, at, collector, n, line): observations, each as a line of JSON that ``observations.parsed`` reads."""
    return rows.where("kind = 'obs'").select("file", "at", _get("c", "string").alias("collector"), _get("n", "long").alias("n"), F.to_json(F.variant_get("v", "$.d", "variant")).alias("line"))


def hellos(rows: DataFrame) -> DataFrame:
    caps = ("memfd_create", "statx", "sock_diag", "bpf_prog_iter", "map_files", "cgroup_v2", "kallsyms_readable", "tracefs_readable", "proc_sched_debug", "audit_netlink", "proc_exe_readable")
    fields = {"schema": "int", "probe_version": "string", "arch": "string", "kernel": "string", "boot_id": "string", "euid": "long", "pid": "int", "nonce": "string"}
    able = F.filter(F.array(*(F.when(_get(f"caps.{c}", "boolean"), F.lit(c)) for c in caps)), lambda c: c.isNotNull())
    return rows.where("kind = 'hello'").select("file", "at", *(_get(n, t).alias(n) for n, t in fields.items()), able.alias("caps"))


def collector_statuses(rows: DataFrame) -> DataFrame:
    stats = [_get(f"stats.{n}", "long").alias(n) for n in ("observations", "bytes_read", "elapsed_ms")]
    return rows.where("kind = 'collector_status'").select("file", "at", _get("c", "string").alias("collector"), _get("status", "string").alias("status"), _get("reason", "string").alias("reason"), *stats)


def summaries(rows: DataFrame) -> DataFrame:
    numbers = [_get(n, "long").alias(n) for n in ("observation_count", "bytes_out", "elapsed_ms")]
    return rows.where("kind = 'summary'").select("file", "at", _get("outcome", "string").alias("outcome"), *numbers)


def errors(rows: DataFrame) -> DataFrame:
    """Errors that the scan tells of, and those of its lines (code framing)."""
    code = F.when(F.col("error").isNotNull(), "framing").otherwise(_get("code", "string"))
    return rows.where("kind = 'error'").select("file", "at", _get("c", "string").alias("collector"), code.alias("code"), F.coalesce("error", _get("msg", "string")).alias("msg"))


def scans(rows: DataFrame) -> DataFrame:
    """(file, outcome, told, observations, errors, complete): one row per file; complete: it has a summary whose number of observations came, and no framing error."""
    is_ = lambda k: F.col("kind") == k
    framing = F.count(F.when(F.col("error").isNotNull(), 1))
    out = rows.groupBy("file").agg(F.max(F.when(is_("summary"), _get("outcome", "string"))).alias("outcome"), F.max(F.when(is_("summary"), _get("observation_count", "long"))).alias("told"), F.count(F.when(is_("obs"), 1)).alias("observations"), F.count(F.when(is_("error"), 1)).alias("errors"), framing.alias("_framing"))
    return out.withColumn("complete", F.coalesce((F.col("told") == F.col("observations")) & (F.col("_framing") == 0), F.lit(False))).drop("_framing")
