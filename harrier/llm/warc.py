"""WARC archives with Zstandard-compressed records and a shared dictionary.

Each file is ``.warc.zst``: a skippable frame (magic 0x184D2A5D) that holds the
dictionary, then one Zstandard frame per record, so a reader can seek to any
record. Equal payloads are stored once: others are revisit records.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample, make_folder

# Fixed values of the formats
DICTIONARY_MAGIC = 0x184D2A5D
SAMPLED_BYTES = 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

FIELDS = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]


def plan_records(pages: DataFrame, scratch: Scratch, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1 (hex), refers_to (null for responses).

    A null html is an empty payload. Of the pages with equal payloads of at
    least ``least_bytes`` bytes the largest page_id is the response (all rows
    that have it), the others revisit it; a null page_id counts as smallest.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("sha1", F.sha1("payload"))
    first = own.where(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    first = scratch.save(first.drop("n").withColumnRenamed("sha1", "k"), "responses")
    joined = own.join(first, own.sha1 == first.k, "left")
    return joined.select("page_id", "url", "payload", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to"))


def train_dictionary(records: list[bytes], size: int = 65536) -> bytes:
    """A Zstandard dictionary, or b"" where the samples are too few for one."""
    try:
        return zstandard.train_dictionary(size, records).as_bytes() if len(records) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    name = lambda i: f"<urn:x-page:{'null' if i is None else i}>"
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else name(page_id)[1:-1]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        *([f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    number = lambda x: None if x is None or x == "<urn:x-page:null>" else int(x[len("<urn:x-page:") : -1])
    kind = fields["WARC-Type"]
    return number(fields["WARC-Record-ID"]), n, fields["WARC-Payload-Digest"].removeprefix("sha1:"), kind, number(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"], payload if kind == "response" else None


def write_archives(records: DataFrame, folder: str, scratch: Scratch, file_bytes: int = 8 << 20, sample: int = 1000, dictionary_bytes: int = 65536) -> DataFrame:
    """Write the records into files of about ``file_bytes`` under ``folder``; the manifest (file, n_records, n_bytes).

    The dictionary is fitted on about ``sample`` records, picked by their
    hashes, and on no more than the first 64 KB of each; every record is written whole. File names carry the task
    attempt, so an attempt that was lost leaves files no manifest names.
    """
    target = make_folder(records.sparkSession, folder)
    picked = bounded_sample(records, sample, "page_id", "sha1").withColumn("payload", F.substring("payload", 1, SAMPLED_BYTES)).collect()
    dictionary = train_dictionary([record(*x) for x in picked], dictionary_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=shared)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        parts, size, n, files = [lead], len(lead), 0, []

        def close():
            nonlocal parts, size, n
            if n:
                file = f"{context.partitionId():06d}-{context.taskAttemptId()}-{len(files):05d}.warc.zst"
                with store.open_output_stream(f"{root}/{file}", compression=None) as out:
                    out.write(b"".join(parts))
                files.append((file, n, size))
            parts, size, n = [lead], len(lead), 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                parts.append(packer.compress(record(*row)))
                size += len(parts[-1])
                n += 1
                if size >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pydict({"file": pa.array([f[0] for f in files], pa.string()), "n_records": pa.array([f[1] for f in files], pa.int64()), "n_bytes": pa.array([f[2] for f in files], pa.int64())})

    return scratch.save(records.mapInArrow(write, "file string, n_records long, n_bytes long"), "manifest")


def frames(content: bytes) -> Iterator[bytes]:
    """The records of one archive file."""
    magic, length = struct.unpack_from("<II", content)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame leads the file")
    shared = zstandard.ZstdCompressionDict(content[8 : 8 + length]) if length else None
    reader, at, view = zstandard.ZstdDecompressor(dict_data=shared), 8 + length, memoryview(content)
    while at < len(content):
        step, one, got = 1 << 14, reader.decompressobj(), []
        while not one.eof:
            chunk = view[at : at + step]
            if not len(chunk):
                raise ValueError("the file ends inside a record")
            got.append(one.decompress(chunk))
            at += len(chunk) - len(one.unused_data)
        yield b"".join(got)


def read_archives(folder: str, manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Rows of all records in the manifest's files; payload only on request (null for revisits)."""
    names = [f for f in FIELDS if payloads or f[0] != "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [parse_record(x)[: len(names)] for x in frames(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * len(names), names)], names=[n for n, _ in names])

    kind = {"int64": "long", "string": "string", "binary": "binary"}
    spark = manifest.sparkSession
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content")
    return files.join(manifest.select("file"), "file", "left_semi").select("content").mapInArrow(read, ", ".join(f"{n} {kind[str(t)]}" for n, t in names))


def archive_pages(pages: DataFrame, least_bytes: int = 0, folder: str | None = None, **how) -> tuple[str, DataFrame]:
    """Write all pages as WARC records; the folder and the manifest.

    Pages need page_id, url, html; other columns are ignored. Rows that repeat
    are records of their own; null urls get the record's own URI. Without pages
    there is no file.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = folder or scratch.path("archive")
    return folder, write_archives(plan_records(pages, scratch, least_bytes), folder, scratch, **how)
