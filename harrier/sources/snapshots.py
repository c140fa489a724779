"""A folder's snapshots: numbered JSON files, each written whole under its name or not at all; the greatest number counts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from harrier.storage import _file_system


class Conflict(RuntimeError):
    """Another writer committed first; read the latest snapshot and try again."""


class Snapshots:
    """What a table consists of. Writers put their files first and commit last, so readers see the table before or after, never between."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = f"{self.root}/_snapshots"

    def latest(self) -> tuple[int, dict]:
        """(number, content); (0, {}) before the first commit."""
        fs, folder = _file_system(self.spark, self.folder)
        if not fs.exists(folder):
            return 0, {}
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        number = max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
        return (number, self.read(number)) if number else (0, {})

    def read(self, number: int) -> dict:
        fs, path = _file_system(self.spark, f"{self.folder}/{number:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, after: int, content: dict, keep: int = 20) -> int:
        """Make content the snapshot after number ``after``; raises Conflict if there is one already. The newest ``keep`` stay."""
        jvm = self.spark._jvm
        fs, part = _file_system(self.spark, f"{self.folder}/.{uuid.uuid4().hex}")
        stream = fs.create(part, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        _, whole = _file_system(self.spark, f"{self.folder}/{after + 1:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(part), fs.makeQualified(whole), options)  # refuses to replace a file
        except Exception as e:
            fs.delete(part, False)
            if fs.exists(whole):
                raise Conflict(f"snapshot {after + 1} of {self.root} was committed by another writer") from e
            raise
        old = after + 1 - keep
        if old > 0:
            fs.delete(_file_system(self.spark, f"{self.folder}/{old:012d}.json")[1], False)
        return after + 1

    def change(self, how, tries: int = 10) -> int:
        """Commit ``how(content)`` on top of the latest snapshot, again after each conflict; it must only add to or take from what it is given."""
        for _ in range(tries):
            number, content = self.latest()
            try:
                return self.commit(number, how(content))
            except Conflict:
                continue
        raise Conflict(f"{self.root}: {tries} writers came first")

    def delete(self, *paths: str) -> None:
        for p in paths:
            fs, path = _file_system(self.spark, f"{self.root}/{p}")
            fs.delete(path, True)
