"""Tables of rows by key of which the newest version counts: upserts and deletes are small files, merged on read and compacted later.

A cell is a day and a bucket of keys. Each cell has one base folder; changes lie in
delta folders, by the same cells, until a compaction rewrites the cells that they touch. A
snapshot names the folders that make up the table and is swapped last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .snapshots import Conflict, Snapshots

BROADCAST_BYTES = 64 << 20
_EXTRA = {"_deleted": "boolean", "_seq": "long"}


class VersionedTable:
    """``schema``: the rows' columns, with ``keys`` and ``version``. ``day``, a date column if any, belongs to the key: a key never moves to another day.

    Of the versions of a key the greatest counts, of equal ones the one written last,
    of equal ones in one write any. A delete is a version too: later ones bring the key back.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], version: str, day: str | None = None, buckets: int = 16, most_deltas: int = 32):
        self.spark, self.snapshots, self.keys, self.version, self.day = spark, Snapshots(spark, root), keys, version, day
        self.schema, self.buckets, self.most_deltas = T.StructType.fromDDL(schema), buckets, most_deltas

    # -- writing

    def _cells(self, rows: DataFrame) -> DataFrame:
        day = F.col(self.day).cast("string") if self.day else F.lit("all")
        return rows.withColumns({"_day": F.coalesce(day, F.lit("none")), "_bucket": F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")})

    def _put(self, rows: DataFrame, folder: str) -> None:
        rows.repartition("_day", "_bucket").sortWithinPartitions("_day", "_bucket", *self.keys).write.partitionBy("_day", "_bucket").parquet(f"{self.snapshots.root}/{folder}")

    def _write_delta(self, rows: DataFrame, deleted: bool) -> None:
        whole = self.spark.createDataFrame([], self.schema).unionByName(rows.select(*(c for c in self.schema.names if c in rows.columns)), allowMissingColumns=True)
        name = f"part=delta-{uuid.uuid4().hex}"
        self._put(self._cells(whole).withColumns({"_deleted": F.lit(deleted), "_seq": F.lit(0).cast("long")}), name)
        self.snapshots.change(lambda c: {**c, "deltas": [*c.get("deltas", []), {"folder": name, "seq": c.get("seq", 0) + 1}], "seq": c.get("seq", 0) + 1})
        if len(self.snapshots.latest()[1]["deltas"]) > self.most_deltas:
            self.compact()

    def upsert(self, rows: DataFrame) -> None:
        self._write_delta(rows, False)

    def delete(self, keys: DataFrame) -> None:
        """keys: the key columns, and the version from which on they are gone."""
        self._write_delta(keys, True)

    # -- reading

    def _folder(self, names: list[str]) -> DataFrame:
        schema = T.StructType([*self.schema, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in _EXTRA.items()), T.StructField("part", T.StringType()), T.StructField("_day", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        root = self.snapshots.root
        return self.spark.read.schema(schema).option("basePath", f"{root}/").parquet(*(f"{root}/{n}" for n in names)) if names else self.spark.createDataFrame([], schema)

    def _base(self, content: dict) -> DataFrame:
        by_folder: dict[str, list[str]] = {}
        for cell, folder in content.get("base", {}).items():
            by_folder.setdefault(folder, []).append(cell)
        whole = [f for f, cells in by_folder.items() if content["cells"][f] == len(cells)]
        valid = F.col("part").isin([f.removeprefix("part=") for f in whole])
        for folder in by_folder.keys() - set(whole):  # some of its cells were rewritten since
            valid |= (F.col("part") == folder.removeprefix("part=")) & F.concat_ws("/", "_day", "_bucket").isin(by_folder[folder])
        return self._folder(sorted(by_folder)).where(valid).drop("part")

    def _deltas(self, content: dict) -> DataFrame:
        deltas = content.get("deltas", [])
        seq = F.coalesce(*(F.when(F.col("part") == d["folder"].removeprefix("part="), F.lit(d["seq"])) for d in deltas), F.lit(0))
        return self._folder([d["folder"] for d in deltas]).withColumn("_seq", seq.cast("long")).drop("part")

    def _newest(self, rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("_day", "_bucket", *self.keys).orderBy(F.col(self.version).desc_nulls_last(), F.col("_seq").desc())
        return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")

    def _from(self, rows: DataFrame, content: dict) -> DataFrame:
        return rows.where(F.col("_day") >= content["from"]) if content.get("from") else rows

    def _merged(self, content: dict) -> DataFrame:
        base, deltas = self._from(self._base(content), content), self._from(self._deltas(content), content)
        if not content.get("deltas"):
            return base
        if not content.get("base"):
            return self._newest(deltas)
        changed = [*self.keys, "_day", "_bucket"]
        touched = deltas.select(*changed).distinct()
        same = [F.col(f"b.{c}").eqNullSafe(F.col(f"t.{c}")) for c in changed]
        if self._bytes(content["deltas"]) <= BROADCAST_BYTES:  # keys are no larger than the files that hold them
            touched = F.broadcast(touched)
        calm = base.alias("b").join(touched.alias("t"), same, "left_anti")
        stirred = base.alias("b").join(touched.alias("t"), same, "left_semi")
        return calm.unionByName(self._newest(stirred.unionByName(deltas)))

    def _bytes(self, deltas: list[dict]) -> int:
        from harrier.storage import _file_system

        total = 0
        for d in deltas:
            fs, path = _file_system(self.spark, f"{self.snapshots.root}/{d['folder']}")
            total += fs.getContentSummary(path).getLength()
        return total

    def read(self, number: int | None = None) -> DataFrame:
        """The newest version of each key, deleted ones gone; of a snapshot's number, or the latest.

        Base rows whose keys no delta touches aren't shuffled, unless the
        deltas are over 64 MB; filters on the day prune folders. A snapshot can be read
        until ``vacuum``.
        """
        content = self.snapshots.read(number) if number else self.snapshots.latest()[1]
        return self._merged(content).where(~F.col("_deleted")).select(*self.schema.names)

    # -- upkeep

    def compact(self) -> bool:
        """Rewrite the cells that deltas touch, without what is superseded or deleted; the others stay as they are. False if another writer came first with a compaction.

        Deletes are forgotten then: a version that is older than a forgotten delete, but is written later, brings its key back.
        """
        number, content = self.snapshots.latest()
        deltas = content.get("deltas", [])
        if not deltas:
            return True
        cell = F.concat_ws("/", "_day", "_bucket")
        stirred = sorted(r[0] for r in self._from(self._deltas(content), content).select(cell.alias("c")).distinct().collect())  # days x buckets at most
        name = f"part=base-{uuid.uuid4().hex}"
        old = self._from(self._base(content), content).where(cell.isin(stirred))
        rows = self._newest(old.unionByName(self._from(self._deltas(content), content))).where(~F.col("_deleted"))
        self._put(rows, name)
        filled = sorted(r[0] for r in self._folder([name]).select(cell.alias("c")).distinct().collect())

        def how(c: dict) -> dict:
            if c.get("base") != content.get("base"):
                raise Conflict("the base has changed")
            base = {k: f for k, f in c.get("base", {}).items() if k not in stirred} | {k: name for k in filled}
            done = {d["folder"] for d in deltas}
            cells = {f: n for f, n in c.get("cells", {}).items() if f in base.values()} | {name: len(filled)}
            return {**c, "base": base, "cells": cells, "deltas": [d for d in c["deltas"] if d["folder"] not in done]}

        try:
            self.snapshots.change(how)
            return True
        except Conflict:
            self.snapshots.delete(name)
            return False

    def retain(self, first_day: str) -> None:
        """Days before ``first_day`` (ISO) are no part of the table any more; no row is read or written for that."""
        self.snapshots.change(lambda c: {**c, "from": max(first_day, c.get("from", "")), "base": {k: f for k, f in c.get("base", {}).items() if k.split("/")[0] >= first_day}})

    def vacuum(self) -> list[str]:
        """Delete the folders that the latest snapshot doesn't name, once nobody reads an older one; what was deleted."""
        from harrier.storage import _file_system

        content = self.snapshots.latest()[1]
        named = {*content.get("base", {}).values(), *(d["folder"] for d in content.get("deltas", []))}
        fs, root = _file_system(self.spark, self.snapshots.root)
        gone = [n for n in (f.getPath().getName() for f in fs.listStatus(root)) if n.startswith("part=") and n not in named]
        self.snapshots.delete(*gone)
        return sorted(gone)
