"""Intermediate tables in the folder that all executors share.

Results that several jobs read are written as Parquet: that cuts the lineage,
survives lost executors and gives the planner exact sizes.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where it is unset, a temporary folder in local mode; on a cluster that is an error, as executors share no such folder."""
    if folder := spark.conf.get("spark.checkpoint.dir", ""):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "harrier-shared")


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def make_folder(spark: SparkSession, path: str) -> str:
    """Make the folder; its path with the scheme of the file system that Spark resolves it against."""
    fs, p = _file_system(spark, path)
    fs.mkdirs(p)
    full = fs.makeQualified(p).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def clean_up(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; to be called once nothing reads its results any more."""
    fs, folder = _file_system(spark, shared_dir(spark))
    if fs.exists(folder):
        for entry in fs.listStatus(folder):
            name = entry.getPath().getName()
            if name.startswith("harrier-") and spark.sparkContext.applicationId in name:
                fs.delete(entry.getPath(), True)


class Scratch:
    """A folder of intermediate tables for one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self._paths, self._n = spark, {}, 0
        self.root = f"{shared_dir(spark)}/harrier-{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that nothing will read again."""
        fs, p = _file_system(self.spark, self._paths.pop(id(df))[1])
        fs.delete(p, True)

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all saved tables but these, once nothing will read the others again."""
        kept = {id(t) for t in tables}
        for df, _ in list(self._paths.values()):
            if id(df) not in kept:
                self.drop(df)
