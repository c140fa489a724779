"""Markov training and scoring on streams.

Training keeps transition counts in a folder: a delta for each micro-batch, and one base that holds
all batches up to a number. A snapshot names both, so a batch that comes again is
seen to be known, and neither files nor what a model reads grow with the batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrier.operators import markov
from harrier.sources.snapshots import Conflict, Snapshots

COUNTS = "ctx string, nxt string, n long"


class Trainer:
    """Transition counts of a stream's lines under ``path``. Batches up to ``through`` are in the base, later ones are deltas; both are known by their ids."""

    def __init__(self, spark, path: str, order: int, most_deltas: int = 16):
        self.spark, self.order, self.most_deltas, self.snapshots = spark, order, most_deltas, Snapshots(spark, path)

    def _read(self, content: dict) -> DataFrame:
        folders = [*([content["base"]] if content.get("base") else []), *content.get("deltas", {}).values()]
        return self.spark.read.schema(COUNTS).parquet(*(f"{self.snapshots.root}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], COUNTS)

    def add(self, rows: DataFrame, line: str, batch: int) -> bool:
        """Count the lines of a batch; False if the batch is counted already. Batches come in the order of their ids, as a stream's do."""
        content = self.snapshots.latest()[1]
        if batch <= content.get("through", -1) or str(batch) in content.get("deltas", {}):
            return False
        counts = markov.char_grams(rows, line, self.order, True, True).groupBy("ctx", "nxt").agg(F.count("*").alias("n"))
        folder = f"delta-{batch}-{uuid.uuid4().hex}"
        counts.write.parquet(f"{self.snapshots.root}/{folder}")

        def how(c: dict) -> dict:
            if batch <= c.get("through", -1) or str(batch) in c.get("deltas", {}):
                raise Conflict("the batch was counted by another writer")
            return {**c, "deltas": {**c.get("deltas", {}), str(batch): folder}}

        try:
            self.snapshots.change(how)
        except Conflict:
            self.snapshots.delete(folder)
            return False
        if len(self.snapshots.latest()[1]["deltas"]) > self.most_deltas:
            self.compact()
        return True

    def compact(self) -> None:
        """Add the deltas to the base, which then stands for all batches up to the last of them."""
        number, content = self.snapshots.latest()
        if not content.get("deltas"):
            return
        folder = f"base-{uuid.uuid4().hex}"
        self._read(content).groupBy("ctx", "nxt").agg(F.sum("n").alias("n")).write.parquet(f"{self.snapshots.root}/{folder}")
        self.snapshots.commit(number, {"base": folder, "through": max(map(int, content["deltas"])), "deltas": {}})
        self.snapshots.delete(*content["deltas"].values(), *([content["base"]] if content.get("base") else []))

    def model(self) -> DataFrame:
        """(ctx, nxt, n, p) of all batches so far."""
        return markov.train(self._read(self.snapshots.latest()[1]), F.col("n"))


def train_batches(stream: DataFrame, line: str, order: int, path: str, checkpoint: str, most_deltas: int = 16):
    """Trains on every micro-batch and returns the query; ``trained`` gives the model."""
    trainer = Trainer(stream.sparkSession, path, order, most_deltas)
    return stream.writeStream.foreachBatch(lambda df, batch: trainer.add(df, line, batch)).option("checkpointLocation", checkpoint).start()


def trained(spark, path: str) -> DataFrame:
    return Trainer(spark, path, 0).model()


def score_batches(stream: DataFrame, model: DataFrame, line: str, order: int, key: str, percent: float, path: str, checkpoint: str):
    """Writes the suspects of each micro-batch, lowest scores first."""

    def act(df: DataFrame, batch: int) -> None:
        scored = markov.score(df, markov.char_grams(df, line, order, True, False, key), model, key)
        markov.suspects(scored, model, percent).where("suspect").orderBy("score").write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).start()
