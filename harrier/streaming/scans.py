"""Scoring when a scan ends: its command lines are scored as they come, and told of once, on its summary or when it falls silent.

The state of a scan is a few numbers and its worst lines, however many lines it has.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from harrier.operators.markov import PAD, prior

OUT = "scan_id string, host_id string, scored long, suspects long, expected long, reason string, complete boolean, sample string"
STATE = "host string, scored long, suspects long, expected long, seen long, worst string, told boolean, timer long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # what stateful processors need


class LineScorer:
    """Mean log probability of a line's n-grams by a model held in memory; lines are padded in front."""

    def __init__(self, model: DataFrame, order: int, percent: float, most: int = 2_000_000):
        if (n := model.count()) > most:
            raise ValueError(f"the model has {n} transitions, over {most}: too many to hold in every worker")
        self.order = order
        self.logs = {r.ctx + r.nxt: math.log(r.p) for r in model.select("ctx", "nxt", "p").collect()}
        self.unseen = math.log(prior(model).first().prior)
        self.threshold = self.unseen * min(99.999, max(55.0, percent)) / 100

    def __call__(self, line: str) -> float:
        text, k = PAD * self.order + line, self.order + 1
        scores = [self.logs.get(text[i : i + k], self.unseen) for i in range(len(text) - self.order)]
        return sum(scores) / len(scores) if scores else self.unseen


class ScanEnd(StatefulProcessor):
    """One scan. Rows: ts, kind (obs or summary), host_id, line, score (null: nothing to score), expected."""

    def __init__(self, threshold: float, silence_ms: int, forget_ms: int, worst: int = 5):
        self.threshold, self.silence, self.forget, self.keep = threshold, silence_ms, forget_ms, worst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("scan", STATE)

    def close(self) -> None:
        pass

    def _load(self) -> dict:
        names = [f.split(" ")[0] for f in STATE.split(", ")]
        if not self.state.exists():
            return dict(zip(names, (None, 0, 0, None, 0, "[]", False, None)))
        return dict(zip(names, self.state.get()))

    def _set(self, s: dict, at: int) -> None:
        """Move the scan's one timer."""
        if s["timer"] is not None:
            self.handle.deleteTimer(s["timer"])
        s["timer"] = at
        self.handle.registerTimer(at)

    def _tell(self, key, s: dict, reason: str, now: int) -> pd.DataFrame:
        s["told"] = True
        self._set(s, now + self.forget)  # until then repeated summaries and late rows say nothing new
        row = (key[0], s["host"], s["scored"], s["suspects"], s["expected"], reason, s["expected"] == s["seen"], s["worst"])
        s["worst"] = "[]"
        return pd.DataFrame([row], columns=[f.split(" ")[0] for f in OUT.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s, last = self._load(), 0
        for df in rows:
            for ts, kind, host, line, score, expected in df[["ts", "kind", "host_id", "line", "score", "expected"]].itertuples(index=False):
                last = max(last, int(ts.timestamp() * 1000))
                if s["told"]:
                    continue
                s["host"] = host if isinstance(host, str) else s["host"]
                if kind == "summary":
                    s["expected"] = int(expected)
                    continue
                s["seen"] += 1
                if score == score:  # a line without a score has none
                    s["scored"] += 1
                    if score < self.threshold:
                        s["suspects"] += 1
                        s["worst"] = json.dumps(heapq.nsmallest(self.keep, [*json.loads(s["worst"]), [score, line]]))
        now = max(last, timerValues.getCurrentWatermarkInMs())
        if not s["told"]:
            if s["expected"] is not None and s["seen"] >= s["expected"]:
                yield self._tell(key, s, "summary", now)
            else:  # lines may be late, the summary may never come
                self._set(s, now + self.silence)
        self.state.update(tuple(s.values()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        if s["told"]:
            self.state.clear()
            return
        s["timer"] = None
        yield self._tell(key, s, "summary" if s["expected"] is not None else "timeout", timerValues.getCurrentWatermarkInMs())
        self.state.update(tuple(s.values()))


def score_at_end(stream: DataFrame, model: DataFrame, order: int, percent: float = 95.0, late: str = "1 minute", silence: int = 600, forget: int = 86_400, line: Column | None = None) -> DataFrame:
    """One row per scan of a stream: lines scored, suspects, the worst lines, and why it was told (summary or timeout).

    stream: scan_id, ts, kind (obs or summary), host_id, line, expected (a summary's
    number of observations). A scan is told once all observations that its summary counts are there;
    without these, or without a summary, ``silence`` seconds of event time after its last row. Then it is
    remembered for ``forget`` seconds, and what comes late or again changes nothing. Lines are scored before
    the state; the model is held by every worker for that, within a bound that is checked. The session needs
    the state store ``PROVIDER``.
    """
    scorer = LineScorer(model, order, percent)
    shared = stream.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def score(lines: pd.Series) -> pd.Series:
        return lines.map(shared.value, na_action="ignore").astype("float64")

    rows = stream.select(F.col("scan_id").cast("string"), "ts", "kind", F.col("host_id").cast("string"), (F.col("line") if line is None else line).alias("line"), F.col("expected").cast("long"))
    rows = rows.withColumn("score", F.when(F.col("kind") == "obs", score("line")))
    keyed = rows.withWatermark("ts", late).groupBy("scan_id")
    return keyed.transformWithStateInPandas(ScanEnd(scorer.threshold, silence * 1000, forget * 1000), OUT, "Append", "EventTime")
