"""A detection run over datasets: which datasets, which arms, which detectors, and one finding for each host."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.functions import scalars as S
from harrier.operators import files, fleet, markov

# fixed values: kinds of datasets that an arm takes, by the run's focus
PROCESS_ARM = {"auto": ("process", "mixed"), "process": ("process", "mixed"), "file": ("process",)}
FILE_ARM = {"auto": ("file", "mixed"), "file": ("file", "mixed"), "process": ("file",)}
# fixed values: what a severity counts in a run
SCORES = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25}
MODES = ("both", "fleet", "markov")


def selected(datasets: DataFrame, ids: tuple[str, ...] = (), tags: tuple[str, ...] = ()) -> DataFrame:
    """Datasets with one of the ids and one of the tags; no ids or no tags ask for nothing. datasets: dataset_id, kind, tags."""
    out = datasets.where(F.col("dataset_id").isin(*ids)) if ids else datasets
    return out.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else out


def arms(datasets: DataFrame, focus: str = "auto") -> DataFrame:
    """datasets with process_arm and file_arm: whether that arm of the run reads them."""
    kind = F.lower("kind")
    take = lambda kinds: F.coalesce(kind.isin(*kinds), F.lit(False))
    return datasets.withColumns({"process_arm": take(PROCESS_ARM[focus]), "file_arm": take(FILE_ARM[focus])})


def rows_of_arm(rows: DataFrame, datasets: DataFrame, arm: str) -> DataFrame:
    """Rows (with dataset_id) of the arm's datasets; where these are several, hosts are named dataset/host."""
    ids = datasets.where(arm).select("dataset_id").distinct()
    several = ids.limit(2).count() > 1
    out = rows.join(ids, "dataset_id", "left_semi")
    return out.withColumn("machine_id", F.concat("dataset_id", F.lit("/"), "machine_id")) if several else out


def suspect_percent(percent: float) -> float:
    """The threshold of a run: between 55 and 99.999, 95 for what is no positive number."""
    return min(max(percent, 55.0), 99.999) if percent > 0 and percent != float("inf") else 95.0


def severity_score(severity: Column) -> Column:
    return reduce(lambda otherwise, s: F.when(severity == s, SCORES[s]).otherwise(otherwise), SCORES, F.lit(0.0))


def fused(found: DataFrame) -> DataFrame:
    """(machine_id, score, severity, detectors, reasons), one row per host. found: machine_id, detector, score, reason.

    Process detectors count first, then the share of suspect commands lifts
    the score to max(s, 0.7 s + 0.3 share), then files count; reasons is the
    number of different ones.
    """
    top = lambda d: F.coalesce(F.max(F.when(F.col("detector") == d, F.col("score"))), F.lit(0.0))
    out = found.groupBy("machine_id").agg(
        top("process").alias("_p"), top("markov").alias("_m"), top("file").alias("_f"),
        F.array_sort(F.collect_set("detector")).alias("detectors"), F.count_distinct("reason").alias("reasons"))
    score = F.greatest(S.fused_score(F.col("_p"), F.col("_m")), F.col("_f"))
    out = out.withColumn("score", score).withColumn("severity", S.severity_of_score(F.col("score")))
    return out.select("machine_id", "score", "severity", "detectors", "reasons")


def run(datasets: DataFrame, processes: DataFrame, inventory: DataFrame, model: DataFrame | None = None, order: int = 4, ids: tuple[str, ...] = (), tags: tuple[str, ...] = (), focus: str = "auto", mode: str = "both", percent: float = 95.0) -> tuple[DataFrame, DataFrame]:
    """(findings, reasons): ``fused`` hosts, and their (machine_id, detector, score, reason) rows.

    datasets: dataset_id, kind, tags. processes: dataset_id and what
    ``fleet.process_profile`` needs. inventory: dataset_id and what
    ``files.findings`` needs. Mode both runs all detectors (commands only
    with a model), fleet none on commands, markov no others.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode}: one of {', '.join(MODES)}")
    chosen = arms(selected(datasets, ids, tags), focus)
    if chosen.isEmpty():
        raise ValueError("no datasets match the ids and tags")
    has_processes, has_files = (not chosen.where(a).isEmpty() for a in ("process_arm", "file_arm"))
    if mode == "markov" and (not has_processes or model is None):
        raise ValueError("a run on commands alone needs a model and a dataset with process rows")
    found = []
    if has_processes:
        rows = rows_of_arm(processes, chosen, "process_arm")
        if mode != "markov":
            odd = fleet.process_outliers(fleet.process_profile(rows))
            found.append(odd.select("machine_id", F.lit("process").alias("detector"), severity_score(F.col("severity")).alias("score"), F.explode("reasons").alias("reason")))
        if mode != "fleet" and model is not None:
            lines = rows.where("args IS NOT NULL").select("machine_id", "pid", "ord", F.concat_ws(" ", "path", "args").alias("line"))
            key = ("machine_id", "pid", "ord")
            scored = markov.suspects(markov.score(lines, markov.char_grams(lines, "line", order, True, False, *key), model, *key), model, suspect_percent(percent))
            shares = markov.host_ratios(scored, "machine_id").where("ratio > 0")
            found.append(shares.select("machine_id", F.lit("markov"), F.col("ratio").alias("score"), F.format_string("suspect command ratio %.2f", "ratio")))
    if has_files and mode != "markov":
        verdicts, told = files.findings(rows_of_arm(inventory, chosen, "file_arm"))
        plain = F.lit("File inventory differs from the fleet's largest cluster.")
        found.append(verdicts.join(told, "machine_id", "left").select("machine_id", F.lit("file"), severity_score(F.col("severity")), F.coalesce("detail", plain)))
    if not found:
        raise ValueError("no detector of this mode reads these datasets")
    whole = reduce(lambda a, b: a.union(b), found).toDF("machine_id", "detector", "score", "reason")
    return fused(whole), whole
