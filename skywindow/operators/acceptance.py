"""Blocked validation and the acceptance gate."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CELL
from .metrics import is_finite_probability, scores

LEAST_GAP_H = 48
PASS, MISS, UNVERIFIED = 0, 1, 2


@dataclass(frozen=True)
class Fold:
    train_start: datetime
    train_end: datetime
    eval_start: datetime
    eval_end: datetime


def gap_hours(horizon_hours: float, lookback_hours: float) -> float:
    return max(LEAST_GAP_H, horizon_hours + lookback_hours)


def folds(start: datetime, end: datetime, train_days: int, eval_days: int, gap: float) -> list[Fold]:
    """The k-th fold begins k strides (a training block and a gap) after the start; all that end in time are given."""
    train, stride, held = timedelta(days=train_days), timedelta(days=train_days, hours=gap), timedelta(days=eval_days)
    begins = [start + k * stride for k in range(max(0, (end - start - held) // stride))]
    return [Fold(b, b + train, b + stride, b + stride + held) for b in begins]


def enforce_gap(train: DataFrame, evaluation: DataFrame, least_hours: float = LEAST_GAP_H) -> float:
    last = train.agg(F.unix_seconds(F.max("window_start"))).first()[0]
    first = evaluation.agg(F.unix_seconds(F.min("window_start"))).first()[0]
    gap = (first - last) / 3600 if last is not None and first is not None else float("inf")
    if gap < least_hours:
        raise ValueError(f"evaluation begins {gap:g} h after training ends; {least_hours:g} h are needed")
    return gap


def cohort_digest(labels: DataFrame) -> DataFrame:
    """``digest, n``: SHA-256 over the sorted SHA-256 digests of hourly blocks of ``time,tx,rx,band,open`` lines.

    Lines are hashed by hour first, so that no task or row holds the whole cohort; equal cohorts have equal digests.
    """
    line = F.concat_ws(",", F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss"), "tx_field", "rx_field", "band", F.col("open").cast("string"))
    block = F.date_format("window_start", "yyyy-MM-dd'T'HH")
    shard = F.substring(F.sha2(line, 256), 1, 2)
    by_shard = labels.select(block.alias("block"), shard.alias("shard"), line.alias("line")).groupBy("block", "shard").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("h"), F.count("*").alias("n"))
    by_block = by_shard.groupBy("block").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("shard", "h"))), "\n"), 256).alias("h"), F.sum("n").alias("n"))
    return by_block.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("block", F.lit(" "), "h"))), "\n"), 256).alias("digest"), F.sum("n").alias("n"))


def coverage(predicted: DataFrame, cohort: DataFrame) -> DataFrame:
    """Rows of the cohort without a prediction and predictions outside of it, by kind."""
    missing = cohort.join(predicted, CELL, "left_anti").agg(F.lit("missing").alias("kind"), F.count("*").alias("n"))
    extra = predicted.join(cohort, CELL, "left_anti").agg(F.lit("extra").alias("kind"), F.count("*").alias("n"))
    return missing.unionByName(extra)


def defects(predicted: DataFrame, cohort: DataFrame) -> dict[str, int]:
    """What keeps an arm from being scored: counts by kind, zeros left out."""
    found = {r.kind: r.n for r in coverage(predicted, cohort).collect()}
    found["duplicate"] = predicted.groupBy(*CELL).count().where("count > 1").count()
    bad = predicted.agg(F.sum((~F.coalesce(is_finite_probability(F.col("p_open")), F.lit(False))).cast("long"))).first()[0]
    found["no_probability"] = bad or 0
    truth = cohort.select(*CELL, F.col("open").alias("_truth"))
    found["label_mismatch"] = predicted.join(truth, CELL).where(F.col("open") != F.col("_truth")).count()
    return {k: v for k, v in found.items() if v}


def run_acceptance(arms: dict[str, DataFrame], candidate: str, cohort: DataFrame, augmented: DataFrame | None = None) -> tuple[int, dict]:
    """Scores every arm on one cohort. The candidate has to beat each other arm on Brier score and log loss, strictly.

    An ``augmented`` refit of the candidate passes if neither score grows, unrounded. Returns 0 for a pass, 1 for a miss,
    2 where an arm can't be verified, and a report.
    """
    digest = cohort_digest(cohort).first()
    report: dict = {"cohort": {"digest": digest.digest, "n": digest.n}, "arms": {}, "defects": {}}
    every = dict(arms) | ({"augmented": augmented} if augmented is not None else {})
    for name, arm in every.items():
        if bad := defects(arm, cohort):
            report["defects"][name] = bad
            continue
        s = scores(arm).first()
        report["arms"][name] = {"brier": s.brier, "log_loss": s.log_loss, "n": s.n}
    if report["defects"]:
        report["exit"] = UNVERIFIED
        return UNVERIFIED, report
    mine = report["arms"][candidate]
    wins = all(mine[m] < report["arms"][o][m] for o in arms if o != candidate for m in ("brier", "log_loss"))
    if augmented is not None:
        wins = wins and all(report["arms"]["augmented"][m] - mine[m] <= 0 for m in ("brier", "log_loss"))
    report["exit"] = PASS if wins else MISS
    return report["exit"], report


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """The report as a JSON text in the folder ``path``; Spark's committer shows it whole or not at all."""
    lines = spark.createDataFrame([(report_json(report),)], "value string")
    lines.coalesce(1).write.mode("overwrite").text(path)


def append_headline(predicted: DataFrame, model: str, path: str) -> None:
    """Adds a ``model,brier,log_loss,n`` row, six decimals, to the CSV table in the folder ``path``."""
    row = scores(predicted).select(F.lit(model).alias("model"), *[F.format_string("%.6f", c).alias(c) for c in ("brier", "log_loss")], "n")
    row.coalesce(1).write.mode("append").option("header", True).csv(path)


def report_json(report: dict) -> str:
    return json.dumps(report, indent=2, sort_keys=True, default=lambda x: asdict(x) if isinstance(x, Fold) else str(x))
