"""The acceptance run: held-out months with a storm in them, every model on one cohort, a refit with private spots."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hygiene import qualifying
from ..operators.acceptance import LEAST_GAP_H, UNVERIFIED, enforce_gap, run_acceptance, write_report
from ..operators.dedup import dedup_spots
from ..operators.features import feature_matrix
from ..operators.labels import labels as build_labels
from ..operators.metrics import storm_block
from ..schema import union_spots
from ..sources.archives import month_bounds
from .tables import staged

LEAST_MONTHS = 3
Loader = Callable[[str], DataFrame]


class Unusable(ValueError):
    """The run was asked for in a way that can't give a verdict."""


def check_months(train: list[str], held_out: list[str]) -> None:
    """Three distinct held-out months or more, none of them trained on."""
    for month in (*train, *held_out):
        month_bounds(month)
    if len(set(held_out)) < max(LEAST_MONTHS, len(held_out)):
        raise Unusable(f"at least {LEAST_MONTHS} held-out months are needed, each once: {held_out}")
    if both := sorted(set(train) & set(held_out)):
        raise Unusable(f"trained on and held out: {both}")


def month_spots(loaders: Mapping[str, Loader], month: str, more: DataFrame | None = None) -> DataFrame:
    """Qualifying spots of all sources in the month, the best of each path, band, mode and window."""
    first, following = month_bounds(month)
    spots = union_spots(*[load(month) for load in loaders.values()], *([more] if more is not None else []))
    return dedup_spots(qualifying(spots).where((F.col("ts") >= first) & (F.col("ts") < following)))


def _labels(spots: Mapping[str, DataFrame]) -> DataFrame:
    """Labels of each month on its own: no evidence reaches over its bounds."""
    out = None
    for table in spots.values():
        part = build_labels(table)
        out = part if out is None else out.unionByName(part)
    return staged(out)


def holdout_run(
    loaders: Mapping[str, Loader], train: list[str], held_out: list[str], band: str, hourly: DataFrame, kp_blocks: DataFrame, models: Mapping[str, Callable], candidate: str,
    private: Loader | None = None, report_path: str | None = None,
) -> tuple[int, dict]:
    """Exit code and report. ``loaders`` give spots by month; ``models`` are factories of what has ``fit`` and ``predict``.

    The candidate has to beat every other model on the cohort of the held-out months, strictly; with ``private`` spots it
    is fitted again on training months that include them, and must not do worse on the same cohort. 0: passed, 1: missed,
    2: no verdict (a source without spots, a month without labels, a model that leaves rows out).
    """
    check_months(train, held_out)
    spots = {month: staged(month_spots(loaders, month).where(F.col("band") == band)) for month in (*train, *held_out)}
    report: dict = {"band": band, "train_months": train, "eval_months": held_out, "spots": {}}

    def unverified(reason: str) -> tuple[int, dict]:
        report.update(exit=UNVERIFIED, reason=reason)
        return finished(UNVERIFIED)

    def finished(code: int) -> tuple[int, dict]:
        if report_path:
            write_report(hourly.sparkSession, report, report_path)
        return code, report

    for part, months in (("train", train), ("eval", held_out)):
        of = {name: 0 for name in loaders}
        for month in months:
            of |= {r.source: of.get(r.source, 0) + r.n for r in spots[month].groupBy("source").agg(F.count("*").alias("n")).collect()}
        report["spots"][part] = of
        if lacking := [name for name in loaders if not of[name]]:
            return unverified(f"no qualifying spots of {', '.join(lacking)} to {part} on")
    fitted, cohort = _labels({m: spots[m] for m in train}), _labels({m: spots[m] for m in held_out})
    by_month = {r.month: r.n for r in cohort.groupBy(F.date_format("window_start", "yyyy-MM").alias("month")).agg(F.count("*").alias("n")).collect()}
    report["labels"] = by_month
    if lacking := [m for m in held_out if not by_month.get(m)]:
        return unverified(f"no labels in {', '.join(lacking)}")
    enforce_gap(fitted, cohort, LEAST_GAP_H)
    storm = storm_block(cohort, kp_blocks).first()
    if storm is None:
        raise Unusable("no storm in the held-out months")
    report["storm"] = {"block_start": storm.block_start.isoformat(), "kp": storm.kp}
    asked = staged(feature_matrix(cohort, cohort, hourly))
    known = staged(feature_matrix(fitted, fitted, hourly))
    arms = {name: staged(make().fit(known).predict(asked)) for name, make in models.items()}
    again = None
    if private is not None:
        more = {m: staged(dedup_spots(spots[m].unionByName(month_spots({"private": private}, m).where(F.col("band") == band)))) for m in train}
        report["spots"]["private"] = sum(t.join(spots[m].select("source").distinct(), "source", "left_anti").count() for m, t in more.items())
        if not report["spots"]["private"]:
            return unverified("no private spot is left after deduplication")
        wider = _labels(more)
        enforce_gap(wider, cohort, LEAST_GAP_H)
        again = staged(models[candidate]().fit(staged(feature_matrix(wider, wider, hourly))).predict(asked))
    code, verdict = run_acceptance(arms, candidate, cohort, again)
    report.update(verdict)
    return finished(code)
