"""Whole plans: spots to labels to scores, and the published surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hygiene import qualifying
from ..operators.climatology import Climatology
from ..operators.dedup import dedup_spots
from ..operators.features import feature_matrices
from ..operators.labels import labels as build_labels
from ..operators.metrics import scores, slice_scores
from ..schema import HORIZONS_H, union_spots
from .tables import staged


def clean_spots(*sources: DataFrame) -> DataFrame:
    """All sources in one, qualified, then deduplicated across sources."""
    return dedup_spots(qualifying(union_spots(*sources)))


def label_plan(*sources: DataFrame) -> DataFrame:
    return build_labels(clean_spots(*sources))


def horizon_matrices(labels: DataFrame, hourly: DataFrame, horizons=HORIZONS_H) -> dict[float, DataFrame]:
    """A feature matrix for each horizon, out of one table that all share."""
    every = staged(feature_matrices(labels, labels, hourly, tuple(horizons)))
    return {h: every.where(F.col("horizon_hours") == float(h)).drop("horizon_hours") for h in horizons}


def climatology_report(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    predicted = Climatology().fit(train).predict(evaluation)
    return slice_scores(predicted, F.lit("climatology").alias("model")) if "is_storm" in evaluation.columns else scores(predicted)


def prediction_surface(predicted: dict[int, DataFrame], snr: DataFrame | None = None) -> DataFrame:
    """One row a cell: ``tx_field, rx_field, band, p_open_pct`` (an array by horizon, whole per cent, null = abstains) and ``confidence``.

    ``predicted`` has, by horizon in seconds, one window's ``p_open`` by cell; ``confidence`` is high with four monitors or
    more, medium with one or more, else low.
    """
    horizons = sorted(predicted)
    rows = None
    for h in horizons:
        x = predicted[h].select("tx_field", "rx_field", "band", F.lit(h).alias("h"), "p_open", F.col("n_monitors") if "n_monitors" in predicted[h].columns else F.lit(0).alias("n_monitors"))
        rows = x if rows is None else rows.unionByName(x)
    by_cell = rows.groupBy("tx_field", "rx_field", "band").agg(*[F.round(F.max(F.when(F.col("h") == h, F.col("p_open"))) * 100).cast("int").alias(f"_{h}") for h in horizons], F.max("n_monitors").alias("m"))
    tier = F.when(F.col("m") >= 4, "high").when(F.col("m") >= 1, "medium").otherwise("low")
    return by_cell.select("tx_field", "rx_field", "band", F.array(*[F.col(f"_{h}") for h in horizons]).alias("p_open_pct"), tier.alias("confidence"))


def surface_document(surface: DataFrame, horizons_s: list[int], model: dict, valid_from: str, valid_until: str, generated_at: str) -> DataFrame:
    """The surface as one JSON document of parallel arrays. The cells of a surface are at most 324 x 324 x 11, the contract's own bound."""
    cells = surface.agg(F.sort_array(F.collect_list(F.struct("tx_field", "rx_field", "band", "p_open_pct", "confidence"))).alias("c"))
    column = lambda n: F.transform("c", lambda x: x[n]).alias(n)
    doc = F.struct(
        F.lit("prediction-surface.v1").alias("schema"), F.lit(generated_at).alias("generated_at"), F.lit(valid_from).alias("valid_from"), F.lit(valid_until).alias("valid_until"),
        F.struct(*[F.lit(v).alias(k) for k, v in model.items()]).alias("model"), F.array(*[F.lit(h) for h in horizons_s]).alias("horizons_s"), F.size("c").alias("n_cells"),
        F.struct(*[column(n) for n in ("tx_field", "rx_field", "band", "p_open_pct", "confidence")]).alias("columns"),
    )
    return cells.select(F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


def load_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..adapter import spots

    return clean_spots(spots(spark, sf_dir))
