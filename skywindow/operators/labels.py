"""The label universe: what was heard, and what would have been heard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import normal_grid
from ..functions.signal import ft8_equivalent
from ..schema import CELL, window_start
from .evidence import receiver_uptime, transmit_evidence


def fielded(spots: DataFrame) -> DataFrame:
    """Spots with their window and the fields of both ends; spots without a place at either end are left out."""
    field = lambda c: F.substring(normal_grid(F.col(c)), 1, 2)
    return spots.withColumns({"window_start": window_start(F.col("ts")), "tx_field": field("dx_grid"), "rx_field": field("de_grid")}).where("tx_field is not null and rx_field is not null")


def universe(spots: DataFrame, *more: Column) -> DataFrame:
    """Positive cells, and cells where a receiver listened while a station of the field was known to send.

    ``more`` are aggregates of a cell's spots, null where none was heard.
    """
    heard = fielded(spots).groupBy(*CELL).agg(F.count("*").alias("n_spots"), *more)
    ears = receiver_uptime(spots).groupBy("window_start", F.col("de_field").alias("rx_field"), "band", "mode_class").agg(F.countDistinct("de_call").alias("n_monitors"))
    sent = transmit_evidence(spots).where("tx_field is not null").withColumnRenamed("n_evidence_reports", "n_tx_stations")
    able = ears.join(sent, ["window_start", "band", "mode_class"]).groupBy(*CELL).agg(
        F.sum("n_monitors").alias("n_monitors"), F.sum("n_tx_stations").alias("n_tx_stations"), F.max(F.col("evidence_tier") == "wspr").alias("wspr")
    )
    both = heard.join(able, CELL, "full")
    named = [c for c in heard.columns if c not in (*CELL, "n_spots")]
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select(
        *CELL, zero("n_spots"), (F.coalesce("n_spots", F.lit(0)) > 0).alias("is_positive"), F.col("n_monitors").isNotNull().alias("is_n_eligible"),
        zero("n_monitors"), zero("n_tx_stations"), F.when(F.col("wspr"), "wspr").otherwise("spot").alias("evidence_tier"), *named,
    )


def labels(spots: DataFrame) -> DataFrame:
    """The universe with ``open`` and the exact median FT8-equivalent signal, which restates the label: never a feature."""
    snr = ft8_equivalent(F.col("mode"), F.col("snr_db"), F.col("tx_dbm"))
    u = universe(spots, F.median(snr).alias("snr_ft8eq_p50"))
    return u.select(*CELL, F.col("is_positive").cast("byte").alias("open"), "n_spots", "n_monitors", "n_tx_stations", "evidence_tier", "snr_ft8eq_p50")


def unlabeled_fraction(spots: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Share of field pairs that were active in a window but have no label, by band and date."""
    rows = fielded(spots)
    active = rows.select("window_start", "band", F.explode(F.array("tx_field", "rx_field")).alias("field")).distinct()
    # pairs of the active fields of a window: their number is the square of the fields', at most 324
    per = active.groupBy("window_start", "band").agg(F.count("*").alias("n")).groupBy("band", F.to_date("window_start").alias("date")).agg(F.sum(F.col("n") * F.col("n")).alias("n_candidates"))
    have = (cells if cells is not None else universe(spots)).groupBy("band", F.to_date("window_start").alias("date")).agg(F.count("*").alias("n_universe"))
    out = per.join(have, ["band", "date"], "left").withColumn("n_universe", F.coalesce("n_universe", F.lit(0)))
    return out.select("band", "date", "n_candidates", "n_universe", (1 - F.col("n_universe") / F.col("n_candidates")).alias("unlabeled_fraction"))
