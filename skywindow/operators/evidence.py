"""Who was listening, and who was sending, in each window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import normal_grid
from ..functions.hygiene import mode_class
from ..schema import PAD_AFTER_S, PAD_BEFORE_S, WINDOW_S, window_start


def lit_windows(ts: Column) -> Column:
    """Starts, in seconds, of the windows W with W - 30 min <= ts < W + 45 min; ts counts in whole minutes."""
    minute = F.floor(F.unix_seconds(ts) / 60) * 60
    first = (F.floor((minute - PAD_AFTER_S) / WINDOW_S) + 1) * WINDOW_S
    last = F.floor((minute + PAD_BEFORE_S) / WINDOW_S) * WINDOW_S
    return F.sequence(first, last, F.lit(WINDOW_S).cast("long"))


def receiver_uptime(spots: DataFrame) -> DataFrame:
    """Each receiver's evidence by window, band and mode class, with the place that it mostly reports.

    Four-character grids go before fields, then the most frequent, then the first in order. Reports are counted by grid
    before they are spread over windows, so the spread rows carry counts, and receivers without a place are left out.
    """
    rows = spots.select(
        "ts", "band", "de_call", mode_class(F.col("mode")).alias("mode_class"), normal_grid(F.col("de_grid")).alias("grid")
    ).where("mode_class <> 'other' and ts is not null")
    # reports of one receiver, grid and minute light the same windows: they are summed before they are spread
    minute = F.floor(F.unix_seconds("ts") / 60)
    packed = rows.groupBy("de_call", "band", "mode_class", "grid", minute.alias("minute")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    spread = packed.withColumn("w", F.explode(lit_windows(F.col("first"))))
    by_grid = spread.groupBy("w", "de_call", "band", "mode_class", "grid").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    place = F.max_by("grid", F.struct(F.length("grid").alias("l"), F.col("n"), (-F.ascii(F.substring("grid", 1, 1))).alias("a"), (-F.ascii(F.substring("grid", 2, 1))).alias("b"), (-F.ascii(F.substring("grid", 3, 1))).alias("c"), (-F.ascii(F.substring("grid", 4, 1))).alias("d")))
    out = by_grid.groupBy("w", "de_call", "band", "mode_class").agg(
        F.sum("n").cast("int").alias("n_evidence_reports"), F.min("first").alias("first_report"), F.max("last").alias("last_report"), place.alias("grid")
    )
    return out.where("grid is not null").select(
        F.timestamp_seconds("w").alias("window_start"), "de_call", "band", "mode_class", "n_evidence_reports", "first_report", "last_report",
        F.substring("grid", 1, 2).alias("de_field"), F.when(F.length("grid") == 4, F.col("grid")).alias("de_grid4"),
    )


def transmit_evidence(spots: DataFrame) -> DataFrame:
    """Distinct stations heard from each field by window, band and mode class; ``wspr`` if a beacon is among them."""
    rows = spots.select(
        window_start(F.col("ts")).alias("window_start"), F.substring(normal_grid(F.col("dx_grid")), 1, 2).alias("tx_field"), "band", mode_class(F.col("mode")).alias("mode_class"), "dx_call", "source"
    ).where("mode_class <> 'other'")
    return rows.groupBy("window_start", "tx_field", "band", "mode_class").agg(
        F.countDistinct("dx_call").alias("n_evidence_reports"), F.when(F.max(F.col("source") == "wsprnet"), "wspr").otherwise("spot").alias("evidence_tier")
    )
