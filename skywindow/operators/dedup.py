"""One spot for each path, band, mode and window: the best of all sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import OTHER_RANK, SOURCE_RANK, literal_map, window_start


def source_rank(source: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(SOURCE_RANK), F.coalesce(source, F.lit(""))), F.lit(OTHER_RANK))


def dedup_spots(spots: DataFrame, by_source: bool = True, within: tuple[str, ...] = ()) -> DataFrame:
    """Keeps the first by source rank (if ``by_source``), strongest signal (null last), time, then all other columns.

    The last makes ties between different spots come out the same every time; equal rows are alike. Columns of ``within``
    keep spots apart.
    """
    keys = [F.col(c) for c in ("dx_call", "de_call", "band", "mode", *within)] + [window_start(F.col("ts"))]
    # a hash goes first, so that rows are told apart by one number when they are sorted
    keys = [F.xxhash64(*keys), *keys]
    order = ([source_rank(F.col("source"))] if by_source else []) + [F.col("snr_db").desc_nulls_last(), F.col("ts")]
    rest = [F.col(c).asc_nulls_last() for c in sorted(spots.columns) if c not in {"dx_call", "de_call", "band", "mode", "ts", "snr_db", *within}]
    return spots.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *rest))).where("_n = 1").drop("_n")


def source_counts(spots: DataFrame) -> DataFrame:
    return spots.groupBy("source").agg(F.count("*").alias("n"))
