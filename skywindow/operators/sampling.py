"""Stratified samples with inverse weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import NEGATIVES_PER_POSITIVE

STRATUM = ["band", "date"]


def stratum_seed(band: Column, date: Column) -> Column:
    """First four bytes of the SHA-256 of ``band|date``, as a number."""
    text = F.concat_ws("|", band, date.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def sample_order(seed: Column) -> Column:
    """A total order within a stratum that the seed decides."""
    iso = F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss")
    return F.sha2(F.concat_ws("|", seed.cast("string"), iso, "tx_field", "rx_field", "band"), 256)


def sample_labels(labels: DataFrame, ratio: float = NEGATIVES_PER_POSITIVE) -> DataFrame:
    """All positives, and up to ``ratio`` negatives for each, by band and date; weights undo the sampling.

    A stratum without positives, or with few negatives, stays whole. The sample follows the hash order of the cells, not
    the order of rows, so it is the same for any layout of the data.
    """
    day = labels.withColumn("date", F.to_date("window_start"))
    counts = day.groupBy(*STRATUM).agg(F.sum(F.col("open").cast("long")).alias("n_pos"), F.sum(1 - F.col("open").cast("long")).alias("n_neg"))
    quota = counts.withColumn("k", F.when(F.col("n_pos") > 0, F.least(F.floor(F.col("n_pos") * ratio), F.col("n_neg"))).otherwise(F.col("n_neg")))
    # strata are few (bands x dates), their rows many: a hash bound first, then ranks of what little is left near it
    rows = day.join(quota, STRATUM).withColumn("h", sample_order(stratum_seed(F.col("band"), F.col("date"))))
    bucket = F.conv(F.substring("h", 1, 3), 16, 10).cast("int")
    rows = rows.withColumns({"bucket": bucket, "neg": 1 - F.col("open").cast("int")})
    fill = rows.where("neg = 1").groupBy(*STRATUM, "bucket").agg(F.count("*").alias("n"))
    ahead = fill.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*STRATUM).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(*STRATUM, "bucket", "before", F.lit(1).alias("neg"))
    placed = rows.join(ahead, [*STRATUM, "bucket", "neg"], "left")
    rank = F.row_number().over(Window.partitionBy(*STRATUM, "bucket", "neg").orderBy("h", "window_start", "tx_field", "rx_field"))
    kept = placed.withColumn("rank", F.col("before") + rank).where((F.col("neg") == 0) | (F.col("rank") <= F.col("k")))
    weight = F.when((F.col("neg") == 1) & (F.col("k") < F.col("n_neg")), F.col("n_neg") / F.col("k")).otherwise(F.lit(1.0))
    return kept.select(*labels.columns, "date", weight.alias("sample_weight"))
