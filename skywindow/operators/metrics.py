"""Proper scores and reports by slice."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BAND_GROUPS, LOG_LOSS_CLIP, STORM_KP, literal_map

BINS = 10


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_loss(p: Column, y: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - LOG_LOSS_CLIP)), F.lit(LOG_LOSS_CLIP))
    return -F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))


def scores(predicted: DataFrame, *keys: str) -> DataFrame:
    """Brier score and log loss of ``p_open`` against ``open``, by keys; rows that abstain (null) are left out."""
    rows = predicted.where("p_open is not null")
    y = F.col("open").cast("double")
    return rows.groupBy(*keys).agg(brier(F.col("p_open"), y).alias("brier"), log_loss(F.col("p_open"), y).alias("log_loss"), F.count("*").alias("n"))


def reliability(predicted: DataFrame) -> DataFrame:
    """Ten bins of ``p_open``, closed on the right (0 in the first): count and means; empty bins keep a row."""
    edges = [k * 0.1 if k * 0.1 <= 1 else 1.0 for k in range(1, BINS)]  # as evenly spaced doubles, 0.30000000000000004 included
    number = sum(((F.col("p_open") > F.lit(e)).cast("int") for e in edges[1:]), (F.col("p_open") > F.lit(edges[0])).cast("int"))
    got = predicted.where("p_open is not null").groupBy(number.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg("p_open").alias("mean_p"), F.avg(F.col("open").cast("double")).alias("mean_y"))
    frame = predicted.sparkSession.range(BINS).select(F.col("id").alias("bin"))
    return frame.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean_p", "mean_y")


def average_precision(predicted: DataFrame, digits: int = 4) -> DataFrame:
    """Area under precision and recall, ties grouped by score.

    Scores are summed by distinct value first; running sums go over coarse cells of the score and then within each cell,
    so no task sees all distinct scores.
    """
    y = F.col("open").cast("long")
    per = predicted.where("p_open is not null").groupBy("p_open").agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    cell = F.floor(F.col("p_open") * 10**digits).cast("long")
    per = per.withColumn("cell", cell)
    cells = per.groupBy("cell").agg(F.sum("pos").alias("cp"), F.sum("n").alias("cn"))
    above = Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)  # at most 10^digits + 1 rows
    starts = cells.select("cell", F.coalesce(F.sum("cp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("cn").over(above), F.lit(0)).alias("n0"))
    own = Window.partitionBy("cell").orderBy(F.col("p_open").desc())
    run = per.join(starts, "cell").select("pos", (F.col("p0") + F.sum("pos").over(own)).alias("tp"), (F.col("n0") + F.sum("n").over(own)).alias("all"))
    return run.agg((F.sum(F.col("pos") * F.col("tp") / F.col("all")) / F.sum("pos")).alias("average_precision"), F.sum("pos").alias("n_pos"))


def band_group(band: Column) -> Column:
    by_band = {b: g for g, bs in BAND_GROUPS.items() for b in bs}
    return F.coalesce(F.try_element_at(literal_map(by_band), band), F.raise_error(F.concat(F.lit("unknown band "), F.coalesce(band, F.lit("null")))))


def tag_storms(labels: DataFrame, blocks: DataFrame) -> DataFrame:
    """``is_storm``: the definitive Kp of the three-hour block that holds the window is 5 or more; unknown is quiet."""
    block = F.timestamp_seconds(F.floor(F.unix_seconds("window_start") / 10800) * 10800)
    kp = blocks.groupBy("block_start").agg(F.max("kp").alias("_kp"))
    return labels.withColumn("block_start", block).join(kp, "block_start", "left").withColumn("is_storm", F.coalesce(F.col("_kp") >= STORM_KP, F.lit(False))).drop("_kp", "block_start")


def storm_block(labels: DataFrame, blocks: DataFrame) -> DataFrame:
    """``block_start, kp`` of the strongest storm block that holds a label; of equal ones the first. No storm, no row."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds("window_start") / 10800) * 10800)
    met = labels.select(start.alias("block_start")).distinct()
    strong = blocks.groupBy("block_start").agg(F.max("kp").alias("kp")).where(F.col("kp") >= STORM_KP).join(met, "block_start")
    best = strong.agg(F.max(F.struct("kp", (-F.unix_seconds("block_start")).alias("t"))).alias("b")).where("b is not null")
    return best.select(F.timestamp_seconds(-F.col("b.t")).alias("block_start"), F.col("b.kp").alias("kp"))


def slice_scores(predicted: DataFrame, *keys: str) -> DataFrame:
    """Overall, storm and quiet rows of one report, in one pass. Needs ``is_storm``."""
    each = F.explode(F.array(F.lit("overall"), F.when(F.col("is_storm"), F.lit("storm")).otherwise(F.lit("quiet")))).alias("slice")
    return scores(predicted.select("*", each), *keys, "slice")


def band_group_scores(predicted: DataFrame, *keys: str) -> DataFrame:
    """One table of band group by horizon and model (or other keys); a model that abstains on all rows of a group has no row."""
    return scores(predicted.withColumn("band_group", band_group(F.col("band"))), *keys, "band_group")


def tag_period(labels: DataFrame, start: str, end: str, pad_hours: int = 24) -> DataFrame:
    """``period``: before, during or after a storm, with a day's pads; other rows go."""
    t, a, b, pad = F.col("window_start"), F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"interval {pad_hours} hours")
    return labels.where((t >= a - pad) & (t < b + pad)).withColumn("period", F.when(t < a, "before").when(t < b, "during").otherwise("after"))


def hourly_timeline(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy(F.date_trunc("HOUR", "window_start").alias("hour")).agg(F.avg(F.col("open").cast("double")).alias("open_rate"), F.avg("p_open").alias("mean_p"), F.count("*").alias("n"))


def is_finite_probability(p: Column) -> Column:
    return p.isNotNull() & ~F.isnan(p) & p.between(0.0, 1.0) & (F.abs(p) != math.inf)
