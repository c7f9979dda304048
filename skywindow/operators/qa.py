"""Data-quality checks: each is one aggregate and one row ``check_id, name, status, value``.

``status`` is pass, fail or insufficient_data (no rows on a side that the check compares).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import great_circle_km, grid_lat, grid_lon



def open_rate(where: Column) -> Column:
    return F.avg(F.when(where, F.col("open").cast("double")))


def path_km() -> Column:
    return great_circle_km(grid_lat(F.col("tx_field")), grid_lon(F.col("tx_field")), grid_lat(F.col("rx_field")), grid_lon(F.col("rx_field")))


def middle_lon() -> Column:
    """Mean longitude of both ends, on the short way round."""
    a, b = grid_lon(F.col("tx_field")), grid_lon(F.col("rx_field"))
    return F.pmod(a + (F.pmod(b - a + 540, F.lit(360.0)) - 180) / 2 + 540, F.lit(360.0)) - 180


def _row(agg: DataFrame, number: int, name: str, enough: Column, value: Column, passes) -> DataFrame:
    v = F.when(F.coalesce(enough, F.lit(False)), value)
    status = F.when(v.isNull(), "insufficient_data").when(passes(v), "pass").otherwise("fail")
    return agg.select(F.lit(number).alias("check_id"), F.lit(name).alias("name"), status.alias("status"), v.cast("double").alias("value"))


def _day_night(labels: DataFrame, number: int, name: str, bands: list[str], near: Column, least: float, by_day: bool) -> DataFrame:
    rows = labels.where(F.col("band").isin(*bands) & near).withColumn("local", F.pmod(F.hour("window_start") + middle_lon() / 15, F.lit(24.0)))
    agg = rows.agg(open_rate(F.col("local").between(12, 17)).alias("day"), open_rate((F.col("local") >= 22) | (F.col("local") <= 3)).alias("night"))
    num, den = ("day", "night") if by_day else ("night", "day")
    return _row(agg, number, name, F.col(den) > 0, F.col(num) / F.col(den), lambda v: v > least)


def diurnal(labels: DataFrame) -> DataFrame:
    return _day_night(labels, 1, "20m_diurnal", ["20m"], path_km().between(3000, 8000), 2.0, True)


def low_band(labels: DataFrame) -> DataFrame:
    return _day_night(labels, 2, "lowband_diurnal", ["160m", "80m"], path_km() > 2000, 5.0, False)


def gray_line(labels: DataFrame, band: str = "40m") -> DataFrame:
    """Needs the solar features. The value is the difference of the open rates at the terminator and at midday."""
    agg = labels.where((F.col("band") == band) & (path_km() > 6000)).agg(open_rate(F.abs("midpoint_hours_since_terminator") <= 1).alias("edge"), open_rate(F.col("midpoint_solar_zenith") <= 30).alias("noon"))
    return _row(agg, 3, "grayline_40m", F.col("edge").isNotNull() & F.col("noon").isNotNull(), F.col("edge") - F.col("noon"), lambda v: v > 0)


def sporadic_e(labels: DataFrame, band: str = "6m") -> DataFrame:
    month = F.month("window_start")
    agg = labels.where((F.col("band") == band) & path_km().between(1000, 2300)).agg(open_rate(month.isin(5, 6, 7)).alias("summer"), open_rate(month.isin(11, 12, 1)).alias("winter"))
    return _row(agg, 4, "sporadic_e_seasonal", F.col("winter") > 0, F.col("summer") / F.col("winter"), lambda v: v >= 3)


def reciprocity(labels: DataFrame) -> DataFrame:
    rate = labels.groupBy("tx_field", "rx_field", "band", F.month("window_start").alias("month")).agg(F.avg(F.col("open").cast("double")).alias("there"))
    back = rate.select(F.col("rx_field").alias("tx_field"), F.col("tx_field").alias("rx_field"), "band", "month", F.col("there").alias("back"))
    agg = rate.join(back, ["tx_field", "rx_field", "band", "month"]).agg(F.corr("there", "back").alias("r"), F.count("*").alias("n"))
    return _row(agg, 5, "reciprocity", F.col("n") >= 5, F.col("r"), lambda v: v > 0.6)


def solar_cycle(labels: DataFrame, band: str = "10m", least_months: int = 12) -> DataFrame:
    """Needs ``f107_daily``."""
    monthly = labels.where((F.col("band") == band) & (path_km() > 6000)).groupBy(F.date_trunc("MONTH", "window_start").alias("month")).agg(F.avg(F.col("open").cast("double")).alias("rate"), F.avg("f107_daily").alias("flux"))
    agg = monthly.agg(F.corr("rate", "flux").alias("r"), F.count("*").alias("n"))
    return _row(agg, 6, "solar_cycle", F.col("n") >= least_months, F.col("r"), lambda v: v > 0.5)


def storm_response(labels: DataFrame) -> DataFrame:
    """Needs ``kp_now`` and ``midpoint_geomag_lat``."""
    polar = labels.where(F.abs("midpoint_geomag_lat") > 60).groupBy("band", F.hour("window_start").alias("hour"), F.month("window_start").alias("month"))
    matched = polar.agg(open_rate(F.col("kp_now") >= 6).alias("storm"), open_rate(F.col("kp_now") <= 2).alias("quiet"))
    agg = matched.where("storm is not null and quiet > 0").agg(F.avg(F.col("storm") / F.col("quiet")).alias("ratio"))
    return _row(agg, 7, "storm_response", F.col("ratio").isNotNull(), F.col("ratio"), lambda v: v <= 0.5)


def volume(reasons: DataFrame) -> DataFrame:
    """From reject counts by ``reason``, qualifying ones under ``qualifying``."""
    agg = reasons.agg((F.sum(F.when(F.col("reason") == "rr73_grid", F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    return _row(agg, 8, "volume_hygiene", F.lit(True), F.coalesce("share", F.lit(0.0)), lambda v: v < 0.005)


def run_checks(labels: DataFrame, reasons: DataFrame) -> DataFrame:
    """All eight checks; those whose features ``labels`` lacks report insufficient data."""
    have = set(labels.columns)
    lacking = lambda number, name: labels.sparkSession.range(1).select(F.lit(number).alias("check_id"), F.lit(name).alias("name"), F.lit("insufficient_data").alias("status"), F.lit(None).cast("double").alias("value"))
    out = diurnal(labels).unionByName(low_band(labels))
    out = out.unionByName(gray_line(labels) if {"midpoint_hours_since_terminator", "midpoint_solar_zenith"} <= have else lacking(3, "grayline_40m"))
    out = out.unionByName(sporadic_e(labels)).unionByName(reciprocity(labels))
    out = out.unionByName(solar_cycle(labels) if "f107_daily" in have else lacking(6, "solar_cycle"))
    out = out.unionByName(storm_response(labels) if {"kp_now", "midpoint_geomag_lat"} <= have else lacking(7, "storm_response"))
    return out.unionByName(volume(reasons))
