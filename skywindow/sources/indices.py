"""Readers of space-weather and solar-cycle series."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Places (from 0) of the words in a line of the hourly series, and the values that stand for no value.
OMNI_WORDS = {"bz_gsm": 16, "solar_wind_speed": 24, "kp": 38, "dst": 40, "f107": 50}
OMNI_FILL = {"bz_gsm": 999.9, "solar_wind_speed": 9999.0, "kp": 99.0, "dst": 99999.0, "f107": 999.9}


def kp_of(raw: Column) -> Column:
    """Ten times Kp, in thirds: units 0, 3 and 7 are 0, a third and two thirds; others, and 99, are no value."""
    unit = raw % 10
    third = F.when(unit == 0, 0.0).when(unit == 3, 1 / 3).when(unit == 7, 2 / 3)
    return F.when(raw != 99, F.floor(raw / 10) + third)


def read_omni2(spark: SparkSession, path: str) -> DataFrame:
    """``time, kp, f107, bz_gsm, solar_wind_speed, dst`` from white-space separated hourly lines."""
    w = F.split(F.trim("value"), r"\s+")
    word = lambda k: F.get(w, F.lit(k)).try_cast("double")
    v = {n: F.when(word(k) != OMNI_FILL[n], word(k)) for n, k in OMNI_WORDS.items()}
    v["kp"] = kp_of(word(OMNI_WORDS["kp"]).cast("long"))
    start = F.make_timestamp(word(0).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))
    time = F.timestamp_seconds(F.unix_seconds(start) + (word(1).cast("long") - 1) * 86400 + word(2).cast("long") * 3600)
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(time.alias("time"), *[v[n].alias(n) for n in ("kp", "f107", "bz_gsm", "solar_wind_speed", "dst")])


def read_definitive_kp(spark: SparkSession, path: str) -> DataFrame:
    """``block_start, kp`` of definitive three-hour blocks; a malformed line is an error, ``#`` and blank lines are skipped."""
    w = F.split(F.trim("value"), r"\s+")
    ok = (F.size(w) == 10) & F.forall(w, lambda x: x.try_cast("double").isNotNull())
    lines = spark.read.text(path).where((F.length(F.trim("value")) > 0) & ~F.ltrim("value").startswith("#"))
    w = F.when(ok, w).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), F.col("value"))))
    rows = lines.select(w.alias("w"))
    n = lambda k: F.col("w")[k].cast("double")
    day = F.make_timestamp(n(0).cast("int"), n(1).cast("int"), n(2).cast("int"), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))
    return rows.where(n(9) == 1).select(F.timestamp_seconds(F.unix_seconds(day) + (n(3) * 3600).cast("long")).alias("block_start"), n(7).alias("kp"))


def read_ssn(spark: SparkSession, path: str, months: Iterable[str] | None = None) -> DataFrame:
    """``month, ssn`` from a JSON list: the smoothed number, or the observed one where it is not out yet.

    With ``months`` (``YYYY-MM``) only those; one that isn't in the list is an error.
    """
    raw = spark.read.schema("`time-tag` string, ssn double, smoothed_ssn double").option("multiLine", True).json(path)
    series = raw.select(F.col("time-tag").alias("month"), F.when(F.col("smoothed_ssn") >= 0, F.col("smoothed_ssn")).otherwise(F.col("ssn")).alias("ssn"))
    if months is None:
        return series
    asked = spark.createDataFrame([(m,) for m in sorted(set(months))], "month string")
    known = asked.join(series.withColumn("_there", F.lit(True)), "month", "left")
    gone = F.raise_error(F.concat(F.lit("no sunspot number for "), F.col("month")))
    return known.where(F.when(F.col("_there"), F.lit(True)).otherwise(gone.cast("boolean"))).select("month", "ssn")
