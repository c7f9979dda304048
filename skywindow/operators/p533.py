"""The circuit-reliability scorer: keyed, cached, opaque; its card, its report, and the closed form of its last step.

The engine's coefficient files are not public here, so the scorer is a function that the caller passes in.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import grid_lat, grid_lon
from ..schema import DIAL_MHZ, EARTH_KM, literal_map

KEY = ["tx_field", "rx_field", "band", "month", "hour", "ssn_round"]
_KEY_TYPES = ("string", "string", "string", "int", "int", "int")
#: Buckets of the score cache. A reader must know the number that it was written with.
BUCKETS = 64
NOISE_WATTS_DB = 204.0
# Hour-to-hour deciles of the signal.
HOUR_UPPER_DB, HOUR_LOWER_DB = 5.0, 8.0
#: Of the closed form: sender's power, required signal-to-noise ratio, day-to-day decile.
POWER_DBW, REQUIRED_DB, DAY_DB = 20.0, 20.0, 8.0


def card(tx_lat: Column, tx_lon: Column, rx_lat: Column, rx_lon: Column, month: Column, hour: Column, ssn: Column, mhz: Column, data_dir: str) -> Column:
    """The engine's input text; months and hours out of range are errors, hours count from 1."""
    month = F.when(month.between(1, 12), month).otherwise(F.raise_error(F.concat(F.lit("month "), month.cast("string"))))
    hour = F.when(hour.between(0, 23), hour).otherwise(F.raise_error(F.concat(F.lit("hour "), hour.cast("string"))))
    # The names and constants of the engine's input format.
    at = lambda name, lat, lon: [(f"{name}.lat %.4f", lat), (f"{name}.lng %.4f", lon)]
    lines = [
        ('PathName "path"', None), ('PathTXName "tx"', None), *at("Path.L_tx", tx_lat, tx_lon), ('PathRXName "rx"', None), *at("Path.L_rx", rx_lat, rx_lon),
        ('TXAntFilePath "ISOTROPIC"', None), ('RXAntFilePath "ISOTROPIC"', None), ("Path.year 2026", None), ("Path.month %d", month.cast("int")), ("Path.hour %d", (hour + 1).cast("int")),
        ("Path.SSN %.0f", F.bround(ssn).cast("double")), ("Path.frequency %.4f", mhz), ("Path.txpower -10.0", None), ("Path.BW 2500.0", None), ("Path.SNRr -21.0", None),
        ('Path.SorL "SHORTPATH"', None), ('Path.ManMadeNoise "RURAL"', None), ('RptFilFormat "RPT_BCR | RPT_SNR"', None),
        *[x for corner in ("LL", "LR", "UL", "UR") for x in at(corner, rx_lat, rx_lon)], (f'DataFilePath "{data_dir}/"', None),
    ]
    return F.format_string("".join(f"{t}\n" for t, _ in lines), *[c for _, c in lines if c is not None])


def parse_report(text: str) -> tuple[float, float]:
    """BCR and SNR of a report: columns by their declared names, values from the first row of numbers after the heading."""
    place = {name.upper(): int(k) - 1 for k, name in re.findall(r"^Column\s+(\d+):\s*(\S+)\s*-", text, re.MULTILINE)}
    if not {"BCR", "SNR"} <= place.keys():
        raise ValueError("the report declares no BCR and SNR columns")
    body = re.split(r"^.*Calculated Parameters(?! End).*$", text, maxsplit=1, flags=re.MULTILINE)
    for line in body[1].splitlines() if len(body) > 1 else ():
        values = line.split(",")
        try:
            return float(values[place["BCR"]]), float(values[place["SNR"]])
        except (IndexError, ValueError):
            continue
    raise ValueError("the report has no row of values")


def with_keys(labels: DataFrame, ssn: DataFrame) -> DataFrame:
    """Adds the scorer's key; the sunspot number rounds half to even, a month without one has none."""
    month = F.date_format("window_start", "yyyy-MM").alias("_month")
    rows = labels.withColumn("_month", month).join(ssn.select(F.col("month").alias("_month"), F.bround("ssn").cast("int").alias("ssn_round")), "_month", "left")
    return rows.drop("_month").withColumns({"month": F.month("window_start"), "hour": F.hour("window_start")})


class ScoreCache:
    """Scores by key as a bucketed table at ``path``: asked keys are dealt to the buckets, the cache stays where it is.

    The files are all that lasts: the table is declared anew in each session, over what is there.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.name = "scores_" + hashlib.md5(f"{self.path} {buckets}".encode()).hexdigest()
        columns = ", ".join(f"{k} {t}" for k, t in zip(KEY, _KEY_TYPES, strict=True))
        where = self.path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, bcr double) USING parquet CLUSTERED BY ({', '.join(KEY)}) INTO {buckets} BUCKETS LOCATION '{where}'")

    def read(self) -> DataFrame:
        """One row a key. Rows of one bucket are in one task already, so that nothing is shuffled."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name).groupBy(*KEY).agg(F.max("bcr").alias("bcr"))

    def add(self, scored: DataFrame) -> None:
        """Scores of new keys; the task that has a bucket's keys writes its file."""
        scored.select(*KEY, "bcr").repartition(self.buckets, *KEY).write.insertInto(self.name)


class KeyedScorer:
    """Scores each distinct key once. ``scorer(keys) -> list of reliability in per cent, or None`` is called by partition.

    ``cache`` is the path of a bucketed table of scores (see ``ScoreCache``): known keys are not scored again, new ones are
    added. Null means that the model abstains: an engine error, a missing sunspot number, or a band above 30 MHz.
    """

    def __init__(self, scorer: Callable[[pd.DataFrame], list], ssn: DataFrame, cache: str | None = None):
        self.scorer, self.ssn, self.cache = scorer, ssn, cache

    def fit(self, labels: DataFrame) -> KeyedScorer:
        return self

    def _score(self, keys: DataFrame) -> DataFrame:
        scorer = self.scorer

        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f[KEY].assign(bcr=pd.Series(scorer(f), index=f.index, dtype="float64"))

        mhz = F.element_at(literal_map(DIAL_MHZ), F.col("band"))
        asked = keys.select(*KEY, mhz.alias("mhz"), *[c(F.col(f"{s}_field")).alias(f"{s}_{n}") for s in ("tx", "rx") for n, c in (("lat", grid_lat), ("lon", grid_lon))])
        asked = asked.where("ssn_round is not null and mhz between 1 and 30")
        return asked.mapInPandas(run, ", ".join(f"{k} {t}" for k, t in zip(KEY, _KEY_TYPES, strict=True)) + ", bcr double")

    def missing(self, rows: DataFrame, cache: ScoreCache) -> DataFrame:
        """The distinct keys of ``with_keys`` rows that the cache doesn't have."""
        asked = rows.select(*KEY).where("ssn_round is not null").distinct().repartition(cache.buckets, *KEY)
        return asked.join(cache.read().select(*KEY).hint("shuffle_merge"), KEY, "left_anti")

    def predict(self, df: DataFrame) -> DataFrame:
        rows = with_keys(df, self.ssn)
        if self.cache is None:
            return self._joined(df, rows, self._score(rows.select(*KEY).distinct()))
        cache = ScoreCache(df.sparkSession, self.cache)
        cache.add(self._score(self.missing(rows, cache)))
        return self._joined(df, rows.repartition(cache.buckets, *KEY), cache.read().hint("shuffle_merge"))

    @staticmethod
    def _joined(df: DataFrame, rows: DataFrame, scored: DataFrame) -> DataFrame:
        return rows.join(scored, KEY, "left").select(*df.columns, (F.col("bcr") / 100).alias("p_open"))


def sample_keys(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` distinct keys, the first in the order of a seeded hash: the same in every run."""
    return rows.select(*KEY).distinct().orderBy(F.xxhash64(F.lit(seed), *KEY), *KEY).limit(n)


def cross_check(model: KeyedScorer, keys: DataFrame, path: str) -> tuple[int, int]:
    """Scores the keys into a CSV table in the folder ``path``; how many were scored, and how many the engine failed on."""
    scored = model._score(keys)
    scored.where("bcr is not null").select(*KEY, F.format_string("%.4f", "bcr").alias("bcr")).write.mode("errorifexists").option("header", True).csv(path)
    done = keys.sparkSession.read.option("header", True).csv(path).count()
    return done, keys.count() - done


def closed_form(keys: pd.DataFrame) -> np.ndarray:
    """A scorer without coefficient files: free-space loss, daytime absorption and three noises into the last step's form."""
    a, b, c, d = (np.radians(keys[n].to_numpy(float)) for n in ("tx_lat", "tx_lon", "rx_lat", "rx_lon"))
    half = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    km, mhz = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, half))), keys["mhz"].to_numpy(float)
    high_sun = np.maximum(0, np.cos(2 * np.pi * (keys["hour"].to_numpy(float) - 12) / 24))
    loss = 32.45 + 20 * np.log10(np.maximum(km, 1) * mhz) + 40 * high_sun * (7 / mhz) ** 2
    noise = (52 - 23 * np.log10(mhz), 67.2 - 27.7 * np.log10(mhz), 40 - mhz + keys["ssn_round"].to_numpy(float) / 20)
    margin = POWER_DBW - loss - 10 * np.log10(sum(10 ** (x / 10) for x in noise)) - 10 * np.log10(2500) + NOISE_WATTS_DB - REQUIRED_DB
    upper, lower = (np.hypot(DAY_DB, x) for x in (HOUR_UPPER_DB, HOUR_LOWER_DB))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(margin >= 0, np.minimum(130 - 80 / (1 + margin / lower), 100), np.maximum(80 / (1 - margin / upper) - 30, 0))


def snr_db(receiver_power: Column, noise: list[Column], bandwidth_hz: Column) -> Column:
    return receiver_power - 10 * F.log10(sum((F.pow(F.lit(10.0), x / 10) for x in noise[1:]), F.pow(F.lit(10.0), noise[0] / 10))) - 10 * F.log10(bandwidth_hz) + NOISE_WATTS_DB


def decile(noise: list[Column], shifted: list[Column], day: Column, hour: float) -> Column:
    """Root sum square of the noise's change, the day-to-day and the hour-to-hour deviation."""
    total = lambda xs: sum((F.pow(F.lit(10.0), x / 10) for x in xs[1:]), F.pow(F.lit(10.0), xs[0] / 10))
    change = 10 * F.log10(total(shifted) / total(noise))
    return F.sqrt(change * change + day * day + hour * hour)


def basic_reliability(snr: Column, required: Column, upper: Column, lower: Column) -> Column:
    """Basic circuit reliability in per cent."""
    margin = snr - required
    above = F.least(130 - 80 / (1 + margin / lower), F.lit(100.0))
    below = F.greatest(80 / (1 - margin / upper) - 30, F.lit(0.0))
    return F.when(margin >= 0, above).otherwise(below)
