"""The climatology model: how often a cell was open at an hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("tx_field", "rx_field", "band", "hour")


def with_hour(df: DataFrame) -> DataFrame:
    return df.withColumn("hour", F.hour("window_start")).withColumn("month", F.month("window_start"))


class Climatology:
    """``fit`` then ``predict``; cells that were never seen get the overall rate. ``keys`` may add ``month``."""

    def __init__(self, keys: tuple[str, ...] = KEYS):
        self.keys = list(keys)
        self.rates: DataFrame | None = None
        self.overall: DataFrame | None = None

    def fit(self, labels: DataFrame) -> Climatology:
        rows = with_hour(labels)
        sums = rows.groupBy(*self.keys).agg(F.sum(F.col("open").cast("long")).alias("o"), F.count("open").alias("n"))
        self.rates = sums.select(*self.keys, (F.col("o") / F.col("n")).alias("p"), "n")
        self.overall = sums.agg((F.sum("o") / F.sum("n")).alias("p_all"))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.rates is None or self.overall is None:
            raise RuntimeError("predict before fit")
        out = with_hour(df).join(self.rates.select(*self.keys, "p"), self.keys, "left").crossJoin(F.broadcast(self.overall))  # one row
        return out.select(*df.columns, F.coalesce("p", "p_all").alias("p_open"))
