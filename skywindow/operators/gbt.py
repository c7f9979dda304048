"""Boosted trees with isotonic calibration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .boosting import HistogramBoosting, Params
from .features import FEATURE_COLUMNS
from .isotonic import Isotonic

#: Shared by trees and calibration: the last part of the training time.
TAIL_SHARE = 0.15


def tail_start(labels: DataFrame, share: float = TAIL_SHARE) -> DataFrame:
    """One row: the time at which the last ``share`` of the rows begins, from counts by window."""
    per = labels.groupBy("window_start").agg(F.count("*").alias("n"))
    run = per.withColumn("below", F.sum("n").over(Window.orderBy("window_start"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return run.where(F.col("below") > F.col("all") * (1 - share)).agg(F.min("window_start").alias("tail_start"))


class GBT:
    """``fit`` then ``predict``; ``save`` and ``load`` refuse a model of other features.

    Trees learn from the rows before the tail, the tail decides when to stop and is what calibration learns from. Sample
    weights count in both. ``more`` overrides single values of ``boosting.Params``.
    """

    def __init__(self, features: list[str] | None = None, **more):
        self.features = list(features or FEATURE_COLUMNS)
        self.params = Params(**more)
        self.model: HistogramBoosting | None = None
        self.calibration: Isotonic | None = None

    def fit(self, df: DataFrame) -> GBT:
        weight = F.col("sample_weight").cast("double") if "sample_weight" in df.columns else F.lit(1.0)
        late = tail_start(df)
        rows = df.crossJoin(F.broadcast(late)).select(  # one row
            *[F.col(c).cast("double").alias(c) for c in self.features], F.col("open").cast("double").alias("_y"), weight.alias("_w"), (F.col("window_start") >= F.col("tail_start")).alias("_late")
        )
        self.model = HistogramBoosting(self.features, self.params).fit(rows, "_y", "_w", "_late")
        self.calibration = Isotonic().fit(self.model.predict(rows.where("_late"), "_raw"), "_raw", "_y", "_w")
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.model is None or self.calibration is None:
            raise RuntimeError("predict before fit")
        out = self.calibration.predict(self.model.predict(df, "_raw"), "_raw", "_p")
        return out.select(*df.columns, F.col("_p").alias("p_open"))

    def save(self, spark, path: str) -> None:
        if self.model is None or self.calibration is None:
            raise RuntimeError("save before fit")
        text = json.dumps({"features": self.features, "trees": self.model.to_dict(), "calibration": {"x": self.calibration.x, "y": self.calibration.y}})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark, path: str, features: list[str] | None = None) -> GBT:
        d = json.loads(spark.read.text(path).first().value)
        if d["features"] != list(features or FEATURE_COLUMNS):
            raise ValueError("the saved model has other features")
        out = cls(d["features"], **d["trees"]["params"])
        out.model, out.calibration = HistogramBoosting.from_dict(d["trees"]), Isotonic(d["calibration"]["x"], d["calibration"]["y"])
        return out
