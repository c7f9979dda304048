"""Isotonic calibration by mergeable pooled blocks.

Pooling adjacent violators gives the same blocks in whatever order neighbours are pooled. So scores are summed by distinct
value, dealt by ranges, pooled within each range, and what is left of the ranges is pooled again: no task holds all scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks that one place pools at a time; more are pooled by ranges once more.
AT_ONCE = 200_000
_BLOCK = "lo double, hi double, w double, wy double"


def pooled(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, wy: np.ndarray) -> list[np.ndarray]:
    """Neighbouring blocks, in order, pooled until their means ascend."""
    out: list[list[float]] = []
    for block in zip(lo.tolist(), hi.tolist(), w.tolist(), wy.tolist(), strict=True):
        out.append(list(block))
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, hi_, w_, wy_ = out.pop()
            out[-1][1] = hi_
            out[-1][2] += w_
            out[-1][3] += wy_
    return [np.array([b[i] for b in out]) for i in range(4)]


def _pool(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks = [np.zeros(0)] * 4
    for b in batches:  # a batch is pooled into what the ones before it have left
        blocks = pooled(*(np.concatenate([have, np.asarray(b.column(c))]) for have, c in zip(blocks, ("lo", "hi", "w", "wy"), strict=True)))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in blocks], ["lo", "hi", "w", "wy"])


class Isotonic:
    """The ascending step through the blocks, with straight lines between them; ends are held."""

    def __init__(self, x: list[float] | None = None, y: list[float] | None = None):
        self.x, self.y = x or [], y or []

    def fit(self, df: DataFrame, score: str = "score", y: str = "y", w: str = "w") -> Isotonic:
        blocks = df.groupBy(F.col(score).alias("lo")).agg(F.sum(w).alias("w"), F.sum(F.col(w) * F.col(y)).alias("wy")).where("w > 0").select("lo", F.col("lo").alias("hi"), "w", "wy")
        while True:
            blocks = blocks.repartitionByRange("lo").sortWithinPartitions("lo").mapInArrow(_pool, _BLOCK).persist()
            n = blocks.count()
            if n <= AT_ONCE:
                break
            blocks = blocks.repartition(max(1, n // AT_ONCE))
        got = blocks.orderBy("lo").toPandas()
        blocks.unpersist()
        lo, hi, weight, wy = pooled(*(got[c].to_numpy() for c in ("lo", "hi", "w", "wy")))
        mean = np.clip(wy / weight, 0, 1) if len(weight) else weight
        x, m = np.stack([lo, hi], 1).reshape(-1), np.repeat(mean, 2)
        keep = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)
        self.x, self.y = x[keep].tolist(), m[keep].tolist()
        return self

    def predict(self, df: DataFrame, score: str = "score", column: str = "p_open") -> DataFrame:
        if not self.x:
            raise RuntimeError("predict before fit")
        x, y = self.x, self.y

        @F.pandas_udf("double")
        def calibrated(s: pd.Series) -> pd.Series:
            return pd.Series(np.interp(s.to_numpy(), x, y))

        return df.withColumn(column, calibrated(F.col(score)))
