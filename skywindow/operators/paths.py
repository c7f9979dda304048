"""Seeded samples of paths out of one stream of random numbers, drawn in tasks: the same rows in any partitioning.

Rows are drawn one after the other from one generator (PCG64). A task jumps to where its stretch begins if no draw before it
was rejected, which is nearly always so; stretches whose beginning turns out otherwise are drawn again from there.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DIAL_MHZ


@dataclass(frozen=True)
class Draw:
    """A column: whole numbers from ``low`` to below ``high``, or with ``digits`` an even real number, rounded."""

    name: str
    low: float
    high: float
    digits: int | None = None


# What the cross-check's paths are drawn from, in the order of drawing.
PATH = (Draw("tx_lat", -60, 60, 2), Draw("tx_lon", -180, 180, 2), Draw("rx_lat", -60, 60, 2), Draw("rx_lon", -180, 180, 2), Draw("band", 0, len(DIAL_MHZ)), Draw("month", 1, 13), Draw("hour", 0, 24), Draw("ssn", 5, 200))
STRETCH = 10_000


def seed_of(label: str) -> int:
    return int.from_bytes(hashlib.sha256(label.encode()).digest()[:8], "big") & 0xFFFFFFFF


def _state(seed: int, words: int) -> dict:
    bits = np.random.PCG64(seed)
    bits.advance(words)
    return bits.state


def _words(draws: tuple[Draw, ...]) -> int:
    """Words of 64 bits that a row takes if nothing is rejected: one for a real number, half of one for a whole number."""
    whole = sum(d.digits is None for d in draws)
    if whole % 2:
        raise ValueError("an even number of whole numbers a row keeps the rows aligned")
    return len(draws) - whole // 2


def _drawn(draws: tuple[Draw, ...], state: dict, n: int) -> tuple[list[tuple], dict]:
    rng = np.random.Generator(np.random.PCG64())
    rng.bit_generator.state = state
    rows = [tuple(float(rng.integers(int(d.low), int(d.high))) if d.digits is None else round(float(rng.uniform(d.low, d.high)), d.digits) for d in draws) for _ in range(n)]
    return rows, rng.bit_generator.state


def drawn(spark: SparkSession, n: int, seed: int, draws: tuple[Draw, ...], stretch: int = STRETCH) -> DataFrame:
    """``place`` and a column of doubles for each draw: the first ``n`` rows of the stream."""
    count, words = -(-n // stretch), _words(draws)
    moved: dict[int, dict] = {}  # where stretches begin that don't where they would
    size = lambda s: min(stretch, n - s * stretch)

    def begin(s: int, moved: dict[int, dict]) -> dict:
        return moved.get(s) or _state(seed, words * s * stretch)

    def ends(moved):
        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for s in f["id"]:
                    _, end = _drawn(draws, begin(s, moved), size(s))
                    if s + 1 < count and end != begin(s + 1, moved):
                        yield pd.DataFrame({"s": [s + 1], "state": [str(end)]})

        return run

    todo = spark.range(0, count, 1, min(count, 1000) or 1)
    while True:  # a stretch that moves may move the next one
        found = {r.s: ast.literal_eval(r.state) for r in todo.mapInPandas(ends(dict(moved)), "s long, state string").collect()}
        if not found:
            break
        moved |= found
        todo = spark.createDataFrame([(s,) for s in sorted(found)], "id long")

    def rows(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for s in f["id"]:
                got, _ = _drawn(draws, begin(s, moved), size(s))
                out = pd.DataFrame(got, columns=[d.name for d in draws])
                out.insert(0, "place", np.arange(s * stretch, s * stretch + len(out)))
                yield out

    return spark.range(0, count, 1, min(count, 1000) or 1).mapInPandas(rows, "place long, " + ", ".join(f"{d.name} double" for d in draws))


def sample_paths(spark: SparkSession, n: int, label: str, stretch: int = STRETCH) -> DataFrame:
    """``n`` different paths: ``place, tx_lat, tx_lon, rx_lat, rx_lon, band, month, hour, ssn``, in the order of drawing."""
    names, bands, drawn_n = [d.name for d in PATH], sorted(DIAL_MHZ), n
    while True:
        first = drawn(spark, drawn_n, seed_of(label), PATH, stretch).groupBy(*names).agg(F.min("place").alias("place"))
        missing = n - first.count()
        if missing <= 0:
            break
        drawn_n += missing
    first = first.orderBy("place").limit(n)
    band = F.element_at(F.array(*[F.lit(b) for b in bands]), F.col("band").cast("int") + 1)
    return first.select("place", *names[:4], band.alias("band"), F.col("month").cast("int").alias("month"), F.col("hour").cast("int").alias("hour"), "ssn")
