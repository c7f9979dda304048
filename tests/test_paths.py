"""Paths of the seeded sampler against numpy's own generator."""

import numpy as np
import pytest

from skywindow.operators.paths import PATH, Draw, drawn, sample_paths, seed_of
from skywindow.schema import DIAL_MHZ


def plain(n, seed, draws):
    rng = np.random.Generator(np.random.PCG64(seed))
    return [tuple(float(rng.integers(int(d.low), int(d.high))) if d.digits is None else round(float(rng.uniform(d.low, d.high)), d.digits) for d in draws) for _ in range(n)]


@pytest.mark.parametrize("stretch", [7, 40, 1000])
def test_paths_are_those_of_one_generator(spark, stretch):
    got = [tuple(r) for r in sample_paths(spark, 100, "a check", stretch).orderBy("place").collect()]
    bands = sorted(DIAL_MHZ)
    want = [(k, *r[:4], bands[int(r[4])], int(r[5]), int(r[6]), r[7]) for k, r in enumerate(plain(100, seed_of("a check"), PATH))]
    assert got == want


def test_rejected_draws_move_what_follows(spark):
    """Of a range of 3e9, a third of the draws are rejected."""
    draws = (Draw("a", 0, 3_000_000_000), Draw("x", 0, 1, 9), Draw("b", 0, 2_900_000_000))
    got = sorted(tuple(r) for r in drawn(spark, 60, 5, draws, 9).collect())
    assert got == [(k, *r) for k, r in enumerate(plain(60, 5, draws))]


def test_no_rows_and_uneven_rows(spark):
    assert drawn(spark, 0, 1, PATH).collect() == []
    with pytest.raises(ValueError):
        drawn(spark, 3, 1, PATH[:5])
