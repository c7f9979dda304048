"""Trees and calibration against brute force."""

import math

import numpy as np
import pytest

from skywindow.operators.boosting import MISSING_BIN, HistogramBoosting, Params, Tree, best_split, bins_of
from skywindow.operators.isotonic import Isotonic, pooled


def table(spark, n=1500, seed=3, features=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, features)), 1)
    x[rng.random((n, features)) < 0.2] = np.nan
    p = 1 / (1 + np.exp(-(np.nan_to_num(x[:, 0], nan=1.5) * 2 - (np.nan_to_num(x[:, 1]) > 0.3) + 0.2)))
    y, w = (rng.random(n) < p).astype(float), rng.choice([1.0, 2.5], n)
    late = np.arange(n) >= int(0.8 * n)
    names = [f"f{j}" for j in range(features)]
    rows = [(*[None if math.isnan(v) else float(v) for v in r], float(a), float(b), bool(c)) for r, a, b, c in zip(x, y, w, late, strict=True)]
    return x, y, w, late, names, spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", y double, w double, late boolean")


def brute_split(x, y, w, start, least_rows):
    """The best of all splits of all values, missing ones on either side."""
    p = 1 / (1 + math.exp(-start))
    g, h = w * (p - y), w * p * (1 - p)
    best = (0, None)
    for j in range(x.shape[1]):
        lost = np.isnan(x[:, j])
        for cut in np.unique(x[~lost, j]):
            for missing_left in (True, False):
                left = np.where(lost, missing_left, x[:, j] <= cut)
                if min(left.sum(), (~left).sum()) < least_rows:
                    continue
                gain = g[left].sum() ** 2 / h[left].sum() + g[~left].sum() ** 2 / h[~left].sum() - g.sum() ** 2 / h.sum()
                if gain > best[0] + 1e-7:
                    best = (gain, (j, cut, missing_left))
    return best


def test_first_split_is_the_best_of_all(spark):
    x, y, w, late, names, df = table(spark)
    m = HistogramBoosting(names, Params(trees=1, leaves=2, rate=1.0, least_rows=20, feature_share=1.0, row_share=1.0)).fit(df)
    early = ~late
    gain, (j, cut, missing_left) = brute_split(x[early], y[early], w[early], m.start, 20)
    t = m.trees[0]
    assert m.start == pytest.approx(math.log((w * y)[early].sum() / (w * (1 - y))[early].sum()))
    left = np.where(np.isnan(x[:, j]), missing_left, x[:, j] <= cut)
    got = t.leaves(bins_of(x, m.edges))
    assert len(set(got)) == 2 and (len({tuple(r) for r in np.stack([left, got], 1)}) == 2), (gain, t)
    p = 1 / (1 + math.exp(-m.start))
    for side in (True, False):
        rows = early & (left == side)
        assert t.values(bins_of(x, m.edges))[left == side][0] == pytest.approx(-(w * (p - y))[rows].sum() / (w * p * (1 - p))[rows].sum(), abs=1e-6)


def test_grows_by_the_greatest_gain(spark):
    """The tree of eight leaves is that of a plain loop that always splits the leaf of greatest gain."""
    x, y, w, late, names, df = table(spark, seed=8)
    par = Params(trees=1, leaves=8, rate=1.0, least_rows=10, feature_share=1.0, row_share=1.0)
    m = HistogramBoosting(names, par).fit(df)
    early = ~late
    b, p = bins_of(x, m.edges)[early], 1 / (1 + math.exp(-m.start))
    g, h = w[early] * (p - y[early]), np.full(early.sum(), p * (1 - p)) * w[early]

    def hist(rows):
        out = np.zeros((len(names), 256, 3))
        for j in range(len(names)):
            for i, v in enumerate((g, h, np.ones(len(g)))):
                out[j, :, i] = np.bincount(b[rows, j], v[rows], 256)
        return out

    tree, members = Tree(), {0: np.arange(len(b))}
    while len(members) < 8:
        found = {n: best_split(hist(r), list(range(len(names))), par) for n, r in members.items()}
        found = {n: s for n, s in found.items() if s}
        node = max(found, key=lambda n: found[n][0])
        _, f, cut, ml = found[node]
        left, right = tree.split(node, f, cut, ml)
        rows = members.pop(node)
        go = np.where(b[rows, f] == MISSING_BIN, ml, b[rows, f] <= cut)
        members[left], members[right] = rows[go], rows[~go]
    a, c = tree.leaves(b), m.trees[0].leaves(b)
    assert len(set(zip(a, c, strict=True))) == len(set(a)) == len(set(c)) == 8


def test_learns_stops_and_is_the_same_in_any_partitioning(spark):
    x, y, w, late, names, df = table(spark, n=3000)
    par = Params(trees=60, leaves=6, rate=0.3, least_rows=20, patience=5)
    m = HistogramBoosting(names, par).fit(df)
    assert 0 < len(m.trees) < 60 and min(m.losses) < m.losses[0] - 0.05
    assert len(m.losses) == len(m.trees) + 6  # the best number of trees, and five that were no better
    got = m.predict(df, "s").select("s").toPandas().s.to_numpy()
    assert np.allclose(got, m.scores(x)) and np.mean((got - y) ** 2) < np.mean((y.mean() - y) ** 2) * 0.85
    again = HistogramBoosting.from_dict(m.to_dict())
    assert np.allclose(again.scores(x), m.scores(x))


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None, float(k % 2), 1.0, k > 30) for k in range(40)], "a double, b double, y double, w double, late boolean")
    m = HistogramBoosting(["a", "b"], Params(trees=3, least_rows=1)).fit(df)
    assert m.trees == [] and [r.s for r in m.predict(df, "s").collect()] == [pytest.approx(1 / (1 + math.exp(-m.start)))] * 40
    with pytest.raises(ValueError):
        HistogramBoosting(["a"]).fit(df.where("late"))


def brute_isotonic(x, y, w):
    """Means of pooled neighbours by the min-max formula."""
    keys = np.unique(x)
    sw, sy = np.array([w[x == k].sum() for k in keys]), np.array([(w * y)[x == k].sum() for k in keys])
    mean = lambda a, b: sy[a : b + 1].sum() / sw[a : b + 1].sum()
    return keys, np.array([max(min(mean(a, b) for b in range(i, len(keys))) for a in range(i + 1)) for i in range(len(keys))])


def test_isotonic(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.random(300), 2)
    y, w = (rng.random(300) < x**2).astype(float), rng.choice([1.0, 3.0], 300)
    keys, want = brute_isotonic(x, y, w)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, w, strict=True)], "score double, y double, w double").repartition(7)
    m = Isotonic().fit(df)
    assert np.allclose(np.interp(keys, m.x, m.y), want)
    got = {r.score: r.p_open for r in m.predict(df).collect()}
    assert all(got[k] == pytest.approx(v) for k, v in zip(keys, want, strict=True))
    assert [r.p_open for r in m.predict(spark.createDataFrame([(-1.0,), (2.0,)], "score double")).collect()] == [pytest.approx(want[0]), pytest.approx(want[-1])]


def test_pooling_in_any_grouping_is_the_same():
    rng = np.random.default_rng(4)
    lo, w = np.arange(200.0), rng.integers(1, 5, 200).astype(float)
    wy = w * rng.integers(0, 2, 200)
    whole = pooled(lo, lo, w, wy)
    for cuts in ([50], [3, 80, 81, 150]):
        parts = [pooled(*(v[a:b] for v in (lo, lo, w, wy))) for a, b in zip([0, *cuts], [*cuts, 200], strict=True)]
        again = pooled(*(np.concatenate([p[i] for p in parts]) for i in range(4)))
        assert all(np.array_equal(a, b) for a, b in zip(again, whole, strict=True))
