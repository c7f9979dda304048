"""Leaf-wise gradient boosting on histograms: the trees of a binary classifier, grown on a distributed table.

Values are binned once; missing ones have a bin of their own, and each split learns to which side they go. A round sums
gradients by leaf, feature and bin in the tasks, then by key; the smaller child of a split is summed, its sibling is the
parent less it. What the driver holds is bounded by leaves x features x bins, whatever the number of rows. Sums are whole
numbers of a fixed scale, so that they don't depend on the order of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import staged

#: The bin of missing values; others are numbered from 0.
MISSING_BIN = 255
_CELLS = 256
#: After so many trees the rows' scores are stored; later trees are applied as rows are read.
STORE_EVERY = 10


@dataclass
class Params:
    trees: int = 2000
    leaves: int = 127
    rate: float = 0.05
    least_rows: int = 100
    least_hessian: float = 1e-3
    bins: int = 255
    feature_share: float = 0.8
    row_share: float = 0.8
    patience: int = 50
    seed: int = 42


@dataclass
class Tree:
    """Nodes as arrays: inner ones have a feature, the last bin that goes left, and the side of missing values."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool) -> tuple[int, int]:
        for _ in range(2):
            for values, x in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, 0.0)):
                values.append(x)
        self.feature[node], self.cut[node], self.missing_left[node] = feature, cut, missing_left
        self.left[node], self.right[node] = len(self.feature) - 2, len(self.feature) - 1
        return self.left[node], self.right[node]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, cut, missing, left, right = (np.asarray(v) for v in (self.feature, self.cut, self.missing_left, self.left, self.right))
        node = np.zeros(len(x), np.int64)
        todo = np.flatnonzero(feature[node] >= 0)
        while len(todo):
            at = node[todo]
            b = x[todo, feature[at]]
            go_left = np.where(b == MISSING_BIN, missing[at], b <= cut[at])
            node[todo] = np.where(go_left, left[at], right[at])
            todo = todo[feature[node[todo]] >= 0]
        return node

    def values(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.leaves(x)]


def bins_of(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bins of a matrix of values: bin k ends with the k-th edge."""
    out = np.full(x.shape, MISSING_BIN, np.uint8)
    for j, e in enumerate(edges):
        known = ~np.isnan(x[:, j])
        out[known, j] = np.searchsorted(np.asarray(e), x[known, j], side="left")
    return out


def best_split(hist: np.ndarray, features: list[int], p: Params) -> tuple[float, int, int, bool] | None:
    """``gain, feature, cut, missing_left`` of a leaf's ``features x bins x (gradient, hessian, rows)`` sums, or none.

    Gain is what the leaf's loss falls by, to second order: the sum of g^2/h of both sides less that of the leaf.
    """
    g, h, n = (hist[:, :, i] for i in range(3))
    total = hist[features[0]].sum(0)
    best = None
    for missing_left in (True, False):
        run = np.cumsum(hist[:, :MISSING_BIN], axis=1)
        left = run + hist[:, MISSING_BIN:] if missing_left else run
        right = total - left
        ok = (left[:, :, 2] >= p.least_rows) & (right[:, :, 2] >= p.least_rows) & (left[:, :, 1] >= p.least_hessian) & (right[:, :, 1] >= p.least_hessian)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, left[:, :, 0] ** 2 / left[:, :, 1] + right[:, :, 0] ** 2 / right[:, :, 1] - total[0] ** 2 / total[1], -np.inf)
        gain = gain[features]
        j, cut = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[j, cut] > 1e-9 and (best is None or gain[j, cut] > best[0] + 1e-9):
            best = (float(gain[j, cut]), features[j], int(cut), missing_left)
    return best


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-s))


def _matrix(b: pa.RecordBatch, n_features: int) -> np.ndarray:
    if not b.num_rows:
        return np.zeros((0, n_features), np.uint8)
    return np.stack([np.frombuffer(v, np.uint8) for v in b.column("x").to_pylist()])


def _in_bag(tag: np.ndarray, seed: int, share: float) -> np.ndarray:
    x = tag.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53 < share


def _summing(state):
    """Rows ``slot, feature, bin, g, h, n`` of a task's histograms; slot -1 has the loss of the late rows and their weight."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = state.value
        slots, k, scale = s["slots"], s["features"], s["scale"]
        sums = np.zeros((len(slots), k, _CELLS, 3), np.int64)
        slot_of = np.full(len(s["tree"].feature), -1)
        for i, node in enumerate(slots):
            slot_of[node] = i
        loss = np.zeros(2)
        for b in batches:
            x = _matrix(b, k)
            y, w, late, tag, score = (np.asarray(b.column(c)) for c in ("y", "w", "late", "tag", "score"))
            for t in s["recent"]:
                score = score + t.values(x)
            p = _sigmoid(score)
            if s["loss"] and late.any():
                q = np.clip(p[late], 1e-15, 1 - 1e-15)
                loss += [np.sum(-w[late] * np.where(y[late] > 0.5, np.log(q), np.log(1 - q))), w[late].sum()]
            slot = slot_of[s["tree"].leaves(x)]
            use = np.flatnonzero((slot >= 0) & ~late & _in_bag(tag, s["seed"], s["share"]))
            if not len(use):
                continue
            slot, p, y, w = slot[use], p[use], y[use], w[use]
            g, h = np.rint(w * (p - y) * scale).astype(np.int64), np.rint(w * p * (1 - p) * scale).astype(np.int64)
            base = slot * _CELLS
            for j in range(k):
                at = base + x[use, j]
                for i, v in ((0, g), (1, h), (2, None)):
                    add = np.bincount(at, minlength=len(slots) * _CELLS) if v is None else _whole_sums(at, v, len(slots) * _CELLS)
                    sums[:, j, :, i] += add.reshape(len(slots), _CELLS).astype(np.int64)
        at = np.nonzero(sums[:, :, :, 2])
        cols = [*at, *(sums[(*at, i)] for i in range(3))]
        if s["loss"] and loss[1] > 0:
            cols = [np.append(c, v) for c, v in zip(cols, (-1, 0, 0, round(loss[0] * scale), round(loss[1] * scale), 0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (np.int32, np.int32, np.int32, np.int64, np.int64, np.int64), strict=True)], ["slot", "feature", "bin", "g", "h", "n"])

    return run


def _whole_sums(at: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole numbers: in two halves, each of which a double holds."""
    high, low = v >> 26, v & ((1 << 26) - 1)
    return (np.bincount(at, high, n).astype(np.int64) << 26) + np.bincount(at, low, n).astype(np.int64)


def _with_scores(trees):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, score = _matrix(b, 0), np.asarray(b.column("score"))
            for t in trees.value:
                score = score + t.values(x) if len(score) else score
            yield b.set_column(b.schema.get_field_index("score"), "score", pa.array(score))

    return run


_ROW = "x binary, y double, w double, late boolean, tag long, score double"


class HistogramBoosting:
    """``fit`` on columns of numbers, then ``predict`` adds a score. ``late`` rows decide when to stop and aren't learned from."""

    def __init__(self, features: list[str], params: Params | None = None):
        self.features, self.params = list(features), params or Params()
        self.edges: list[list[float]] = []
        self.trees: list[Tree] = []
        self.start, self.losses = 0.0, []

    # --- fitting

    def _binned(self, df: DataFrame, y: str, w: str, late: str) -> DataFrame:
        edges, names = self.edges, self.features

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.stack([b.column(f"_x{j}").to_numpy(zero_copy_only=False).astype(float) for j in range(len(names))], axis=1) if b.num_rows else np.zeros((0, len(names)))
                rows = pa.array([r.tobytes() for r in bins_of(x, edges)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows, *(b.column(c) for c in ("y", "w", "late", "tag")), pa.array(np.full(b.num_rows, self_start))], ["x", "y", "w", "late", "tag", "score"])

        self_start = self.start
        cols = [F.col(f"`{c}`").cast("double").alias(f"_x{j}") for j, c in enumerate(names)]
        rows = df.select(*cols, F.col(y).cast("double").alias("y"), F.col(w).cast("double").alias("w"), F.col(late).alias("late"), F.xxhash64(F.monotonically_increasing_id()).alias("tag"))
        return staged(rows.mapInArrow(run, _ROW))

    def fit(self, df: DataFrame, y: str = "y", w: str = "w", late: str = "late") -> HistogramBoosting:
        p, spark = self.params, df.sparkSession
        steps = [i / p.bins for i in range(1, p.bins)]
        early = F.when(~F.col(late), 1)
        known = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
        facts = df.agg(*[F.percentile_approx(known(c), F.array(*[F.lit(s) for s in steps]), F.lit(20 * p.bins)).alias(f"e{j}") for j, c in enumerate(self.features)], F.sum(early * F.col(w) * F.col(y)).alias("wy"), F.sum(early * F.col(w)).alias("w"), F.sum(w).alias("all"), F.count("*").alias("n")).first()
        self.edges = [sorted(set(facts[f"e{j}"] or [])) for j in range(len(self.features))]
        if not facts["n"] or not facts["w"]:
            raise ValueError("there are no rows to learn from")
        share = min(max(facts["wy"] / facts["w"], 1e-6), 1 - 1e-6)
        self.start, self.trees, self.losses = math.log(share / (1 - share)), [], []
        # the largest power of two at which all sums stay well within 62 bits
        scale = 2.0 ** min(40, 60 - math.ceil(math.log2(max(facts["all"], facts["n"], 2) * 40)))
        table, recent, best = self._binned(df, y, w, late), [], (math.inf, 0)
        for number in range(p.trees + 1):
            rng = np.random.default_rng([p.seed, number])
            usable = sorted(rng.choice(len(self.features), max(1, round(p.feature_share * len(self.features))), replace=False).tolist())

            def sums(tree: Tree, slots: list[int], loss: bool = False, number=number):
                state = spark.sparkContext.broadcast({"tree": tree, "recent": recent, "slots": slots, "features": len(self.features), "scale": scale, "seed": p.seed * 100_003 + number, "share": p.row_share, "loss": loss})
                got = table.mapInArrow(_summing(state), "slot int, feature int, bin int, g long, h long, n long").groupBy("slot", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas()
                state.unpersist()
                out = np.zeros((len(slots), len(self.features), _CELLS, 3))
                own = got[got.slot >= 0]
                for i, (c, by) in enumerate((("g", scale), ("h", scale), ("n", 1))):
                    out[own.slot, own.feature, own.bin, i] = own[c] / by
                held = got[got.slot < 0]
                return out, (float(held.g.sum() / held.h.sum()) if len(held) else None)

            tree = Tree()
            root, loss = sums(tree, [0], True)
            if loss is not None:
                self.losses.append(loss)
                if loss < best[0] - 1e-12:
                    best = (loss, number)
                if number - best[1] >= p.patience:
                    break
            if number == p.trees or root[0][0, :, 2].sum() == 0:
                break
            tree = self._grown(tree, root[0], usable, sums)
            if tree.feature[0] < 0:
                break
            self.trees.append(tree)
            recent.append(tree)
            if len(recent) == STORE_EVERY:
                table, recent = staged(table.mapInArrow(_with_scores(spark.sparkContext.broadcast(recent)), _ROW)), []
        if self.losses:
            self.trees = self.trees[: best[1]]
        return self

    def _grown(self, tree: Tree, root: np.ndarray, usable: list[int], sums) -> Tree:
        """The tree that splits the leaf of greatest gain, again and again.

        Children are summed for several leaves in one pass: all that would be split by what is known so far. The order is
        then gone through again, until it asks for nothing unknown.
        """
        p = self.params
        hist, split = {0: root}, {0: best_split(root, usable, p)}
        while True:
            chosen, ready, need = [], [0], []
            while len(chosen) < p.leaves - 1:
                ready = [n for n in ready if split[n]]
                if not ready:
                    break
                node = max(ready, key=lambda n: (split[n][0], -n))
                ready.remove(node)
                chosen.append(node)
                if tree.feature[node] < 0:
                    need.append(node)
                else:
                    ready += [tree.left[node], tree.right[node]]
            if not need:
                break
            small, large = [], []
            for node in need:
                _, feature, cut, missing_left = split[node]
                left, right = tree.split(node, feature, cut, missing_left)
                n = hist[node][feature, :, 2]
                on_left = n[: cut + 1].sum() + (n[MISSING_BIN] if missing_left else 0)
                small.append(left if 2 * on_left <= n.sum() else right)
                large.append(right if small[-1] == left else left)
            got, _ = sums(tree, small)
            for node, a, b, h in zip(need, small, large, got, strict=True):
                hist[a], hist[b] = h, hist[node] - h
                for child in (a, b):
                    split[child] = best_split(hist[child], usable, p)
        return self._pruned(tree, set(chosen), hist, usable[0])

    def _pruned(self, tree: Tree, chosen: set[int], hist: dict[int, np.ndarray], feature: int) -> Tree:
        out = Tree()
        todo = [(0, 0)]
        while todo:
            node, at = todo.pop()
            if node in chosen:
                left, right = out.split(at, tree.feature[node], tree.cut[node], tree.missing_left[node])
                todo += [(tree.left[node], left), (tree.right[node], right)]
            else:
                g, h, _ = hist[node][feature].sum(0)
                out.value[at] = float(-self.params.rate * g / h) if h > 0 else 0.0
        return out

    # --- using

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of a matrix of values."""
        b = bins_of(x, self.edges)
        s = np.full(len(x), self.start)
        for t in self.trees:
            s += t.values(b)
        return _sigmoid(s)

    def predict(self, df: DataFrame, column: str = "score") -> DataFrame:
        """The model goes to every task; its size is that of ``trees`` x ``leaves``."""
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(row: pd.DataFrame) -> pd.Series:
            return pd.Series(model.value.scores(row.to_numpy(dtype=float, na_value=np.nan)))

        return df.withColumn(column, score(F.struct(*[F.col(f"`{c}`").cast("double").alias(f"_x{j}") for j, c in enumerate(self.features)])))

    def to_dict(self) -> dict:
        return {"features": self.features, "params": asdict(self.params), "edges": self.edges, "start": self.start, "trees": [asdict(t) for t in self.trees]}

    @classmethod
    def from_dict(cls, d: dict) -> HistogramBoosting:
        out = cls(d["features"], Params(**d["params"]))
        out.edges, out.start, out.trees = d["edges"], d["start"], [Tree(**t) for t in d["trees"]]
        return out
