"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Texts become hashed term vectors (character shapes, letters and word repetition; tf-idf), a truncated SVD of a bounded
sample of labelled texts gives the latent space, and every text is scored by the labels of its nearest labelled vectors,
weighted by cosine similarity. The labelled vectors are broadcast; cosine products are computed in blocks, against all of
them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, sliced, tagged
from .textvec import U, Words, mix

#: Hashed terms, latent dimensions, neighbours, and the bound on labelled texts that are learned from.
TERMS, DIMS, NEIGHBOURS, SAMPLE = 2048, 48, 25, 4000
FOLDS, CUT = 5, 0.3
#: Similarities count with this power, so that near neighbours outweigh far ones.
POWER = 8
#: Texts whose cosine products are computed at a time: 512 x SAMPLE floats are 8 MB.
BLOCK = 512

_SHAPE = np.full(256, 1, np.uint8)  # 1: letters beyond ASCII; punctuation stands for itself
_SHAPE[[*range(0x61, 0x7B)]] = 2
_SHAPE[[*range(0x41, 0x5B)]] = 3
_SHAPE[[*range(0x30, 0x3A)]] = 4
_SHAPE[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 5
_SHAPE[0x0A] = 6
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _SHAPE[_c] = _c


def _groups(doc: np.ndarray, key: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    return doc, (mix(key.astype(U), seed) % U(TERMS)).astype(np.int64)


def term_counts(texts: pa.Array) -> np.ndarray:
    """Counts of hashed terms of each text, as a texts x TERMS matrix."""
    w = Words(texts, plain=False)
    n = len(w.count)
    doc = np.repeat(np.arange(n), np.diff(w.offs))
    shape = _SHAPE[w.data].astype(np.uint32)
    # runs of one shape count as two at most, so that long words and short ones look alike
    new = np.ones(len(shape), bool)
    new[2:] = (shape[2:] != shape[1:-1]) | (shape[2:] != shape[:-2])
    s, d = shape[new], doc[new]
    found = []
    for k in (1, 2, 4):
        if len(s) >= k:
            key = np.zeros(len(s) - k + 1, np.uint32)
            for j in range(k):
                key = key * np.uint32(131) + s[j : len(s) - k + 1 + j]
            same = d[k - 1 :] == d[: len(d) - k + 1]
            found.append(_groups(d[k - 1 :][same], key[same], k))
    # words by their last bytes and how they repeat: the distance, in doublings, to the same word before
    wd = np.repeat(np.arange(n), w.count)
    order = np.lexsort((np.arange(len(w.hash)), w.hash, wd))
    gap = np.full(len(w.hash), 15, np.int64)
    same = (w.hash[order][1:] == w.hash[order][:-1]) & (wd[order][1:] == wd[order][:-1])
    gap[order[1:][same]] = np.minimum(np.log2(np.diff(order)[same]).astype(np.int64), 14)
    found.append(_groups(wd, gap, 11))
    if len(gap) > 2:
        same = wd[2:] == wd[:-2]
        found.append(_groups(wd[2:][same], (gap[:-2] * 256 + gap[1:-1] * 16 + gap[2:])[same], 12))
    found.append(_groups(wd, _SHAPE[w.data[w.end - 1]].astype(np.int64) * 256 + _SHAPE[w.data[w.start]], 13) if len(w.hash) else (wd, wd))
    d = np.concatenate([x for x, _ in found])
    t = np.concatenate([x for _, x in found])
    return np.bincount(d * TERMS + t, minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)


def _sample_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, limit=1 << 19):
        x = term_counts(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("label"), binaries(x.reshape(-1), np.arange(len(x) + 1) * TERMS)], ["key", "label", "terms"])


def _fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the sample, whose bound bounds this task's memory, as one row of packed arrays."""
    x, y = [np.zeros((0, TERMS), np.float32)], [np.zeros(0)]
    for b in batches:
        x.append(np.stack([np.frombuffer(t, np.float32) for t in b.column("terms").to_pylist()]) if b.num_rows else x[0])
        y.append(b.column("label").to_numpy(zero_copy_only=False))
    m = Model.of(np.concatenate(x), np.concatenate(y))
    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (m.idf, m.axes, m.v, m.y)], ["idf", "axes", "v", "y"])


class Model:
    """Latent space and labelled vectors. Without labelled texts every score is ``prior``."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray, v: np.ndarray, y: np.ndarray):
        self.idf, self.axes, self.v, self.y = idf, axes, v, y
        self.prior = float(y.mean(dtype=np.float64)) if len(y) else 0.5

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> Model:
        idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(1)
        m = cls(idf, np.zeros((TERMS, DIMS), np.float32), np.zeros((len(x), DIMS), np.float32), y.astype(np.float32))
        gram = np.zeros((TERMS, TERMS))
        for a in range(0, len(x), BLOCK):
            z = m.weigh(x[a : a + BLOCK]).astype(np.float64)
            gram += z.T @ z
        m.axes = np.linalg.eigh(gram)[1][:, ::-1][:, :DIMS].astype(np.float32)
        for a in range(0, len(x), BLOCK):
            m.v[a : a + BLOCK] = m.unit(m.weigh(x[a : a + BLOCK]) @ m.axes)
        return m

    def weigh(self, x: np.ndarray) -> np.ndarray:
        share = x / np.maximum(x.sum(1, keepdims=True), 1)
        return self.unit(np.log1p(share * 1000) * self.idf)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        k = min(NEIGHBOURS, len(self.y))
        for a in range(0, len(x), BLOCK) if k else ():
            q = self.unit(self.weigh(x[a : a + BLOCK]) @ self.axes)
            cos = q @ self.v.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            sim = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** POWER
            votes = sim.sum(1)
            out[a : a + BLOCK] = np.where(votes > 0, (sim * self.y[near]).sum(1) / np.where(votes > 0, votes, 1), self.prior)
        return np.clip(out, 0, 1)


def _held_out(c: str):
    return F.coalesce(F.crc32(F.col(c).cast("string")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` labelled ids outside the held-out fold, the first in the order of a hash.

    Repeated labels of an id are averaged; null labels and ids are left out; an id with several texts counts the first in
    the order of code points. A task fits the model, whose arrays (1.2 MB at 4,000 texts) are all that the driver sees.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{label_col}`").cast("double").alias("label")).where(F.col("key").isNotNull() & F.col("label").isNotNull() & ~_held_out("key"))
    known = known.groupBy("key").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("key"), "key").limit(sample)
    rows = docs.select(F.col(f"`{id_col}`").alias("key"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    chosen = rows.join(F.broadcast(known), "key").groupBy("key").agg(F.min("label").alias("label"), F.min("text").alias("text"))  # at most `sample` ids
    key_type = chosen.schema["key"].dataType.simpleString()
    terms = chosen.mapInArrow(_sample_terms, f"key {key_type}, label double, terms binary").repartition(1).sortWithinPartitions("key")
    packed = terms.mapInArrow(_fit, "idf binary, axes binary, v binary, y binary").collect()
    if not packed:
        return Model.of(np.zeros((0, TERMS), np.float32), np.zeros(0))
    idf, axes, v, y = (np.frombuffer(x, np.float32) for x in packed[0])
    return Model(idf, axes.reshape(TERMS, DIMS), v.reshape(-1, DIMS), y)


def _score(model, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, limit=1 << 19):
        s = np.concatenate([model.value.scores(term_counts(b.column("text").slice(a, BLOCK))) for a in range(0, b.num_rows, BLOCK)])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], ["doc_id", b.schema.names[1], "score"])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, held_out, score, predicted`` (1 if score >= 0.3).

    Null texts count as empty; an empty text has no term and scores the share of label 1 among the learned labels. A null
    id is not held out. Without any label the score is 0.5. Repeated rows each keep a row; an empty table gives an empty
    result; other columns are not looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col, label_col))
    rows = tagged(docs, id_col, text_col).select("doc_id", _held_out("doc_id").alias("held_out"), "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(lambda it: _score(model, it), f"doc_id {id_type}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with their columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col, label_col))
    at = docs.columns.index(text_col)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sliced([batch], text_col, 1 << 19):
                s = np.concatenate([model.value.scores(term_counts(b.column(at).slice(a, BLOCK))) for a in range(0, b.num_rows, BLOCK)])
                yield b.filter(pa.array(s >= CUT))

    return docs.mapInArrow(keep, docs.schema)
