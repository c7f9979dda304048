"""Language identification: multinomial naive Bayes over hashed character n-grams, all languages equally likely at first.

Counts of 1- to 3-grams in ``BUCKETS`` buckets are summed by language over all learning texts in Spark; the matrix of log
probabilities is broadcast in blocks of ``BLOCK_LANGS`` languages, and texts are scored in numpy from their bucket counts,
block after block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, sliced, stash, tagged
from .textvec import U, mix

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
ALPHA = 0.5
#: Languages of one broadcast block of the matrix: 512 x 2^14 floats are 32 MB. More languages are scored in further passes.
BLOCK_LANGS = 512
FOLDS, HELD_OUT = 4, 2


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points with every run of other characters as one blank, text bounds, and letters in each text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    clean = pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), r"[^\p{L}]+", " ")
    clean = pc.binary_join_element_wise(pa.scalar(" "), pc.utf8_trim(clean, " "), pa.scalar(" "), "")
    data, offs = flat(clean)
    lead = (data & 0xC0) != 0x80
    place = np.concatenate([[0], np.cumsum(lead)])
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    bounds = place[offs]
    marks = np.concatenate([[0], np.cumsum(points != 0x20)])
    return points, bounds, marks[bounds[1:]] - marks[bounds[:-1]]


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and bucket of every n-gram, and the letters in each text."""
    points, bounds, n_letters = letters(texts)
    doc = np.repeat(np.arange(len(n_letters)), np.diff(bounds))
    p = points.astype(U)
    docs, buckets = [], []
    for n in ORDERS:
        if len(p) < n:
            continue
        key = p[: len(p) - n + 1].copy()
        for j in range(1, n):
            key = key * U(0x110000) + p[j : len(p) - n + 1 + j]
        same = doc[: len(doc) - n + 1] == doc[n - 1 :]
        docs.append(doc[: len(doc) - n + 1][same])
        buckets.append((mix(key[same], n) % U(BUCKETS)).astype(np.int64))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(docs), join(buckets), n_letters


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts by language: a vector for each language that it met."""
    sums: dict[str, np.ndarray] = {}
    for b in sliced(batches):
        d, k, _ = grams(b.column("text"))
        langs = b.column("lang").to_pylist()
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs])
        got = np.bincount(code[d] * BUCKETS + k, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
        for name, row in zip(names, got, strict=True):
            sums[name] = sums[name] + row if name in sums else row
    for name, row in sums.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(row[at])], ["lang", "bucket", "n"])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Iterator[tuple[list[str], np.ndarray]]:
    """The languages in order of code point and their log probabilities, from the learning folds, block by block."""
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{id_col}`").alias("id"))
    rows = rows.where(~_held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull()).drop("id")
    sums = rows.mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # one row of at most BUCKETS counts for each language: what reaches the driver doesn't grow with the documents
    packed = stash(sums.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")))
    langs = sorted(r.lang for r in packed.select("lang").collect())
    for k in range(0, len(langs), BLOCK_LANGS):
        block = langs[k : k + BLOCK_LANGS]
        got = packed.where(F.col("lang").between(block[0], block[-1])).toArrow().combine_chunks()
        counts = np.full((len(block), BUCKETS), ALPHA)
        for lang, bucket, n in zip(got["lang"].to_pylist(), got["bucket"], got["n"], strict=True):
            counts[block.index(lang), bucket.values.to_numpy()] += n.values.to_numpy()
        yield block, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def _held_out(c: str):
    return F.coalesce(F.crc32(F.col(c).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _predict(model, names: list[str], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores texts against one more block: the best language so far, its log score, and all scores over it, summed."""
    langs, logp = model.value
    for b in sliced(batches):
        d, k, n_letters = grams(b.column("text"))
        n = len(n_letters)
        score = np.zeros((n, len(langs)))
        for j in range(len(langs)):
            score[:, j] = np.bincount(d, logp[j][k], n)
        old, total, top = b.column("best").to_numpy(), b.column("total").to_numpy(), score.max(1)
        known, best = n_letters > 0, np.maximum(old, top)
        total = np.where(known, total * np.exp(old - best) + np.exp(score - best[:, None]).sum(1), total)
        first = pa.array(langs, pa.string()).take(pa.array(score.argmax(1)))
        cols = {"lang_pred": pc.if_else(pa.array(known & (top > old)), first, b.column("lang_pred")), "best": pa.array(np.where(known, best, old)), "total": pa.array(total)}
        yield pa.RecordBatch.from_arrays([cols.get(c, b.column(c)) for c in names], names)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, held_out, lang_pred, score`` (the posterior of ``lang_pred``).

    Learns only from rows with a language whose crc32(id as text) mod 4 is not 2; a null id is not held out. Texts that
    are null or have no letter, and all texts where nothing can be learned, are ``und`` with score 0. Ties go to the
    language first by code point. Repeated rows each count and keep their row; an empty table gives an empty result.
    """
    start = {"lang_pred": F.lit("und"), "best": F.lit(float("-inf")), "total": F.lit(0.0)}
    rows = tagged(docs, id_col, text_col).select("doc_id", _held_out("doc_id").alias("held_out"), "text", *[v.alias(k) for k, v in start.items()])
    spark, fields = docs.sparkSession, {f.name: f"{f.name} {f.dataType.simpleString()}" for f in rows.schema}
    blocks = learn(docs, id_col, text_col, lang_col)
    block = next(blocks, None)
    while block is not None:
        following = next(blocks, None)
        if following is None:
            fields.pop("text")  # read for the last time
        rows = rows.mapInArrow(partial(_predict, spark.sparkContext.broadcast(block), list(fields)), ", ".join(fields.values()))
        block = following
    known = F.col("best") > float("-inf")
    return rows.select("doc_id", "held_out", "lang_pred", F.when(known, 1 / F.col("total")).otherwise(0.0).alias("score"))
