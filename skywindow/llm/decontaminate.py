"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is split into k + 1 pieces: in any text that holds the item within k edits,
one piece at least stands unchanged. Texts and pieces are searched by the 64-bit hash of the pieces' first ``GRAM`` code
points; a hit that has the whole piece is verified with Myers' bit-parallel distance over the window that the item would
fill, so nothing is reported on a hash alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import flat, settled, sliced, tagged
from .textvec import U, mix

#: Edits in per cent of an item's length, rounded down: at 6 % a piece has 15 code points or more.
ERROR_PERCENT = 6
#: Code points of a piece that are looked up; shorter pieces mean a smaller budget for their item.
GRAM = 12
#: Items that one broadcast holds, and code points of all of them; more items are searched in further passes.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000


def normal(texts: pa.Array) -> pa.Array:
    """Lower case, every run of other characters than letters, marks and digits as one blank, no blank at the ends."""
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), r"[^\p{L}\p{M}\p{N}]+", " "), " ")


def gram_hashes(points: np.ndarray) -> np.ndarray:
    n = len(points) - GRAM + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.zeros(n, U)
    p = points.astype(U)
    for j in range(GRAM):
        h *= U(0x9E3779B97F4A7C15)
        h += p[j : j + n]
    return mix(h)


def budget(length: int) -> int:
    """The edits that an item of this length may have: its share, but no more than pieces of ``GRAM`` code points allow."""
    return max(0, min(length * ERROR_PERCENT // 100, length // GRAM - 1))


def myers(pattern: str, text: str, k: int) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a part of ``text``, and where the first such part ends; (k + 1, -1) if over k."""
    m = len(pattern)
    if not m:
        return 0, 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, k + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass
class Items:
    """A block of items: their normal texts, budgets, and pieces sorted by hash."""

    ids: list
    texts: list[str]
    budgets: list[int]
    hashes: np.ndarray
    item: np.ndarray
    start: np.ndarray
    length: np.ndarray


def split_items(ids: list, texts: list[str]) -> Items:
    budgets = [budget(len(t)) for t in texts]
    hashes, item, start, length = [], [], [], []
    for k, (t, b) in enumerate(zip(texts, budgets, strict=True)):
        points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        h = gram_hashes(points)
        if not len(h):
            continue  # shorter than a piece: nothing can be told from so short an item
        cuts = [len(t) * i // (b + 1) for i in range(b + 2)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            hashes.append(h[a])
            item.append(k)
            start.append(a)
            length.append(z - a)
    hashes_ = np.array(hashes, U)
    order = np.argsort(hashes_, kind="stable")
    pick = lambda x: np.array(x, np.int64)[order]
    return Items(ids, texts, budgets, hashes_[order], pick(item), pick(start), pick(length))


def _find(model, item_type: pa.DataType, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    items: Items = model.value
    sieve = np.zeros(1 << 20, bool)
    sieve[(items.hashes & U((1 << 20) - 1)).astype(np.int64)] = True
    for b in sliced(batches):
        if not len(items.hashes):
            return
        texts = normal(b.column("text"))
        data, offs = flat(texts)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        bounds = lead[offs]
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        h = gram_hashes(points)
        maybe = np.flatnonzero(sieve[(h & U((1 << 20) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(items.hashes, h[maybe], "left"), np.searchsorted(items.hashes, h[maybe], "right")
        maybe, lo, hi = maybe[hi > lo], lo[hi > lo], hi[hi > lo]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        tried: dict[tuple[int, int], int] = {}
        doc = np.searchsorted(bounds, maybe, "right") - 1
        text_of: dict[int, str] = {}
        for at, d, x, y in zip(maybe.tolist(), doc.tolist(), lo.tolist(), hi.tolist(), strict=True):
            text = text_of.get(d)
            if text is None:
                text = text_of[d] = texts[d].as_py()
            place = at - int(bounds[d])
            for p in range(x, y):
                i, s, n = int(items.item[p]), int(items.start[p]), int(items.length[p])
                t, k = items.texts[i], items.budgets[i]
                if text[place : place + n] != t[s : s + n]:
                    continue
                begin, z = place - s - k, place - s + len(t) + k
                # the window of another piece at the same distance was the same one
                if best.get((d, i), (1,))[0] == 0 or tried.get((d, i)) == begin:
                    continue
                tried[(d, i)] = begin
                a = max(0, begin)
                window = text[a:z]
                j = window.find(t)
                dist, end = (0, j + len(t)) if j >= 0 else myers(t, window, k)
                if dist <= k and (dist, a) < best.get((d, i), (k + 1, 0))[:2]:
                    best[(d, i)] = (dist, a, a + end)
        rows = sorted(best.items())
        ids = b.column("doc_id").take(pa.array([d for (d, _), _ in rows], pa.int64()))
        tags = b.column("__tag").take(pa.array([d for (d, _), _ in rows], pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [tags, ids, pa.array([items.ids[i] for (_, i), _ in rows], item_type), pa.array([v[0] for _, v in rows], pa.int64()), pa.array([v[2] for _, v in rows], pa.int64()), pa.array([len(items.texts[i]) for (_, i), _ in rows], pa.int64())],
            ["__tag", "doc_id", "item_id", "distance", "match_end", "item_length"],
        )


def _blocks(items: DataFrame) -> Iterator[Items]:
    """The items in blocks of proven size, one at a time; an item's text counts as it is after ``normal``."""
    ids, texts, size = [], [], 0
    for row in items.toLocalIterator():
        t = normal(pa.array([row.text], pa.string()))[0].as_py()
        if ids and (len(ids) >= BLOCK_ITEMS or size + len(t) > BLOCK_CHARS):
            yield split_items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row.item_id)
        texts.append(t)
        size += len(t)
    yield split_items(ids, texts)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Each document and test item that it holds: ``__tag, doc_id, item_id, distance, match_end, item_length``.

    A document holds an item if a part of its normal text is within the item's budget of edits. Null or empty texts hold
    nothing; items whose normal text is null, empty or shorter than ``GRAM`` are never held. Equal items are each
    reported; repeated rows of ``docs`` each have rows. Empty tables give an empty result. The benchmark is a query set:
    it is broadcast in blocks of bounded size, one pass over the documents for each block.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text")).orderBy("item_id", "text")
    rows = tagged(docs, id_col, text_col)
    item = items.schema["item_id"]
    item_type = to_arrow_type(item.dataType)
    schema = f"__tag long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {item.dataType.simpleString()}, distance long, match_end long, item_length long"
    out = None
    for block in _blocks(items):
        got = rows.mapInArrow(partial(_find, spark.sparkContext.broadcast(block), item_type), schema)
        out = got if out is None else out.unionByName(got)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their columns as they are."""
    docs = settled(docs)
    hit = leaks(docs, benchmark, id_col, text_col).select("__tag").distinct()
    rows = docs.withColumn("__tag", F.monotonically_increasing_id())
    return rows.join(hit, "__tag", "left_anti").drop("__tag")
