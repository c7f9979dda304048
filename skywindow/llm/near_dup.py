"""Near-duplicate documents by ProbMinHash.

Each distinct five-word shingle, weighted by how often the text has it, sends a Poisson process of arrivals at that rate to
random registers; a register keeps the shingle that arrives first. Two texts agree in a register with the probability
Jaccard similarity of their weighted shingles. Arrivals end early, once every register of the text is sure to be taken.
Bands of registers bring candidates together, the exact similarity of their shingles verifies them, and connected
components of verified pairs are the classes. Equal word sequences are one candidate throughout.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, TAG, settled, sliced, stash, tagged
from .graph import components, contracted, leader_pairs, relabelled
from .textvec import U, Words, mix, shingle_counts

SHINGLE, SIMILAR = 5, 0.8
#: 20 bands of 6 registers: a pair of similarity 0.8 is a candidate with probability 0.998, one of 0.5 with 0.27.
BANDS, ROWS = 20, 6
REGISTERS = BANDS * ROWS
#: Buckets up to this size are compared whole; larger ones by about so many leaders. Both grow by GROWTH each round; texts
#: that are already in one component aren't compared again.
SMALL, LEADERS, GROWTH = 12, 3, 16
#: A candidate pair is verified if so many of its registers agree (by one byte each): a pair of similarity 0.8 has 96 of
#: 120 on average and misses this with probability 0.003; verification itself is exact.
LEAST_AGREE = 84
#: Texts that are still open after the first round get a finer sketch of so many registers; a pair of similarity 0.8 agrees in
#: 384 on average and misses the least with probability 0.003.
FINE, LEAST_FINE = 480, 360


CARRIED = ("band", "bands", "marks", "n_shingles", "plain", "own", "fine", "part")


def _exponential(key: np.ndarray, seed: int) -> np.ndarray:
    u = ((mix(key, seed) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
    return -np.log(u)


def registers(doc: np.ndarray, sh: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """The n x m registers of texts given as text number, shingle and weight; 0 where a text has no shingle."""
    out = np.zeros((n, m), U)
    total = np.bincount(doc, weight, n)
    todo = total > 0
    reach = m * (np.log(m) + 4)
    while todo.any():
        here = todo[doc]
        d, s, w = doc[here], sh[here], weight[here].astype(np.float64)
        limit = reach / total[d]
        slots, times, elems = [], [], []
        t, k = _exponential(s, 101) / w, 0
        while True:
            in_time = t <= limit
            d, s, w, limit, t = d[in_time], s[in_time], w[in_time], limit[in_time], t[in_time]
            if not len(d):
                break
            slots.append(d * m + (mix(s, 5000 + k) % U(m)).astype(np.int64))
            times.append(t)
            elems.append(s)
            k += 1
            if k == 6:  # what is left has many arrivals to come: all of them at once
                mean = (limit - t) * w
                more = np.ceil(mean + 8 * np.sqrt(mean) + 12).astype(np.int64)
                at = np.repeat(np.arange(len(d)), more)
                step = np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more)
                key = mix(s[at] + step.astype(U) * U(0x9E3779B97F4A7C15), 77)
                gap = _exponential(key, 102) / w[at]
                run = np.cumsum(gap)
                run = t[at] + run - np.repeat((run - gap)[np.cumsum(more) - more], more)
                ok = run <= limit[at]
                slots.append((d[at] * m + (mix(key, 103) % U(m)).astype(np.int64))[ok])
                times.append(run[ok])
                elems.append(s[at][ok])
                break
            t = t + _exponential(s, 101 + k * 7) / w
        slot, time_, elem = np.concatenate(slots), np.concatenate(times), np.concatenate(elems)
        order = np.argsort(-time_, kind="stable")  # the earliest is written last
        flat, taken = out.reshape(-1), np.zeros(n * m, bool)
        flat[slot[order]] = elem[order]
        taken[slot] = True
        todo &= ~taken.reshape(n, m).all(1)
        reach *= 2
    return out


def band_keys(reg: np.ndarray) -> np.ndarray:
    key = np.zeros((len(reg), BANDS), U)
    parts = reg.reshape(len(reg), BANDS, ROWS)
    for j in range(ROWS):
        key = mix(key * U(0xD6E8FEB86659FD93) + parts[:, :, j], 3)
    return mix(key + np.arange(BANDS, dtype=U)[None, :], 9)


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        w = Words(b.column("text"))
        doc, sh, count = shingle_counts(*w.shingles(SHINGLE))
        reg = registers(doc, sh, count, b.num_rows)
        keys = band_keys(reg)
        marks = _marks(reg).reshape(-1)
        at = np.arange(len(w.hash)) - np.repeat(w.first[:-1], w.count)
        sums = []
        for seed in (1, 2):
            whole = np.concatenate([[U(0)], np.cumsum(mix(w.hash + at.astype(U) * U(0x9E3779B97F4A7C15), seed))])
            sums.append(mix(whole[w.first[1:]] - whole[w.first[:-1]] + w.count.astype(U), seed).view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view(np.int64)))
        mark_lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * (REGISTERS // 8)), pa.array(marks))
        kinds, total = np.bincount(doc, minlength=b.num_rows), np.bincount(doc, count, b.num_rows)
        cols = [b.column(TAG), b.column("doc_id"), pa.array(w.count), pa.array(sums[0]), pa.array(sums[1]), lists, mark_lists, pa.array(kinds), pa.array(kinds == total)]
        yield pa.RecordBatch.from_arrays(cols, [TAG, "doc_id", "n_words", "h1", "h2", "bands", "marks", "n_shingles", "plain"])


def _marks(reg: np.ndarray) -> np.ndarray:
    """A byte for each register, eight to a number."""
    return (mix(reg, 21) & U(0xFF)).astype(np.uint8).view(np.int64)


def _shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each text."""
    for b in sliced(batches):
        doc, sh, _ = shingle_counts(*Words(b.column("text")).shingles(SHINGLE))
        yield pa.RecordBatch.from_arrays([b.column("t").take(pa.array(doc)), pa.array(sh.view(np.int64))], ["a", "sh"])


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A finer sketch of each text."""
    for b in sliced(batches, limit=SLICE_BYTES >> 2):
        marks = _marks(registers(*shingle_counts(*Words(b.column("text")).shingles(SHINGLE)), b.num_rows, FINE))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * (FINE // 8)), pa.array(marks.reshape(-1)))
        yield pa.RecordBatch.from_arrays([b.column("t"), lists], ["a", "_fine"])


def sharpened(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The open rows with ``fine``, a finer sketch, and ``own``: how many shingles their text has that no other open text has."""
    open_texts = rows.select(F.col("a").alias("t")).distinct()
    texts = stash(texts.join(open_texts.hint("merge"), "t", "left_semi"))
    own = texts.mapInArrow(_shingles, "a long, sh long").groupBy("sh").agg(F.count("*").alias("n"), F.min("a").alias("a")).where("n = 1").groupBy("a").agg(F.count("*").alias("_own"))
    more = texts.mapInArrow(_sketch, "a long, _fine array<long>").join(own, "a", "left")
    return rows.drop("own", "fine").join(more, "a").withColumns({"own": F.coalesce("_own", F.lit(0)).cast("long"), "fine": F.col("_fine")}).drop("_own", "_fine")


def _differing(x: Column, y: Column) -> Column:
    """How many of the eight bytes of two numbers differ."""
    z = x.bitwiseXOR(y)
    for shift in (4, 2, 1):  # a byte that is not 0 ends with its last bit set
        z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
    return F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))


def likely() -> Column:
    """Not yet in one component, enough registers agree, and this bucket is the first that the two share: a pair comes up once.

    Pairs go that can't be similar whatever their texts: what both may have in common is what neither has alone. The bound
    holds for texts that repeat no shingle.
    """
    differ = sum((_differing(F.col("marks")[i], F.col("marks_b")[i]) for i in range(1, REGISTERS // 8)), _differing(F.col("marks")[0], F.col("marks_b")[0]))
    finer = F.aggregate(F.zip_with("fine", "fine_b", _differing), F.lit(0), lambda total, n: total + n)
    first = F.lit(BANDS)
    for i in reversed(range(BANDS)):
        first = F.when(F.col("bands")[i] == F.col("bands_b")[i], i).otherwise(first)
    common = F.least(F.col("n_shingles") - F.col("own"), F.col("n_shingles_b") - F.col("own_b"))
    possible = ~F.col("plain") | ~F.col("plain_b") | (common >= SIMILAR * (F.col("n_shingles") + F.col("n_shingles_b") - common) - 1e-6)
    return (F.col("part") != F.col("part_b")) & possible & (differ <= REGISTERS - LEAST_AGREE) & (first == F.col("band")) & (F.col("fine").isNull() | (finer <= FINE - LEAST_FINE))


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """The exact probability Jaccard similarity of the shingles of each pair of texts."""
    n = len(left)
    sides = [shingle_counts(*Words(x).shingles(SHINGLE)) for x in (left, right)]
    d, s = (np.concatenate([x[i] for x in sides]) for i in (0, 1))
    x = np.concatenate([sides[0][2], np.zeros(len(sides[1][2]), np.int64)])
    y = np.concatenate([np.zeros(len(sides[0][2]), np.int64), sides[1][2]])
    order = np.lexsort((s, d))
    d, s, x, y = d[order], s[order], x[order], y[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return np.zeros(n)
    d, x, y = d[at], np.add.reduceat(x, at), np.add.reduceat(y, at)
    both = (x > 0) & (y > 0)
    out = np.bincount(d[both], minlength=n) / np.maximum(np.bincount(d, minlength=n), 1)
    bounds = np.searchsorted(d, np.arange(n + 1))
    for k in np.unique(d[(x > 1) | (y > 1)]):  # texts that repeat shingles
        a, b = x[bounds[k] : bounds[k + 1]].astype(float), y[bounds[k] : bounds[k + 1]].astype(float)
        common = (a > 0) & (b > 0)
        kinds, many = np.unique(np.stack([a[common], b[common]]), axis=1, return_counts=True)
        out[k] = sum(c / np.maximum(a / p, b / q).sum() for p, q, c in zip(*kinds, many, strict=True))
    return out


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, "text_a", 1 << 19):
        for c in sliced([b], "text_b", 1 << 19):
            s = similarities(c.column("text_a"), c.column("text_b"))
            ids = ["a", "b", "part", "part_b"]
            yield pa.RecordBatch.from_arrays([*(c.column(x) for x in ids), pa.array(s >= SIMILAR - 1e-9)], [*ids, "similar"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``__tag, doc_id, class_id``, the least id of the row's class.

    Shingles are of plain words (see ``textvec``); texts with fewer than five words are one shingle. Texts without words
    (null, empty, only punctuation) are each a class of their own. Repeated rows are one class. A class with null ids
    alone has a null id; null ids never name a class that has others. An empty table gives an empty result.
    """
    rows = tagged(settled(docs), id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    signed = stash(rows.mapInArrow(_sign, f"{TAG} long, doc_id {id_type}, n_words long, h1 long, h2 long, bands array<long>, marks array<long>, n_shingles long, plain boolean"))
    equal = signed.where("n_words > 0").groupBy("h1", "h2").agg(F.min(TAG).alias("rep"))
    member = signed.join(equal, ["h1", "h2"], "left").select(TAG, "doc_id", F.when(F.col("n_words") > 0, F.col("rep")).otherwise(F.col(TAG)).alias("rep"), F.when((F.col("n_words") > 0) & (F.col("rep") == F.col(TAG)), F.col("bands")).alias("bands"), "marks", "n_shingles", "plain")
    member = stash(member)
    keyed = member.where("bands is not null").select(F.posexplode("bands").alias("band", "key"), F.col(TAG).alias("a"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    open_rows = keyed.join(shared, "key").join(member.where("bands is not null").select(F.col(TAG).alias("a"), "bands", "marks", "n_shingles", "plain"), "a")
    open_rows = stash(open_rows.withColumns({"part": F.col("a"), "own": F.lit(0).cast("long"), "fine": F.lit(None).cast("array<long>")}))
    wanted = open_rows.select(F.col("a").alias("t")).distinct()
    texts = stash(rows.select(F.col(TAG).alias("t"), "text").join(wanted.hint("merge"), "t", "left_semi"))
    tested, labels, size = None, None, 1
    while True:
        pairs, large = leader_pairs(open_rows, SMALL * size, LEADERS * size, CARRIED, likely, "own")
        fresh = pairs.select("a", "b", "part", "part_b", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        if tested is not None:
            fresh = fresh.join(tested, ["x", "y"], "left_anti")
        met = fresh.join(texts.toDF("a", "text_a").hint("merge"), "a").join(texts.toDF("b", "text_b").hint("merge"), "b")
        done = stash(met.select("a", "b", "part", "part_b", "text_a", "text_b").mapInArrow(_verify, "a long, b long, part long, part_b long, similar boolean"))
        seen = done.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        tested = seen if tested is None else tested.unionByName(seen)
        # components of what the rounds before have joined, by one confirmed edge for each member and part
        labels = relabelled(labels, components(contracted(done.where("similar").select(F.col("a").alias("from"), F.col("part").alias("a"), F.col("part_b").alias("b")))))
        # large buckets whose members are in several components go on, with more leaders
        parts = large.drop("leads", "part").join(labels.toDF("a", "label"), "a", "left").withColumn("part", F.coalesce("label", "a")).drop("label")
        mixed = parts.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("key")
        open_rows = parts.join(mixed, "key")
        open_rows = stash(sharpened(open_rows, texts) if size == 1 else open_rows)
        if open_rows.isEmpty():
            break
        size *= GROWTH
    named = member.join(labels, member.rep == labels.node, "left").select(TAG, "doc_id", F.coalesce("label", "rep").alias("class"))
    ids = named.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return named.join(ids, "class").select(TAG, "doc_id", "class_id", "class")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one with the least id (null ids last), the first of equal ones."""
    docs = settled(docs)
    named = stash(classes(docs, id_col, text_col))
    kept = named.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", TAG)).alias("first")).select(F.col(f"first.{TAG}").alias(TAG))
    return docs.withColumn(TAG, F.monotonically_increasing_id()).join(kept, TAG, "left_semi").drop(TAG)
