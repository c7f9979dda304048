"""Collocations: phrases that occur more often than their parts would by chance.

Counting every n-gram exactly would shuffle the whole corpus many times over, most of it n-grams seen once. So each slice of text
is summed up by hash partition, and each partition's summaries are merged by Misra and Gries: a summary with more counters
than the partition's mass divided by the threshold keeps every n-gram that reaches it. Words and pairs of words go first,
then phrases of three to five words all of whose pairs were kept. A last pass counts what was kept exactly, by its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat, stash, unstash
from .textvec import U, mix, spans

LONGEST, LEAST, TOP, COVERED_PERCENT = 5, 100, 2000, 100
#: Bytes of text that a task sums up at a time. A longer text is cut behind a mark that ends a piece.
SLICE = 3 << 20
#: Hash partitions: one for so many bytes of text, between these bounds. What merges one holds its counters and BUFFER entries more.
PART_BYTES, LEAST_PARTS, MOST_PARTS, BUFFER = 1 << 20, 256, 1 << 16, 1 << 21
#: What is kept is sent to the tasks as a bit map of so many bits an n-gram, between these bounds (2 MB to 128 MB). Others that
#: fall on its bits are counted as well, and go by their count.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 24, 1 << 30
_SEGMENT = 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _ENDS.copy()
_APART[[0x20, 0x09]] = True


class Slice:
    """Words of a slice of texts: ``id`` of each word, ``piece`` that it is in, ``lang`` number; ``words`` and ``langs`` by number."""

    def __init__(self, texts: list[pa.Array], langs: list[pa.Array]):
        text, lang = pa.concat_arrays(texts), pa.concat_arrays(langs).fill_null("und").dictionary_encode()
        data, offs = flat(text)
        data = _LOWER[data]
        start, end, first = spans(data, offs, _APART)
        doc = np.repeat(np.arange(len(text)), np.diff(first))
        self.piece = np.cumsum(_ENDS[data], dtype=np.int32)[start] + doc if len(start) else np.zeros(0, np.int64)
        self.lang, self.langs = np.asarray(lang.indices).astype(np.int64)[doc], lang.dictionary
        bounds = np.concatenate([[0], np.cumsum(end - start)])
        packed = data[~_APART[data]]
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(packed)]).dictionary_encode()
        self.id, self.words = np.asarray(words.indices).astype(np.int64), words.dictionary
        digest = xxhash.xxh64_intdigest
        self.word_hash = np.fromiter((digest(w) for w in self.words.to_pylist()), U, len(self.words))
        self.lang_hash = np.fromiter((digest(x) for x in self.langs.to_pylist()), U, len(self.langs))

    def hashes(self, k: int, at: np.ndarray) -> np.ndarray:
        """A hash of the language and the ``k`` words from each of the given words on."""
        out = self.lang_hash[self.lang[at]] + U(k)
        for j in range(k):
            out = mix(out + self.word_hash[self.id[at + j]], 3)
        return out

    def kept(self, k: int, where: np.ndarray, kept: BitMap) -> np.ndarray:
        """``where``, without the words at which no phrase of ``k`` words begins that was kept."""
        at = np.flatnonzero(where & self.whole(k))
        out = np.zeros(len(where), bool)
        out[at[kept.has(self.hashes(k, at))]] = True
        return out

    def whole(self, k: int) -> np.ndarray:
        """Whether the ``k`` words from each word on are in one piece."""
        n = max(len(self.id) - k + 1, 0)
        return self.piece[:n] == self.piece[k - 1 : k - 1 + n]


def _cut(text: str) -> Iterator[str]:
    """A long text in parts that end where a piece ends."""
    data = text.encode()
    a = 0
    while len(data) - a > SLICE:
        marks = np.flatnonzero(_ENDS[np.frombuffer(data, np.uint8, SLICE, a)])
        if len(marks):
            b = a + int(marks[-1]) + 1
        else:  # a piece of more than a slice stays whole
            later = next((i for i in range(a + SLICE, len(data), SLICE) if _ENDS[np.frombuffer(data, np.uint8, min(SLICE, len(data) - i), i)].any()), None)
            if later is None:
                break
            b = later + int(np.flatnonzero(_ENDS[np.frombuffer(data, np.uint8, min(SLICE, len(data) - later), later)])[0]) + 1
        yield data[a:b].decode()
        a = b
    yield data[a:].decode()


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[Slice]:
    texts, langs, size = [], [], 0
    for b in batches:
        text, lang = b.column("text").cast(pa.large_string()), b.column("lang").cast(pa.large_string())
        length = np.asarray(pc.binary_length(text).fill_null(0)).astype(np.int64)
        large, group = length > SLICE, np.cumsum(length) // SLICE
        edges = np.flatnonzero((group[1:] != group[:-1]) | large[1:] | large[:-1]) + 1
        for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(text)], strict=True):
            if i == j:
                continue
            if large[i]:
                for part in _cut(text[i].as_py()):
                    yield Slice([pa.array([part], pa.large_string())], [lang.slice(i, 1)])
                continue
            texts.append(text.slice(i, j - i))
            langs.append(lang.slice(i, j - i))
            size += int(length[i:j].sum())
            if size >= SLICE:
                yield Slice(texts, langs)
                texts, langs, size = [], [], 0
    if texts:
        yield Slice(texts, langs)


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def short(h: np.ndarray, log_parts: int) -> np.ndarray:
    """Partition and 32 more bits of a hash. What coincides here is summed up together, which can only keep more."""
    return h >> U(32 - log_parts)


def _summaries(log_parts: int, picked: Callable[[Slice], Iterator[np.ndarray]]):
    """Rows ``part, kind, mass, ones, keys, counts``: for each slice and partition its mass (kind 0) and its summary (kind 1)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches):
            keys, counts = _summed(np.concatenate([short(h, log_parts) for h in picked(s)]))
            if not len(keys):
                continue
            part = (keys >> U(32)).astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            edges, low, one = [*at.tolist(), len(part)], keys.astype(np.uint32), counts == 1
            rows = {n: [] for n in ("ones", "keys", "counts")}
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                o = one[a:b]
                rows["ones"].append(low[a:b][o].tobytes())
                rows["keys"].append(low[a:b][~o].tobytes())
                rows["counts"].append(counts[a:b][~o].astype(np.int64).astype("<u4" if counts[a:b].max() < 1 << 32 else "<u8").tobytes())
            n, ids, mass = len(at), part[at].astype(np.int32), np.add.reduceat(counts, at).astype(np.int64)
            none = pa.array([None] * n, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.zeros(n, np.int32)), pa.array(mass), none, none, none], ["part", "kind", "mass", "ones", "keys", "counts"])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.ones(n, np.int32)), pa.array(np.zeros(n, np.int64)), *(pa.array(rows[c], pa.binary()) for c in ("ones", "keys", "counts"))], ["part", "kind", "mass", "ones", "keys", "counts"])

    return run


class MisraGries:
    """A mergeable summary: at most ``capacity`` counters, each short of the true count by ``error`` at most."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = _summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        over = len(self.counts) - self.capacity
        if over > 0:  # all go down by the first counter that has no room: each unit of error takes capacity + 1 units of mass
            least = int(np.partition(self.counts, over - 1)[over - 1])
            self.error += least
            left = self.counts > least
            self.keys, self.counts = self.keys[left], self.counts[left] - least

    def reaching(self, threshold: int) -> np.ndarray:
        """Every key whose count may reach the threshold."""
        return self.keys[self.counts + self.error >= threshold]


def _kept(threshold: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary, waiting, size = None, 0, None, [], 0

        def merged():
            if waiting:
                summary.merge(np.concatenate([k for k, _ in waiting]), np.concatenate([c for _, c in waiting]))
                waiting.clear()

        def done():
            merged()
            keys = summary.reaching(threshold).astype(np.int64) | (part << 32) if summary else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys)], ["key"])

        for b in batches:
            plain, blobs = [b.column(c).to_pylist() for c in ("part", "kind", "mass")], [b.column(c) for c in ("ones", "keys", "counts")]
            for i, (p, kind, m) in enumerate(zip(*plain, strict=True)):
                if p != part:
                    if part is not None:
                        yield done()
                    part, mass, summary, size = p, 0, None, 0
                if kind == 0:
                    mass += m
                    continue
                if summary is None:  # a partition's masses come before its summaries
                    summary = MisraGries(mass // threshold + 1)
                ones, keys, counts = (x[i].as_buffer() for x in blobs)
                one, many = np.frombuffer(ones, "<u4"), np.frombuffer(keys, "<u4")
                count = np.frombuffer(counts, "<u4" if counts.size == 4 * len(many) else "<u8").astype(np.int64)
                waiting.append((np.concatenate([one, many]), np.concatenate([np.ones(len(one), np.int64), count])))
                size += len(one) + len(many)
                if size >= BUFFER:
                    merged()
                    size = 0
        if part is not None:
            yield done()

    return run


def frequent(texts: DataFrame, log_parts: int, picked: Callable[[Slice], Iterator[np.ndarray]], threshold: int = LEAST) -> DataFrame:
    """``key`` (see ``short``) of every n-gram that occurs ``threshold`` times or more, and of a few others; stored."""
    rows = texts.mapInArrow(_summaries(log_parts, picked), "part int, kind int, mass long, ones binary, keys binary, counts binary")
    return stash(rows.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_kept(threshold), "key long"))


class BitMap:
    """Whether a hash was kept; a few others are said to be as well."""

    def __init__(self, bits: np.ndarray, log_bits: int, log_parts: int):
        self.bits, self.log_bits, self.log_parts = bits, log_bits, log_parts

    def has(self, h: np.ndarray) -> np.ndarray:
        at = _place(short(h, self.log_parts), self.log_bits)
        return (self.bits[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & np.uint8(1) != 0


def _place(key: np.ndarray, log_bits: int) -> np.ndarray:
    return mix(key.astype(U), 57) >> U(64 - log_bits)


def bit_map(keys: DataFrame, log_parts: int) -> BitMap:
    """Segments of the map are made in tasks; the driver puts them together (``MOST_BITS`` / 8 bytes at most)."""
    n = keys.count()
    log_bits = int(np.clip(n * BITS_EACH, LEAST_BITS, MOST_BITS) - 1).bit_length()

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _place(np.asarray(b.column("key")).view(U), log_bits).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> _SEGMENT).astype(np.int32)), pa.array((at & ((1 << _SEGMENT) - 1)).astype(np.int32))], ["segment", "at"])

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {}
        for b in batches:
            segment, at = (np.asarray(b.column(c)) for c in ("segment", "at"))
            for s in np.unique(segment).tolist():
                bits.setdefault(s, np.zeros(1 << _SEGMENT, bool))[at[segment == s]] = True
            for s in sorted(bits)[:-1]:  # rows come in the order of segments
                yield _packed(s, bits.pop(s))
        for s in sorted(bits):
            yield _packed(s, bits[s])

    rows = keys.mapInArrow(places, "segment int, at int").repartition("segment").sortWithinPartitions("segment").mapInArrow(segments, "segment int, bits binary")
    out = np.zeros(1 << (log_bits - 3), np.uint8)
    for r in rows.toLocalIterator():
        a = r.segment << (_SEGMENT - 3)
        out[a : a + (1 << (_SEGMENT - 3))] = np.frombuffer(r.bits, np.uint8)
    return BitMap(out, log_bits, log_parts)


def _packed(segment: int, bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])


def _both(where: np.ndarray) -> np.ndarray:
    """Whether it holds for a word and for the next one."""
    return where[:-1] & where[1:]


def _short_phrases(s: Slice) -> Iterator[np.ndarray]:
    for k in (1, 2):
        yield s.hashes(k, np.flatnonzero(s.whole(k)))


def _long_phrases(kept):
    def picked(s: Slice) -> Iterator[np.ndarray]:
        run = s.kept(2, s.whole(2), kept.value)
        for k in range(3, LONGEST + 1):
            run = _both(run)
            yield s.hashes(k, np.flatnonzero(run & s.whole(k)))

    return picked


def _counts(short_kept, long_kept, log_parts: int):
    """Rows ``lang, part, phrases, counts``: exact counts of a slice, the phrases as lines; the empty one has all its words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches):
            langs, n = np.unique(s.lang, return_counts=True)
            rows = [(langs, np.zeros(len(langs), np.int64), pa.array([""] * len(langs), pa.large_string()), n)]
            # phrases are told apart by the numbers of their words, each longer one by that of its beginning and one word more
            size, code, before = max(len(s.words), 1), s.lang, None
            for k in range(1, LONGEST + 1):
                hit = s.kept(k, _both(before) if k > 2 else s.whole(k), (short_kept if k < 3 else long_kept).value)
                at = np.flatnonzero(hit)
                if not len(at):
                    break
                _, first, number, f = np.unique(code[at] * size + s.id[at + k - 1], return_index=True, return_inverse=True, return_counts=True)
                head = at[first]
                words = [s.words.take(pa.array(s.id[head + j])).cast(pa.large_string()) for j in range(k)]
                phrase = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if k > 1 else words[0]
                rows.append((s.lang[head], (s.hashes(k, head) >> U(64 - log_parts)).astype(np.int64), phrase, f))
                before, code = hit, np.zeros(len(s.id), np.int64)
                code[at] = number
            lang, part, f = (np.concatenate([r[i] for r in rows]) for i in (0, 1, 3))
            order = np.lexsort((part, lang))
            phrase = pa.concat_arrays([r[2] for r in rows]).take(pa.array(order))
            lang, part, f = lang[order], part[order], f[order].astype("<i8")
            at = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (part[1:] != part[:-1])]))
            lists = pa.LargeListArray.from_arrays(pa.array(np.append(at, len(f))), phrase)
            lines = pc.binary_join(lists, pa.scalar("\n", pa.large_string()))
            counts = [f[a:b].tobytes() for a, b in zip(at.tolist(), [*at[1:].tolist(), len(f)], strict=True)]
            yield pa.RecordBatch.from_arrays([s.langs.take(pa.array(lang[at])).cast(pa.string()), pa.array(part[at].astype(np.int32)), lines.cast(pa.string()), pa.array(counts, pa.binary())], ["lang", "part", "phrases", "counts"])

    return run


def _totals(least: int):
    """The sums by language and phrase of rows that come in the order of ``lang, part``: those of ``least`` or more."""

    def summed(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("phrase").aggregate([("f", "sum")]).rename_columns(["phrase", "f"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, size = None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            out = summed(waiting)
            out = out.filter(pc.or_(pc.greater_equal(out["f"], least), pc.equal(out["phrase"], "")))
            k = pc.if_else(pc.equal(out["phrase"], ""), 0, pc.add(pc.count_substring(out["phrase"], " "), 1)).cast(pa.int32())
            table = pa.table([pa.array([key[0]] * len(out), pa.string()), k, out["phrase"].cast(pa.string()), out["f"]], names=["lang", "k", "phrase", "f"])
            yield from table.combine_chunks().to_batches()

        for b in batches:
            columns = [b.column(c) for c in ("lang", "part", "phrases", "counts")]
            for lang, part, lines, counts in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2], columns[3], strict=True):
                if (lang, part) != key:
                    if key is not None:
                        yield from done()
                    key, waiting, size = (lang, part), [], 0
                f = np.frombuffer(counts.as_buffer(), "<i8")
                phrase = pc.split_pattern(pa.array([lines.as_py()], pa.large_string()), "\n").flatten()
                waiting.append(pa.table({"phrase": phrase, "f": pa.array(f)}))
                size += len(f)
                if size >= BUFFER:
                    waiting = [summed(waiting)]
                    size = len(waiting[0])
        if key is not None:
            yield from done()

    return run


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, percent: int = COVERED_PERCENT) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased in A-Z and split into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. A
    phrase is 2 to 5 words that occur ``a >= least`` times in a row within pieces of its language, which has ``n`` words. Cut
    after its first words it has parts that occur ``l`` and ``r`` times; its score is that of the cut with the least
    ``floor(1000 a n / (l r))``, the first of equal ones. It goes if a longer phrase holds it and has ``percent`` of its
    count or more. Ranks are by score, count and the phrase's bytes. Arithmetic is on decimals of 38 digits.

    Null texts are empty; a null language is ``und``, one with that name. Repeated rows count each time. Other columns are
    ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    log_parts = int(np.clip(size // PART_BYTES, LEAST_PARTS, MOST_PARTS) - 1).bit_length()
    one = frequent(texts, log_parts, _short_phrases, least)
    short_kept = spark.sparkContext.broadcast(bit_map(one, log_parts))
    two = frequent(texts, log_parts, _long_phrases(short_kept), least)
    long_kept = spark.sparkContext.broadcast(bit_map(two, log_parts))
    unstash(one, two)
    rows = texts.mapInArrow(_counts(short_kept, long_kept, max(8, log_parts - 4)), "lang string, part int, phrases string, counts binary")
    rows = rows.repartition("lang", "part").sortWithinPartitions("lang", "part")
    exact = stash(rows.mapInArrow(_totals(least), "lang string, k int, phrase string, f long"))
    counts = exact.where("k > 0").select("lang", "phrase", "f")
    total = exact.where("k = 0").select("lang", F.col("f").alias("n"))
    phrases = exact.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    cuts = phrases.select("lang", "phrase", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    join = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = cuts.select("lang", "phrase", "a", "cut", join(F.lit(1), F.col("cut")).alias("first"), join(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    scored = cuts.join(counts.toDF("lang", "first", "l"), ["lang", "first"]).join(counts.toDF("lang", "rest", "r"), ["lang", "rest"]).join(total, "lang")
    scored = scored.withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"), F.first("a").alias("a"), F.first("n").alias("n"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    holders = phrases.where("k > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    left = best.join(holders, ["lang", "phrase"], "left").where(F.col("held").isNull() | (F.lit(100) * F.col("held") < F.lit(percent) * F.col("a")))
    ready = left.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of each share of a language, then the first of those: no task sorts a whole language
    share = F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("share")
    near = ready.select("*", share).withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("place") <= top)
    out = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
