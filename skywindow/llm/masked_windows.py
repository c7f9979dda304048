"""Windows of places whose key has many surroundings, matched by equal keys instead of in pairs.

Two windows of RUN shingles and similarity SIMILAR agree in one run of AGREE shingles, or in two runs with one gap between
them. What must agree, with the gap left out, is a key of its own: windows with one key match, so that all of them are one group,
however many they are, and neither pairs nor leaders are needed. Texts take part with the stretches around such places
("zones"), one text for all that have equal surroundings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binaries, sliced, stash, unstash
from .phrases import bit_map
from .textvec import U, mix

#: Shingles of a window; shingles to either side of a place that windows with it can have, SHIFT more in the other text.
RUN, REACH = 46, 47
#: Shingles that agree -> shingles of the gap: on one side, on the other. A window of RUN has 46 shingles, the aligned one
#: 44 to 48, and 9 x agreeing >= 4 x (46 + those of the other). Gaps: 5 and 5, one word changed; 4 and 5, 4 and 6: one or
#: two words put in. 40 suffice for the longer side of an insertion (aligned: 44), 42 are needed by the shorter one of two words.
FORMS = {40: ((4,), (5, 6)), 41: ((4, 5), ()), 42: ((4,), (6,))}
GAPS = (4, 5, 6)
#: Shingles of the longer run, at least.
SEED = 20
#: Shingles in a row that suffice without a gap.
WHOLE = 40
#: Shingles of the longest window with its gap.
LONGEST = 48
#: Shingles of a zone, about, after which the next one begins; bytes of zones that a task looks at together.
ZONE, SLICE = 1 << 14, 1 << 15
KEY_BITS = 32
_ODD = 0xD6E8FEB86659FD93
_SIG = "sig long, form int, gap int, t long, z long, i int, n int, core int, multi boolean"
_EXACT = "z long, t long, start int, sh binary, at array<struct<c:int,cid:long,multi:boolean>>"


def zones(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of each text around its places of keys with many surroundings, with those places."""
    for b in sliced(batches, "sh", 1 << 18):
        rows = []
        for t, sh, at in zip(b.column("t").to_pylist(), b.column("sh"), b.column("at"), strict=True):
            v = at.values
            v = v.filter(v.field("many"))
            if not len(v):
                continue
            c = v.field("c").to_numpy().astype(np.int64)
            order = np.argsort(c, kind="stable")
            c, cid = c[order], v.field("cid").to_numpy()[order]
            multi = v.field("multi").to_numpy(zero_copy_only=False)[order]
            flat = np.frombuffer(sh.as_py(), np.uint16)
            for part in np.split(np.arange(len(c)), np.flatnonzero(np.diff(c) >= 2 * RUN - 1) + 1):
                for piece in np.split(part, np.searchsorted(c[part], np.arange(c[part[0]] + ZONE, c[part[-1]], ZONE))):
                    if len(piece):
                        start = max(int(c[piece[0]]) - REACH, 0)
                        rows.append((t, start, flat[start : c[piece[-1]] + REACH + 1].tobytes(), [{"c": int(x - start), "cid": int(k), "multi": bool(m)} for x, k, m in zip(c[piece], cid[piece], multi[piece], strict=True)]))
        if rows:
            t, start, sh, at = zip(*rows, strict=True)
            z = mix(mix(np.array(t, np.int64).view(U), 80) + np.array(start, np.int64).view(U), 81).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(t, pa.int64()), pa.array(start, pa.int32()), pa.array(sh, pa.binary()), pa.array(at, pa.list_(pa.struct([("c", pa.int32()), ("cid", pa.int64()), ("multi", pa.bool_())])))], ["z", "t", "start", "sh", "at"])


class Zones:
    """Some zones end to end: shingles, where each begins, and for each shingle where its zone ends."""

    def __init__(self, b: pa.RecordBatch):
        sh = b.column("sh").cast(pa.large_binary())
        _, offsets, data = sh.buffers()
        offs = np.frombuffer(offsets, np.int64)[sh.offset : sh.offset + len(sh) + 1]
        self.sh = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].view(np.uint16).astype(U)
        self.first = (offs - offs[0]) // 2
        self.zone = np.repeat(np.arange(len(sh)), np.diff(self.first))
        self.end = self.first[1:][self.zone]
        n = len(self.sh)
        at = b.column("at")
        v = pc.list_flatten(at)
        c = v.field("c").to_numpy().astype(np.int64) + self.first[pc.list_parent_indices(at).to_numpy()]
        self.next_place = self._next(c, n)
        self.next_multi = self._next(c[v.field("multi").to_numpy(zero_copy_only=False)], n)
        odd = np.full(n, _ODD, U)
        odd[:1] = U(1)
        power = np.cumprod(odd)
        odd[1:] = U(pow(_ODD, -1, 1 << 64))
        self.back = np.append(np.cumprod(odd), U(0))
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(self.sh + U(1), 82) * power)])

    @staticmethod
    def _next(c: np.ndarray, n: int) -> np.ndarray:
        c = np.append(np.sort(c), 1 << 40)
        return c[np.searchsorted(c[:-1], np.arange(n))]

    def run(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A hash of the shingles from ``a`` to ``b``."""
        return mix((self.sums[b] - self.sums[a]) * self.back[a], 83)

    def pairs(self) -> np.ndarray:
        """A key of each shingle and the next one."""
        return mix(mix(self.sh[:-1] + U(1), 84) + self.sh[1:], 85)

    def common(self, shared) -> np.ndarray:
        """How many shingles from each on are in a row such that every two neighbours are found elsewhere too."""
        n = len(self.sh)
        bad = np.append(np.flatnonzero(~shared.has(self.pairs())) if n > 1 else np.zeros(0, np.int64), max(n - 1, 0))
        return np.minimum(bad[np.searchsorted(bad, np.arange(n))] + 1, self.end) - np.arange(n)

    def flanks(self, common: np.ndarray, gap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Where gaps can begin, what stands around each, and what in it: SEED shingles before and one behind; or the other way."""
        n = len(self.sh)
        e = np.arange(1, max(n - gap, 1))
        e = e[e + gap < self.end[e - 1]]
        change = np.append(np.flatnonzero(self.sh[1:] != self.sh[:-1]), n - 1)
        equal = change[np.searchsorted(change, e - 1)] >= e + gap
        inside = np.where(equal, U(0), mix(self.run(e, e + gap) + U(gap), 90))
        start = e - SEED
        long_ = (start >= self.first[self.zone[e]]) & (common[np.maximum(start, 0)] >= SEED)
        yield e[long_], mix(self.run(start[long_], e[long_]) * U(_ODD) + self.run(e[long_] + gap, e[long_] + gap + 1), 91), inside[long_]
        long_ = common[e + gap] >= SEED
        e, inside = e[long_], inside[long_]
        yield e, mix(self.run(e - 1, e) * U(_ODD) + self.run(e + gap, e + gap + SEED), 92), inside


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, "sh", SLICE):
        z = Zones(b)
        x, zone = z.pairs(), z.zone[:-1]
        inside = zone == z.zone[1:]
        x, zone = x[inside], zone[inside]
        order = np.lexsort((x, zone))
        x, zone = x[order], zone[order]
        at = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (zone[1:] != zone[:-1])])) if len(x) else np.zeros(0, np.int64)
        of, each = pc.list_parent_indices(b.column("at")).to_numpy(), pc.list_flatten(b.column("at")).field("multi").to_numpy(zero_copy_only=False)
        multi, whole = np.zeros(b.num_rows, bool), np.ones(b.num_rows, bool)
        multi[of[each]], whole[of[~each]] = True, False
        # a zone all of which is in another text is one passage already, whatever it has twice
        more = (multi & ~whole)[zone[at]] & (np.diff(np.append(at, len(x))) > 1)
        yield pa.RecordBatch.from_arrays([pa.array(x[at].view(np.int64)), b.column("t").take(pa.array(zone[at])), pa.array(multi[zone[at]]), pa.array(more)], ["key", "t", "multi", "more"])


def _clean(shared: Broadcast) -> Callable:
    """Windows all of whose neighbours are found elsewhere too, by their content: of equal ones in many texts, one text's are enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "sh", SLICE):
            z = Zones(b)
            n = len(z.sh)
            stop = np.minimum(np.arange(n) + LONGEST, z.end)
            at = np.flatnonzero((z.common(shared.value) >= stop - np.arange(n)) & (stop - np.arange(n) >= WHOLE) & (z.next_place < np.arange(n) + WHOLE))
            w = mix(z.run(at, stop[at]) + (stop - np.arange(n))[at].astype(U), 86)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), b.column("t").take(pa.array(z.zone[at])), b.column("z").take(pa.array(z.zone[at])), pa.array((at - z.first[z.zone[at]]).astype(np.int32))], ["w", "t", "z", "i"])

    return run


def _gaps(shared: Broadcast) -> Callable:
    """What stands around each place where a gap can be, and what in it: a stretch of equal shingles is alike at any length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "sh", SLICE):
            z = Zones(b)
            common = z.common(shared.value)
            for gap in GAPS:
                for _, key, inside in z.flanks(common, gap):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(inside.view(np.int64))], ["key", "inside"])

    return run


def _keys(shared: Broadcast, open_: Broadcast) -> Callable:
    """The keys of each zone's windows; starts in a row with the same key are one row.

    A gap is tried where what stands around it has something else between it elsewhere (``open_``).

    ``skip``: starts of windows that an other text stands for; they still have the key of their first run.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "sh", SLICE):
            z = Zones(b)
            n = len(z.sh)
            common, i = z.common(shared.value), np.arange(n)
            whole = i[(common >= WHOLE) & (z.next_place < i + WHOLE)]
            out = [(z.run(whole, whole + WHOLE), whole, 0, 0, WHOLE)]
            skip = np.zeros(n, bool)
            lists = b.column("skip")
            skip[pc.list_flatten(lists).to_numpy() + z.first[pc.list_parent_indices(lists).to_numpy()]] = True
            starts, useful = i[~skip], {}
            for gap in GAPS:
                useful[gap] = [np.zeros(n, bool), np.zeros(n, bool)]
                for side, (e, key, _) in zip(useful[gap], z.flanks(common, gap), strict=True):
                    side[e[open_.value.has(key)]] = True
            for form, sides in FORMS.items():
                for gap in sides[0] + sides[1]:
                    before, behind = useful[gap]
                    core = form + gap
                    s = starts[(starts + core <= z.end[starts]) & (z.next_place[starts] < starts + core)]
                    for p in range(1, form):
                        at = s[(before if p >= SEED else behind)[np.minimum(s + p, n - 1)]]
                        at = at[(common[at] >= p) & (common[at + p + gap] >= form - p)]
                        if len(at):
                            k = mix(z.run(at, at + p) * U(_ODD) + z.run(at + p + gap, at + core) + U(64 * form + p), 87)
                            out.append((k, at, form, gap, core))
            size = [len(o[1]) for o in out]
            sig, at = (np.concatenate([o[k] for o in out]) for k in (0, 1))
            form, gap, core = (np.repeat([o[k] for o in out], size) for k in (2, 3, 4))
            order = np.lexsort((at, gap, sig, z.zone[at]))
            sig, at, form, gap, core = (x[order] for x in (sig, at, form, gap, core))
            new = np.ones(len(at), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (gap[1:] != gap[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            rows = np.diff(np.append(first, len(at)))
            multi = z.next_multi[at] < at + core
            multi = np.logical_or.reduceat(multi, first) if len(first) else multi
            a, zone = at[first], z.zone[at[first]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig[first].view(np.int64)), *(pa.array(x[first].astype(np.int32)) for x in (form, gap)), b.column("t").take(pa.array(zone)), b.column("z").take(pa.array(zone)), *(pa.array(x.astype(np.int32)) for x in (a - z.first[zone], rows, core[first])), pa.array(multi)],
                ["sig", "form", "gap", "t", "z", "i", "n", "core", "multi"],
            )

    return run


def _covers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the matched windows cover around each place, and the first place of each window with the window's key.

    Overlapping windows are one stretch.
    """
    for b in batches:
        for k in range(b.num_rows):
            at, rows = b.column("at")[k].values, b.column("rows")[k].values
            c, cid = at.field("c").to_numpy().astype(np.int64), at.field("cid").to_numpy()
            i, n, core = (rows.field(x).to_numpy().astype(np.int64) for x in ("i", "n", "core"))
            stop = i + n - 1 + core
            order = np.argsort(i, kind="stable")
            far = np.maximum.accumulate(stop[order])
            begin = np.flatnonzero(np.concatenate([[True], i[order][1:] >= far[:-1]]))
            lo, hi = i[order][begin], far[np.append(begin[1:], len(i)) - 1]
            # of the stretches that hold a place the first, and the last where two meet in it
            x, y = np.searchsorted(hi, c, "right"), np.searchsorted(lo, c, "right") - 1
            ok = np.flatnonzero(x <= y)
            x, y, at = x[ok], y[ok], c[ok]
            cover = np.maximum(lo[x] - at, 1 - RUN), np.minimum(hi[y] - at, RUN)
            yield pa.RecordBatch.from_arrays([pa.array(cid[ok]), *(pa.array(v.astype(np.int32)) for v in cover), pa.nulls(len(ok), pa.int64())], ["cid", "lo", "hi", "sig"])
            first = np.searchsorted(c, i)
            some = np.flatnonzero(first < np.searchsorted(c, stop))
            link = np.unique(np.stack([cid[first[some]], rows.field("sig").to_numpy()[some]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(link[0]), pa.nulls(link.shape[1], pa.int32()), pa.nulls(link.shape[1], pa.int32()), pa.array(link[1])], ["cid", "lo", "hi", "sig"])


def _matched() -> Column:
    """Whether a row's group has one that it matches, in another text: of the other side of its form, where it has sides."""

    def other(side: str) -> Column:
        return F.col(f"x_{side}").isNotNull() & ((F.col("t") != F.col(f"x_{side}")) | (F.col("t") != F.col(f"y_{side}")) | F.col(f"m_{side}") | F.col("multi"))

    alike = other("short") | other("long")
    return F.when(F.col("form").isin(0, 41), F.coalesce(alike, F.lit(False))).when(F.col("gap") == 4, F.coalesce(other("long"), F.lit(False))).otherwise(F.coalesce(other("short"), F.lit(False)))


def masked_matches(texts: DataFrame) -> DataFrame:
    """What is matched around places of keys with many surroundings: ``cid, lo, hi, label``, one label for what matches.

    ``texts``: ``t, sh, at``, 16-bit shingles and places with ``c, cid, multi`` (another text has equal surroundings) and ``many``.
    """
    zone = stash(texts.mapInArrow(zones, _EXACT))
    pairs = zone.mapInArrow(_pairs, "key long, t long, multi boolean, more boolean")
    seen = pairs.groupBy("key").agg(F.min("t").alias("x"), F.max("t").alias("y"), F.count("*").alias("n"), F.max("multi").alias("multi"), F.max("more").alias("more"))
    common = stash(seen.where("x < y or more or (multi and n > 1)").select("key"))
    shared = zone.sparkSession.sparkContext.broadcast(bit_map(common, KEY_BITS))
    windows = stash(zone.mapInArrow(_clean(shared), "w long, t long, z long, i int"))  # not dealt by content, which a large group of copies shares
    least = windows.groupBy("w").agg(F.min("t").alias("x"), F.max("t").alias("y")).where("x < y").select("w", "x")
    skip = windows.join(least, "w").where("t != x").groupBy("z").agg(F.collect_list("i").alias("skip"))
    asked = zone.join(skip, "z", "left").select("z", "t", "sh", "at", F.coalesce("skip", F.array().cast("array<int>")).alias("skip"))
    gaps = zone.mapInArrow(_gaps(shared), "key long, inside long").groupBy("key").agg(F.min("inside").alias("x"), F.max("inside").alias("y"))
    split = stash(gaps.where("x < y").select("key"))
    open_ = zone.sparkSession.sparkContext.broadcast(bit_map(split, KEY_BITS))
    keys = asked.mapInArrow(_keys(shared, open_), _SIG).repartition("sig")
    short = F.col("gap") == 4
    ends = [f(F.when(w, F.col(v))).alias(f"{n}_{side}") for side, w in (("short", short), ("long", ~short)) for n, f, v in (("x", F.min, "t"), ("y", F.max, "t"), ("m", F.max, "multi"))]
    groups = keys.groupBy("sig").agg(*ends, F.count("*").alias("rows")).where("rows > 1")
    found = keys.join(groups, "sig").where(_matched()).groupBy("z").agg(F.collect_list(F.struct("sig", "i", "n", "core")).alias("rows"))
    done = stash(found.join(zone.select("z", "at"), "z").mapInArrow(_covers, "cid long, lo int, hi int, sig long"))
    links = done.where("sig is not null").select("sig", "cid")
    label = links.groupBy("sig").agg(F.min("cid").alias("label"))
    edges = links.join(label, "sig").where("cid != label").select("cid", "label").distinct()
    covers = done.where("sig is null").select("cid", "lo", "hi", F.col("cid").alias("label"))
    out = stash(covers.union(edges.select("cid", F.lit(None).cast("int"), F.lit(None).cast("int"), "label")))
    unstash(zone, common, windows, split, done)
    shared.destroy()
    open_.destroy()
    return out
