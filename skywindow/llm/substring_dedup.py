"""Near-duplicate passages across documents, by compact windows.

A passage is a run of windows of ``WINDOW`` words, each of which has an aligned window in another document with Jaccard
similarity ``SIMILAR`` or more over shingles of ``SHINGLE`` words. Such windows agree in ``SEED`` shingles in a row: what
differs lies in one gap. For each hash function, the sequences of SEED shingles or more with the same shingle of least hash
are a compact window, a node of the Cartesian tree of the hashes; the windows of the hash functions are joined as
intervals, and each common interval is a place under one key: the least shingles and their distance. Whatever agrees in SEED
shingles shares a key, so no match escapes. Of places with equal surroundings one stands for all. Those of a key are aligned
at the shared shingle and verified window by window, all against all; keys with many of them go on by ``masked_windows``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TAG, binaries, flat, sliced, stash, tagged, unstash
from .graph import components
from .masked_windows import masked_matches
from .phrases import bit_map
from .textvec import BREAK, U, Words, mix, spans

SHINGLE, SIMILAR = 5, 0.8
#: Words of a window; its shingles.
WINDOW = 50
RUN = WINDOW - SHINGLE + 1
#: Hash functions whose compact windows are joined.
FUNCTIONS = (31, 32)
#: Shingles in a row that agree in windows of RUN shingles and similarity SIMILAR.
SEED = 20
#: Words inserted or deleted on one side of a seed, at most, in windows of RUN shingles and similarity SIMILAR.
SHIFT = 2
#: Shingles that agree in such windows, at least (a window of RUN and one of RUN - SHIFT shingles).
AGREE = 40
#: What agrees beyond a seed: so many shingles more in the seed's own run, or as many in a run beyond the gap.
MORE = 11
#: Shingles of a gap, at least and at most: what one changed word, or up to SHIFT inserted or deleted ones, take away.
GAP = (SHINGLE - 1, SHINGLE - 1 + SHIFT)
#: Kinds of places of a key that are all compared, both ways; larger keys go on by the keys of their masked windows.
SMALL = 64
#: Shingles of a gap, at least, by the shift beyond it, from -SHIFT on: no shingle of a stretch of one word agrees twice.
LEAST_GAPS = (6, 5, 5, 4, 4)
#: Nothing goes by these any more; a test sets them.
LEADERS, GROWTH = 1, 4
#: Shingles to either side of a place that decide what it, or a finer place made of it, matches.
REACH = RUN - 1 + SHIFT + SEED + MORE
HITS = 1 << 12
#: What of a finer key its place in a bit map goes by, behind the 32 bits that always count: all of it.
KEY_BITS = 32
_PLACE = U((1 << 28) - 1)


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes, where its least one is; the first of equal ones."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    v = (h & ~_PLACE) | np.arange(len(h), dtype=U)
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[: len(v) - span], v[span:])
        span *= 2
    return (np.minimum(v[:n], v[width - span : width - span + n]) & _PLACE).astype(np.int64)


def window_hashes(sh: np.ndarray, width: int) -> np.ndarray:
    """A hash of the whole content of each window of ``width`` shingles."""
    v, out, at, span = sh, None, 0, 1
    while True:
        if width & span:
            part = v[at : len(sh) - width + 1 + at]
            out = part.copy() if out is None else mix(out * U(0x9E3779B97F4A7C15) + part, span)
            at += span
        if span * 2 > width:
            return out
        v = mix(v[: len(v) - span] * U(0xD6E8FEB86659FD93) + v[span:], span)
        span *= 2


def compact_windows(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of each text's Cartesian tree that span ``width`` hashes or more: first and last start, anchor.

    A node's sequences of just ``width`` hashes are a run of starts; the runs of a text lie end to end. ``first`` is where
    each text begins (one more entry at the end); shorter texts have none.
    """
    anchor = least_places(h, width)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(anchor)
    new = doc[:n] == doc[width - 1 :][:n]
    new[1:] &= (anchor[1:] != anchor[:-1]) | (doc[1:n] != doc[: max(n - 1, 0)])
    lo = np.flatnonzero(new)
    hi = np.minimum(np.append(lo[1:], n) - 1, first[doc[lo] + 1] - width)
    return lo, hi, anchor[lo]


def joined(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The interval join of two functions' compact windows: first and last start of what both share, and the rows of each."""
    lo = np.union1d(a[0], b[0])
    x, y = (np.searchsorted(w[0], lo, "right") - 1 for w in (a, b))
    return lo, np.minimum(np.minimum(a[1][x], b[1][y]), np.append(lo[1:], np.iinfo(np.int64).max) - 1), x, y


def places(sh: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, key, anchor, first and last start of the seeds of every place, in shingles from the text's begin."""
    windows = [compact_windows(mix(sh, f), first, SEED) for f in FUNCTIONS]
    lo, hi, x, y = joined(*windows)
    a, b = windows[0][2][x], windows[1][2][y]
    doc = np.searchsorted(first, lo, "right") - 1
    keep = np.diff(first)[doc] >= RUN
    doc, lo, hi, a, b = (v[keep] for v in (doc, lo, hi, a, b))
    key = mix(sh[a] + sh[b] * U(0xD6E8FEB86659FD93) + (a - b).astype(U), 40)
    base = first[doc]
    return doc, key.view(np.int64), a - base, lo - base, hi - base


def runs(sh: np.ndarray, first: np.ndarray, doc: np.ndarray, key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a text's places with one key and equal surroundings, less than RUN shingles apart: the first of each, and how
    far the last one lies behind it.

    All places of a run match alike, each as many shingles further on, and what they match overlaps: the first one's passage,
    made longer by the length of the run, is the whole of it.
    """
    order = np.lexsort((c, key, doc))
    d, k = doc[order], key[order]
    alike = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    twin = np.zeros(len(doc), bool)
    twin[order[1:]] |= alike
    twin[order[:-1]] |= alike
    more = np.zeros(len(doc), np.int64)
    at = np.flatnonzero(twin)
    if not len(at):
        return np.arange(len(doc)), more
    around = np.zeros(len(at), np.int64)
    text = doc[at]
    begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    for x, y in zip(begin, np.append(begin[1:], len(at)), strict=True):
        t = text[x]
        around[x:y] = np.asarray(surroundings(sh[first[t] : first[t + 1]], c[at[x:y]], REACH))
    order = np.lexsort((c[at], around, key[at], text))
    at, around = at[order], around[order]
    new = np.ones(len(at), bool)
    new[1:] = (doc[at[1:]] != doc[at[:-1]]) | (key[at[1:]] != key[at[:-1]]) | (around[1:] != around[:-1]) | (c[at[1:]] - c[at[:-1]] >= RUN)
    head = np.flatnonzero(new)
    more[at[head]] = c[at[np.append(head[1:], len(at)) - 1]] - c[at[head]]
    keep = np.ones(len(doc), bool)
    keep[at[~new]] = False
    return np.flatnonzero(keep), more[keep]


def _place_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        d, key, *_ = places(*Words(b.column("text")).shingles(SHINGLE))
        order = np.lexsort((key, d))
        d, key = d[order], key[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (key[1:] != key[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(key[new]), b.column(TAG).take(pa.array(d[new]))], ["key", "a"])


def _places(batches: Iterable[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """Places of shared keys, with a key of their kind: places of one kind have equal surroundings, the text's ends included."""
    for b in sliced(batches):
        sh, first = Words(b.column("text")).shingles(SHINGLE)
        d, key, c, _, _ = places(sh, first)
        common = np.flatnonzero(shared.value.has(key.view(U)))
        d, key, c = d[common], key[common], c[common]
        heads, more = runs(sh, first, d, key, c)
        d, key, c = d[heads], key[heads], c[heads]
        reach = RUN - 1 + SHIFT
        start = first + np.arange(len(first)) * reach  # an edge before each text, and one behind the last
        padded = np.zeros(int(start[-1]) + reach, U)
        padded[np.arange(len(sh)) + np.repeat(start[:-1] + reach - first[:-1], np.diff(first))] = sh + U(1)
        around = window_hashes(padded, 2 * reach + 1)[start[d] + c] if len(d) else np.zeros(0, U)
        kind = mix(key.view(U) * U(0x9E3779B97F4A7C15) + around, 41).view(np.int64)
        edge = np.minimum(c, RUN - 1) + (np.minimum(np.diff(first)[d] - c, RUN) << 8)
        yield pa.RecordBatch.from_arrays([b.column(TAG).take(pa.array(d)), pa.array(key), pa.array(kind), *(pa.array(x.astype(np.int32)) for x in (c, edge, more))], ["a", "key", "cid", "c", "edge", "more"])


def _content(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each text, in order, as 16-bit hashes: that AGREE of a window agree by chance can be ruled out."""
    for b in sliced(batches):
        sh, first = Words(b.column("text")).shingles(SHINGLE)
        yield pa.RecordBatch.from_arrays([b.column(TAG), binaries((sh >> U(48)).astype(np.uint16), first)], ["t", "sh"])


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a column of ``_content``, and where each text's begin."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].view(np.uint16) if data is not None else np.zeros(0, np.uint16), (offs - offs[0]) // 2


def _near(side: tuple[np.ndarray, np.ndarray], text: np.ndarray, at: np.ndarray, reach: int, none: int) -> np.ndarray:
    """Shingles up to ``reach`` to either side of places ``at`` of ``text``, a row each; ``none`` beyond the text's ends."""
    flat_, first = side
    at = at[:, None] + np.arange(-reach, reach + 1)
    there = (at >= 0) & (at < np.diff(first)[text][:, None])
    return np.where(there, flat_[np.clip(first[text][:, None] + at, 0, max(len(flat_) - 1, 0))].astype(np.int32), np.int32(none))


def matches(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], pair: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> np.ndarray:
    """For each hit, the passage that matches around its shared shingle: found, from and to (exclusive) on both sides.

    Where all shingles around are equal, every window matches as it stands. Where no window has AGREE shingles that have an
    equal one in any shift, none matches. What is left is followed by ``edited_matches``.
    """
    x, y = _near(left, pair, ca, RUN - 1, -1), _near(right, pair, cb, RUN - 1 + SHIFT, -2)
    return near_matches(x, y, *(np.diff(s[1])[pair] for s in (left, right)), ca, cb)


def near_matches(x: np.ndarray, y: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> np.ndarray:
    """``matches`` of the shingles around each hit, a row each."""
    same = np.stack([x == y[:, d : d + x.shape[1]] for d in range(2 * SHIFT + 1)])
    whole = same[SHIFT].all(1)
    many = np.zeros((len(x), x.shape[1] + 1), np.int16)
    np.cumsum(same.any(0), axis=1, out=many[:, 1:])
    rest = np.flatnonzero(~whole & ((many[:, RUN:] - many[:, :-RUN]).max(1, initial=0) >= AGREE))
    out = np.stack([whole, ca + 1 - RUN, ca + RUN, cb + 1 - RUN, cb + RUN], axis=1)
    if len(rest):
        out[rest] = edited_matches(same[:, rest], size_a[rest], size_b[rest], ca[rest], cb[rest])
    return out


def edited_matches(same: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> np.ndarray:
    """``matches``, from which shingles around a hit are equal in each shift, and the number of shingles of both texts.

    From the shared shingle the two texts are followed while they agree; what lies beyond, on either side, may be shifted
    by up to SHIFT words. Every window of RUN shingles with the shared one in it is tested; the passage spans those
    that match, without what differs at its ends.
    """
    reach = RUN - 1
    shift = np.arange(-SHIFT, SHIFT + 1)
    sides, step = [], np.arange(RUN)
    for part, least in ((same[:, :, reach::-1], LEAST_GAPS[::-1]), (same[:, :, reach:], LEAST_GAPS)):  # leftwards and rightwards, the shared shingle first
        run = np.logical_and.accumulate(part[SHIFT], axis=1).sum(1)[:, None]
        beyond = part & (step >= run + np.array(least)[:, None, None])
        score = np.cumsum(beyond, axis=2, dtype=np.int16) * 8 - np.abs(shift).astype(np.int16)[:, None, None]
        best = score.argmax(0)
        gain = (np.take_along_axis(score, best[None], 0)[0] + np.abs(shift)[best]) // 8
        last = np.maximum.accumulate(np.where(beyond, step, 0), axis=2)
        loose = step - np.maximum(np.take_along_axis(last, best[None], 0)[0], np.minimum(step, run - 1))  # what differs at the end
        sides.append((np.minimum(step + 1, run) + gain, best, beyond, run, loose))
    (lm, lbest, lbeyond, lrun, lloose), (rm, rbest, rbeyond, rrun, rloose) = sides
    j = np.arange(RUN)
    i = reach - j
    agree = lm[:, i] + rm[:, j] - 1
    dl, dr = shift[lbest[:, i]], shift[rbest[:, j]]
    a, b, size_a, size_b = (v[:, None] for v in (ca, cb, size_a, size_b))
    # the other side's window leaves off what differs at its ends, as far as RUN - SHIFT shingles remain
    il, jr = i - lloose[:, i], j - rloose[:, j]
    inside = (a - i >= 0) & (a + j < size_a) & (b - il + dl >= 0) & (b + jr + dr < size_b)
    size = np.maximum(RUN - SHIFT, il + jr + 1 + dr - dl)
    # agree / (RUN + size - agree) >= 0.8
    ok = inside & (9 * agree >= 4 * (RUN + size)) & (rrun > 0)
    found = ok.any(1)
    far_r = reach - ok[:, ::-1].argmax(1)
    far_l = reach - ok.argmax(1)
    rows = np.arange(len(ca))

    def trimmed(far: np.ndarray, best: np.ndarray, beyond: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = best[rows, far]
        hit = ((step < run) | beyond[d, rows]) & (step <= far[:, None])
        return reach - hit[:, ::-1].argmax(1), shift[d]

    (tl, sl), (tr, sr) = trimmed(far_l, lbest, lbeyond, lrun), trimmed(far_r, rbest, rbeyond, rrun)
    return np.stack([found, ca - tl, ca + tr + 1, cb - tl + sl, cb + tr + sr + 1], axis=1)


# From here to ``_with_places``: steps that keys with many places took before; nothing but tests calls them any more.


def _align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hits that match, each with the passage it lies in; passages of a pair that overlap on one diagonal are one.

    A passage goes on to the end of the run of places that its place stands for, on either side.
    """
    for batch in batches:
        for half in sliced([batch], "sh_a", 1 << 21):
            for b in sliced([half], "sh_b", 1 << 21):
                left, right = _hashes(b.column("sh_a")), _hashes(b.column("sh_b"))
                hits = b.column("hits")
                pair, v = pc.list_parent_indices(hits).to_numpy(), pc.list_flatten(hits)
                ca, cb, more_a, more_b = (v.field(n).to_numpy().astype(np.int64) for n in ("c", "c_b", "more", "more_b"))
                cut = b.column("cut").to_numpy()[pair]  # where the left text's piece begins
                m = np.concatenate([matches(left, right, pair[k : k + HITS], (ca - cut)[k : k + HITS], cb[k : k + HITS]) for k in range(0, len(pair), HITS)])
                m[:, 1:3] += cut[:, None]
                at = np.flatnonzero(m[:, 0])
                at = at[np.lexsort((m[at, 1], (ca - cb)[at], pair[at]))]
                p, d, s = pair[at], (ca - cb)[at], m[at, 1:]
                new = np.ones(len(at), bool)
                new[1:] = (p[1:] != p[:-1]) | (d[1:] != d[:-1]) | (s[1:, 0] > s[:-1, 1])
                begin = np.flatnonzero(new)
                if len(at):
                    group = np.cumsum(new) - 1
                    s = s + np.stack([0 * more_a, more_a, 0 * more_b, more_b], axis=1)[at]  # as far as their runs go
                    s = np.stack([f.reduceat(s[:, k], begin)[group] for k, f in enumerate((np.minimum, np.maximum) * 2)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [v.field("key").take(pa.array(at)), b.column("a").take(pa.array(p)), pa.array(ca[at].astype(np.int32)), b.column("b").take(pa.array(p)), pa.array(cb[at].astype(np.int32)), *(pa.array(s[:, k].astype(np.int32)) for k in range(4))],
                    ["key", "a", "c", "b", "c_b", "from", "to", "from_b", "to_b"],
                )


def _per_place(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Batches of texts with their places, text by text: text number, its shingles, and the places' columns."""
    for b in sliced(batches, "sh", 1 << 18):
        sh, first = _hashes(b.column("sh"))
        for k, t in enumerate(b.column("t").to_pylist()):
            at = b.column("at")[k].values
            yield t, sh[first[k] : first[k + 1]].astype(U), *(at.field(x).to_numpy(zero_copy_only=False) for x in ("key", "c", "lo", "hi", "open", "more"))


def surroundings(sh: np.ndarray, at: np.ndarray, reach: int = RUN - 1 + SHIFT) -> pa.Array:
    """A hash of all that ``matches`` looks at around each place: equal ones in one text are alike to every other text."""
    edge = np.zeros(reach, U)
    return pa.array(window_hashes(np.concatenate([edge, sh + U(1), edge]), 2 * reach + 1)[at].view(np.int64))


def _seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A finer key for each seed of each place, of its whole content; the seed's first shingle becomes the anchor."""
    for t, sh, _, _, lo, hi, still, more in _per_place(batches):
        n = hi - lo + 1
        of = np.repeat(np.arange(len(n)), n)
        p = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of]
        key = mix(window_hashes(sh, SEED)[p], 50).view(np.int64)
        at = pa.array(p.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(of), t, np.int64)), at, at, at, surroundings(sh, p), pa.array(still[of]), pa.array(more[of])], ["key", "a", "c", "lo", "hi", "around", "open", "more"])


def _longer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finer keys of places that share a whole seed, one of which two windows that match have in common.

    Of the AGREE + 1 shingles that agree, MORE or more beyond the seed lie either in its own run or in a run beyond the
    gap: keys are the runs of SEED + MORE shingles around the seed, and the seed with each run of MORE that may follow
    or go before it. The first of its shingles is the anchor.
    """
    far = range(GAP[0], GAP[1] + MORE)
    for t, sh, key, c, _, _, still, more in _per_place(batches):
        long_, short = window_hashes(sh, SEED + MORE) if len(sh) >= SEED + MORE else sh[:0], window_hashes(sh, MORE)
        found = []
        for k in range(MORE + 1):
            at = c - k
            ok = (at >= 0) & (at < len(long_))
            found.append((mix(long_[at[ok]], 51), at[ok], still[ok], more[ok]))
        for side, steps in ((60, [SEED + o for o in far]), (61, [-MORE - o for o in far])):
            for o in steps:
                at = c + o
                ok = (at >= 0) & (at < len(short))
                found.append((mix(key[ok].view(U) * U(0x9E3779B97F4A7C15) + short[at[ok]], side), c[ok], still[ok], more[ok]))
        keys, at, open_, more = (np.concatenate([f[k] for f in found]) for k in range(4))
        around, at = surroundings(sh, at), pa.array(at.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), t, np.int64)), at, at, at, around, pa.array(open_), pa.array(more)], ["key", "a", "c", "lo", "hi", "around", "open", "more"])


def _asked_only(finer_keys: Callable, asked: Broadcast) -> Callable:
    """``finer_keys`` without the keys that no open place has, as far as a bit map of those tells: they don't leave the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in finer_keys(batches):
            keep = np.flatnonzero(asked.value.has(b.column("key").to_numpy().view(U)))
            if len(keep):
                yield b.take(pa.array(keep))

    return run


def _context(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of shingles in a row that windows with one of a text's places can have, and where they are."""
    for t, sh, _, c, _, _, still, _ in _per_place(batches):
        near = np.zeros(len(sh) + 1, np.int64)
        np.add.at(near, np.maximum(c - RUN - SHIFT, 0), 1)
        np.add.at(near, np.minimum(c + RUN + SHIFT, len(sh)), -1)
        at = np.flatnonzero(np.cumsum(near[:-1])[:-1])
        x = window_hashes(sh, 2)[at].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int64)), pa.array(at.astype(np.int32)), pa.array(x), pa.array(np.full(len(at), still.any()))], ["a", "at", "x", "open"])


def _alive(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places with a window of which enough pairs are such that other texts have them: AGREE shingles in two runs have two fewer."""
    for b in batches:
        for k, t in enumerate(b.column("a").to_pylist()):
            v, near = b.column("places")[k].values, b.column("near")[k].values.to_numpy()
            c = v.field("c").to_numpy().astype(np.int64)
            count = np.concatenate([[0], np.cumsum(np.bincount(near, minlength=int(c.max()) + 1))])
            begin = np.maximum(c[:, None] - np.arange(RUN), 0)
            many = count[np.minimum(begin + RUN - 1, len(count) - 1)] - count[np.minimum(begin, len(count) - 1)]
            kept = v.filter(pa.array(many.max(1) >= AGREE - 2))
            yield pa.RecordBatch.from_arrays([kept.field("key"), pa.array(np.full(len(kept), t, np.int64)), *(kept.field(n) for n in ("c", "lo", "hi"))], ["key", "a", "c", "lo", "hi"])


def _with_places(rows: DataFrame, still: DataFrame, content: DataFrame) -> DataFrame:
    """Texts with all their places of the keys that have open places: ``t, sh, at``."""
    flag = still.select("key", "a", "c", F.lit(True).alias("open"))
    hot = rows.join(still.select("key").distinct(), "key", "left_semi").join(flag, ["key", "a", "c"], "left").withColumn("open", F.col("open").isNotNull())
    more = F.col("more") if "more" in rows.columns else F.lit(0)
    by_text = hot.groupBy(F.col("a").alias("t")).agg(F.collect_list(F.struct("key", "c", "lo", "hi", "open", more.alias("more"))).alias("at"))
    return by_text.join(content.hint("merge"), "t").select("t", "sh", "at")


def _can_match(rows: DataFrame, still: DataFrame, content: DataFrame) -> DataFrame:
    """The open places around which enough is such that other texts with open keys have it near places too.

    What two texts have in common neither has alone: edits that no other text has end a place's search, exactly.
    """
    around = stash(_with_places(rows, still, content).mapInArrow(_context, "a long, at int, x long, open boolean"))
    shared = around.groupBy("x").agg(F.min("a").alias("p"), F.max("a").alias("q")).where("p < q").select("x")
    near = around.where("open").join(shared, "x").groupBy("a").agg(F.collect_list("at").alias("near"))
    by_text = still.groupBy("a").agg(F.collect_list(F.struct("key", "c", "lo", "hi")).alias("places"))
    out = stash(by_text.join(near, "a").mapInArrow(_alive, "key long, a long, c int, lo int, hi int"))
    unstash(around)
    return out


def _surrounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles around each place of a key with few kinds."""
    reach = RUN - 1 + SHIFT
    for b in sliced(batches, "sh", 1 << 18):
        sh, first = _hashes(b.column("sh"))
        at = b.column("at")
        text, v = pc.list_parent_indices(at).to_numpy(), pc.list_flatten(at)
        few = np.flatnonzero(~v.field("many").to_numpy(zero_copy_only=False))
        text, v = text[few], v.take(pa.array(few))
        c = v.field("c").to_numpy().astype(np.int64)
        lo, hi = np.maximum(c - reach, 0), np.minimum(c + reach + 1, np.diff(first)[text])
        size = hi - lo
        at = np.cumsum(size) - size
        data = sh[np.arange(int(size.sum())) + np.repeat(first[text] + lo - at, size)]
        yield pa.RecordBatch.from_arrays([v.field("key"), v.field("cid"), b.column("t").take(pa.array(text)), v.field("multi"), pa.array((c - lo).astype(np.int32)), binaries(data, np.append(at, len(data)))], ["key", "cid", "t", "multi", "c", "sh"])


def _whole_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows in the order of their keys, cut between keys."""
    rest = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut or (rest and rest[-1].column("key")[-1].as_py() != key[0]):
            if cut and rest:
                rest.append(b.slice(0, cut))
            elif cut:
                rest = [b.slice(0, cut)]
            yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
            rest = []
        rest.append(b.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All kinds of a key against each other, both ways: what matches around each, and one label for all that are linked."""
    for b in _whole_keys(batches):
        side = _hashes(b.column("sh"))
        key, cid, t, c = (b.column(n).to_numpy() for n in ("key", "cid", "t", "c"))
        multi, n = b.column("multi").to_numpy(zero_copy_only=False), np.arange(b.num_rows)
        c, size = c.astype(np.int64), np.diff(side[1])
        x, y = _near(side, n, c, RUN - 1, -1), _near(side, n, c, RUN - 1 + SHIFT, -2)
        lo, hi = np.full(len(n), 1 << 20), np.full(len(n), -(1 << 20))
        parent = n.tolist()

        def root(k: int, parent: list = parent) -> int:
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        i, j = [], []
        for step in range(1, len(n)):
            at = np.flatnonzero(key[:-step] == key[step:])
            if not len(at):
                break
            i.append(at)
            j.append(at + step)
        if not i:
            continue
        i, j = np.concatenate(i), np.concatenate(j)
        apart = (t[i] != t[j]) | multi[i] | multi[j]  # the same document is no other one
        i, j = np.concatenate([i[apart], j[apart]]), np.concatenate([j[apart], i[apart]])
        for k in range(0, len(i), HITS):
            p, q = i[k : k + HITS], j[k : k + HITS]
            m = near_matches(x[p], y[q], size[p], size[q], c[p], c[q])
            hit = np.flatnonzero(m[:, 0])
            p, q, m = p[hit], q[hit], m[hit]
            for of, a, z in ((p, 1, 2), (q, 3, 4)):
                np.minimum.at(lo, of, m[:, a] - c[of])
                np.maximum.at(hi, of, m[:, z] - c[of])
            for u, v in zip(p.tolist(), q.tolist(), strict=True):
                u, v = root(u), root(v)
                parent[max(u, v)] = min(u, v)
        at = np.flatnonzero(hi > lo)
        label = cid[[root(k) for k in at.tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(lo[at].astype(np.int32)), pa.array(hi[at].astype(np.int32)), pa.array(label)], ["cid", "lo", "hi", "label"])


def _spelled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places in shingles as code points of the text as it is."""
    for b in sliced(batches):
        data, offs = flat(b.column("text"))
        begin, end, first = spans(data, offs, BREAK)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = b.column("at")
        text, v = pc.list_parent_indices(at).to_numpy(), pc.list_flatten(at)
        base, chars = first[text], lead[offs[text]]
        lo, hi = (v.field(n).to_numpy().astype(np.int64) for n in ("from", "to"))
        start, stop = lead[begin[base + lo]] - chars, lead[end[base + hi + SHINGLE - 2]] - chars
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(text)), pa.array(start), pa.array(stop), v.field("label"), v.field("is_first")], ["doc_id", "start", "end", "passage_id", "is_first"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of 50 plain words or more that another document has too: ``doc_id, start, end, passage_id, is_first``.

    ``start`` and ``end`` are code points of the text, end exclusive; passages of a document that overlap are one.
    ``passage_id`` is the same for all places of a passage; ``is_first`` marks one of them, in the document of least id
    (null ids last). Windows match if their aligned shingles have Jaccard similarity 0.8 or more.
    Repeated rows match each other over their whole text. A text that holds a run of words several times is matched at
    every place of it, stretches that repeat a few words over and over (``la la la``) included. Null, empty and shorter texts have no passage; an empty
    table gives an empty result; other columns are not looked at.
    """
    rows = tagged(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    # keys alone are dealt out; places of keys that no other text has, but for some that a bit map lets pass, stay in their task
    dealt = rows.select(TAG, "text").mapInArrow(_place_keys, "key long, a long").repartition("key")
    shared = stash(dealt.groupBy("key").agg(F.min("a").alias("x"), F.max("a").alias("y")).where("x < y").select("key"))
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(shared, KEY_BITS))
    at = stash(rows.select(TAG, "text").mapInArrow(lambda batches: _places(batches, bits), "a long, key long, cid long, c int, edge int, more int"))
    unstash(shared)
    bits.destroy()
    # kinds of places: one place stands for all with equal surroundings, which match whole where they are in two texts
    kinds = at.groupBy("key", "cid").agg(F.min(F.struct("a", "c")).alias("rep"), (F.min("a") != F.max("a")).alias("multi"))
    kinds = stash(kinds.withColumn("n", F.count("*").over(Window.partitionBy("key"))).select("key", "cid", "rep.a", "rep.c", "multi", "n"))
    content = rows.select(TAG, "text").mapInArrow(_content, "t long, sh binary")
    by_text = kinds.where("n > 1").groupBy(F.col("a").alias("t")).agg(F.collect_list(F.struct("key", "cid", "c", "multi", (F.col("n") > SMALL).alias("many"))).alias("at"))
    texts = stash(by_text.join(content.hint("merge"), "t").select("t", "sh", "at"))
    found = stash(texts.mapInArrow(_surrounded, "key long, cid long, t long, multi boolean, c int, sh binary").repartition("key").sortWithinPartitions("key").mapInArrow(_compared, "cid long, lo int, hi int, label long"))
    hot = texts.where(F.exists("at", lambda p: p["many"]))
    if not hot.isEmpty():
        found = found.unionByName(masked_matches(hot))
    unstash(texts)
    far = F.lit(2 * RUN)
    covers = found.select("cid", "lo", "hi").union(kinds.where("multi").select("cid", -far, far)).groupBy("cid").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    before, after = F.col("edge") % 256, F.shiftright("edge", 8)
    spans_ = at.join(covers, "cid").withColumn("lo", F.greatest("lo", -before)).withColumn("hi", F.least("hi", after))
    places_ = spans_.select(F.col("a").alias("t"), "cid", (F.col("c") + F.col("lo")).alias("from"), (F.col("c") + F.col("hi") + F.col("more")).alias("to"), (F.col("c") + after + F.col("more")).alias("stop"))
    # overlapping places of a document are one: its places in order, so a window is no longer than the text
    by_text = Window.partitionBy("t").orderBy("from")
    reach = F.max("to").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    begun = places_.withColumn("begin", F.when(F.coalesce(F.col("from") >= reach, F.lit(True)), F.col("from")))
    grouped = begun.withColumn("place", F.max("begin").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = stash(grouped.select("t", "cid", "from", "to", "stop", F.xxhash64("t", "place").alias("node")))
    # kinds are linked through one passage each
    through = stash(grouped.groupBy("cid").agg(F.min("node").alias("hub")))
    links = found.where("cid != label").select("cid", "label").distinct()
    between = links.join(through, "cid").join(through.toDF("label", "other"), "label").select(F.col("hub").alias("a"), F.col("other").alias("b"))
    edges = grouped.join(through, "cid").select(F.col("node").alias("a"), F.col("hub").alias("b")).union(between).where("a != b").distinct()
    labels = components(edges)
    merged = grouped.groupBy("t", "node").agg(F.min("from").alias("from"), F.max("to").alias("to"), F.max("stop").alias("stop"))
    # what an aligned window leaves short is made up to RUN shingles, as far as no other passage is there
    lack, near = F.col("from") + RUN - F.col("to"), Window.partitionBy("t").orderBy("from")
    merged = merged.withColumn("room", F.col("from") - F.coalesce(F.lag("to").over(near), F.lit(0))).withColumn("end", F.least("stop", F.lead("from").over(near)))
    merged = merged.withColumn("from", F.when(lack > 0, F.col("from") - F.least(lack, "room")).otherwise(F.col("from")))
    merged = merged.select("t", "node", "from", F.when(lack > 0, F.least(F.col("from") + RUN, "end")).otherwise(F.col("to")).alias("to"))
    named = stash(merged.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(rows.select(F.col(TAG).alias("t"), "doc_id"), "t"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "t", "from")
    firsts = named.groupBy("label").agg(F.min(order).alias("first"))
    named = named.join(firsts, "label").withColumn("is_first", (F.col("t") == F.col("first.t")) & (F.col("from") == F.col("first.from")))
    by_text = named.groupBy("t").agg(F.collect_list(F.struct("from", "to", "label", "is_first")).alias("at"))
    texts = by_text.hint("merge").join(rows.select(F.col(TAG).alias("t"), "doc_id", "text"), "t").select("doc_id", "text", "at")
    return texts.mapInArrow(_spelled, f"doc_id {id_type}, start long, end long, passage_id long, is_first boolean")
