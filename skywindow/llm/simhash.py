"""Near-duplicate documents by SimHash, with vantage-point trees over the fingerprints.

A tree node has a vantage point and a radius: fingerprints within it go to the inner branch, all others to the outer one. By
the triangle inequality, two fingerprints whose distances from the vantage point differ by more than the links' reach can't
be linked, so that only those just outside of the radius are compared with the inner branch as well: they visit it as
guests. A shard (leaf of the tree) compares those that live in it with each other and with its guests.

Distances of 64 bits gather around 32, where nothing could be pruned. So there is a tree for each of three parts of the
bits: of 4 differing bits, one part has at most one, and the distances of a part spread widely against that.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TAG, flat, sliced, stash, tagged, unstash
from .graph import components
from .textvec import SPACE, U, mix, spans

SHINGLE, SEED = 4, 42
#: Fingerprints are linked at so many differing bits or fewer.
LINKED = 4
#: The parts of the bits (the lowest, how many), each with its own tree. Of ``LINKED`` differing bits one has at most one.
PARTS = ((0, 22), (22, 21), (43, 21))
#: Trees are grown until a shard has about so many fingerprints. Vantage points come from a sample of about so many, and at most
#: a quarter; where it has fewer than FEW left in a node, they come from the way to it, and the radius is half the part's bits.
SHARD, SAMPLE, FEW = 2048, 8192, 32
#: Most rows of a comparison: larger shards (many fingerprints around one point) are compared piece by piece.
PIECE = 8192
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Shingles whose bits are counted at a time.
_STEP = 1 << 16


def fingerprint(words: list[bytes]) -> int:
    """Of one text's words: bit i is set if it is in over half of the hashes of its shingles; 0 without words."""
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[j:] for j in range(SHINGLE)), strict=False))
    return int(_bits(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), U)))


def _bits(hashes: np.ndarray) -> np.uint64:
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), _STEP):
        total += np.unpackbits(hashes[a : a + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0]


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        data, offs = flat(b.column("text"))
        data = _LOWER[data]
        start, end, first = spans(data, offs, SPACE)
        # the words of all texts with one space behind each, so that a shingle is a stretch of bytes
        size = end - start + 1
        at = np.cumsum(size) - size
        packed = np.full(int(size.sum()), 0x20, np.uint8)
        packed[np.arange(len(packed)) - np.repeat(at, size) < np.repeat(size - 1, size)] = data[np.repeat(start, size - 1) + np.arange(int((size - 1).sum())) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)]
        whole, digest, out = packed.tobytes(), xxhash.xxh64_intdigest, np.zeros(b.num_rows, U)
        stop = at + size - 1
        for k in range(b.num_rows):
            i, j = int(first[k]), int(first[k + 1])
            if i < j:
                froms, tos = (at[i:j], stop[i + SHINGLE - 1 : j]) if j - i >= SHINGLE else (at[i : i + 1], stop[j - 1 : j])
                froms, tos = froms[: len(tos)].tolist(), tos.tolist()
                out[k] = _bits(np.fromiter((digest(whole[x:y], SEED) for x, y in zip(froms, tos, strict=True)), U, len(tos)))
        yield pa.RecordBatch.from_arrays([b.column(TAG), b.column("doc_id"), pa.array(out.view(np.int64))], [TAG, "doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__tag, doc_id, fp``: the fingerprint as a signed long; 0 for null, empty and blank texts."""
    rows = tagged(docs, id_col, text_col)
    return rows.mapInArrow(_sign, f"{TAG} long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _part(fp: np.ndarray, part: int) -> np.ndarray:
    low, width = PARTS[part]
    return (fp >> U(low)) & U((1 << width) - 1)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y)


class Tree:
    """A vantage-point tree over one part of the bits: arrays of nodes, -1 for no child.

    ``total`` fingerprints are expected, of which ``sample`` is a part. The shape decides only how even the shards are. Below
    the nodes that the sample can fill, the tree goes on for ``depth`` levels with vantage points drawn from the way there.
    """

    def __init__(self, part: int, sample: np.ndarray, total: int):
        self.part, self.vantage, self.radius, self.inner, self.outer, self.depth = part, [], [], [], [], []
        every = total / max(len(sample), 1)
        todo = [(-1, False, _part(sample, part))]
        while todo:
            parent, is_inner, here = todo.pop()
            node = len(self.vantage)
            if parent >= 0:
                (self.inner if is_inner else self.outer)[parent] = node
            rows, best = every * len(here), None
            if rows > SHARD and len(here) >= FEW:  # of a few candidates the one with the fewest guests and an even split
                for c in here[(mix(np.arange(8, dtype=U), node) % U(len(here))).astype(np.int64)]:
                    d = _distance(here, c)
                    r = int(np.median(d))
                    cost = max(np.mean(d <= r + 1), np.mean(d > r))
                    if cost < 0.9 and (best is None or cost < best[0]):
                        best = (cost, int(c), r)
            for values, x in ((self.vantage, best[1] if best else 0), (self.radius, best[2] if best else -1), (self.inner, -1), (self.outer, -1)):
                values.append(x)
            # many around one point can't be told apart: they stay together and are compared in pieces
            self.depth.append(0 if best or len(here) >= FEW else int(np.ceil(np.log(max(rows / SHARD, 1)) / np.log(1 / 0.6))))
            if best:
                d = _distance(here, U(best[1]))
                todo += [(node, True, here[d <= best[2] + 1]), (node, False, here[d > best[2]])]
        self.vantage = np.array(self.vantage, U)
        self.radius, self.inner, self.outer, self.depth = (np.array(x, np.int64) for x in (self.radius, self.inner, self.outer, self.depth))

    def _step(self, value, vantage, r, home, near):
        """Where rows go on: indices of the old rows, whether inwards, whether they live there, and their ``near``.

        A resident's partners have its own value, and go the same way, or differ in one bit. Of those that go the other way, it
        meets the ones in the inner branch, as a guest. ``near`` has the bits in which a guest's partners there may differ from
        it: such a bit brings the partner closer to the vantage point if the guest itself differs from that in it, else
        further off. A guest goes wherever it has partners left.
        """
        z = value ^ vantage
        d = np.bitwise_count(z).astype(np.int64)
        inside = d <= r
        inner = np.where(d < r, near, np.where(d <= r + 1, near & z, U(0)))
        outer = near & ~inner
        at = [np.flatnonzero(home), np.flatnonzero(home & (d == r + 1)), np.flatnonzero(~home & (inner > 0)), np.flatnonzero(~home & (outer > 0))]
        n = [len(x) for x in at]
        inwards = np.concatenate([inside[at[0]], np.ones(n[1] + n[2], bool), np.zeros(n[3], bool)])
        lives = np.concatenate([np.ones(n[0], bool), np.zeros(n[1] + n[2] + n[3], bool)])
        return np.concatenate(at), inwards, lives, np.concatenate([np.zeros(n[0], U), z[at[1]], inner[at[2]], outer[at[3]]])

    def route(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The shards that each fingerprint is in: its number, the shard, and whether it lives there (else it is a guest)."""
        value, width = _part(fp, self.part), PARTS[self.part][1]
        row, node, home, near = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.ones(len(fp), bool), np.zeros(len(fp), U)
        leaves, out = [], []
        while len(row):
            leaf = self.radius[node] < 0
            leaves.append((row[leaf], node[leaf], home[leaf], near[leaf]))
            row, node, home, near = row[~leaf], node[~leaf], home[~leaf], near[~leaf]
            at, inwards, home, near = self._step(value[row], self.vantage[node], self.radius[node], home, near)
            row, node = row[at], np.where(inwards, self.inner[node[at]], self.outer[node[at]])
        row, node, home, near = (np.concatenate([x[i] for x in leaves]) if leaves else np.zeros(0, np.int64) for i in range(4))
        way, level = np.ones(len(row), np.int64), 0
        while len(row):
            done = self.depth[node] <= level
            out.append((row[done], ((node[done] * len(PARTS) + self.part) << 40) | way[done], home[done]))
            row, node, home, near, way = row[~done], node[~done], home[~done], near[~done], way[~done]
            vantage = mix((node << 40 | way).astype(U), 31 + self.part) & U((1 << width) - 1)
            at, inwards, home, near = self._step(value[row], vantage, np.int64(width // 2), home, near)
            row, node, way, level = row[at], node[at], 2 * way[at] + inwards, level + 1
        return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))


def _router(trees):
    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.asarray(b.column("fp")).view(U)
            for tree in trees.value:
                for a in range(0, len(fp), _STEP):
                    row, shard, home = tree.route(fp[a : a + _STEP])
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[a : a + _STEP][row].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    return route


def links(x: np.ndarray, y: np.ndarray, part: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (positions in x and y) at ``LINKED`` bits or fewer that this part's tree has to find: it is the first with at most
    one differing bit."""
    step = max(1, (1 << 21) // max(len(y), 1))
    for a in range(0, len(x), step):
        i, j = np.nonzero(np.bitwise_count(x[a : a + step, None] ^ y[None, :]) <= LINKED)
        i += a
        keep = i < j if same else np.ones(len(i), bool)
        for p in range(part + 1):
            keep &= (_distance(_part(x[i], p), _part(y[j], p)) > 1) == (p < part)
        yield i[keep], j[keep]


def forest(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Fewer than n pairs with the same components: of each of 0..n-1 that isn't the first of its component, and that first."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    rest = np.flatnonzero(label != np.arange(n))
    return rest, label[rest]


def _compare(all_links: bool):
    """One comparison: residents of piece ``p`` with those of piece ``q``, and residents of ``p`` with guests of ``q``."""

    def run(table: pa.Table) -> pa.Table:
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        part = (table.column("shard")[0].as_py() >> 40) % len(PARTS)
        fp, home, piece = np.asarray(table.column("fp")).view(U), np.asarray(table.column("home")), np.asarray(table.column("piece"))
        mine, theirs, guests = (np.flatnonzero(x) for x in (home & (piece == p), home & (piece == q), ~home & (piece == q)))
        sides = [(mine, guests, False)] + ([(mine, mine, True)] if p == q else [(mine, theirs, False)] if p < q else [])
        found = ((x[i], y[j]) for x, y, same in sides for i, j in links(fp[x], fp[y], part, same))
        if all_links:
            found = [(np.zeros(0, np.int64),) * 2, *found]
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        else:
            a, b = forest(len(fp), found)
        return pa.table({"a": pa.array(fp[a].view(np.int64)), "b": pa.array(fp[b].view(np.int64))})

    return run


def linked(prints: DataFrame, all_links: bool = False) -> DataFrame:
    """Pairs ``a, b`` of the distinct fingerprints ``fp`` (a stored table) with the components that all links have.

    Each comparison gives a forest of its links, so that many fingerprints around one point don't give the square of their
    number; with ``all_links`` it gives every link, each once.
    """
    spark = prints.sparkSession
    total = prints.count()
    # a bounded sample: those of least hash, for the shape of the trees alone
    share = min(0.25, SAMPLE / max(total, 1))
    sample = prints.where(F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("fp").toPandas()["fp"].to_numpy(np.int64).view(U)
    trees = spark.sparkContext.broadcast([Tree(p, sample, total) for p in range(len(PARTS))])
    dealt = stash(prints.select("fp").mapInArrow(_router(trees), "shard long, fp long, home boolean"))
    pieces = dealt.groupBy("shard").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("n"), F.max("home").alias("lived")).where("lived")
    piece = F.pmod(F.xxhash64("fp", F.lit(9)), F.col("n").cast("long")).cast("int")
    rows = dealt.join(pieces, "shard").select("shard", "fp", "home", "n", piece.alias("piece"))
    # a comparison for each two pieces; a row goes to those of its own piece
    every = F.sequence(F.lit(0), F.col("n") - 1)
    as_p = F.transform(every, lambda k: F.struct(F.col("piece").alias("p"), k.alias("q")))
    as_q = F.transform(F.filter(every, lambda k: k != F.col("piece")), lambda k: F.struct(k.alias("p"), F.col("piece").alias("q")))
    meets = F.when(F.col("n") == 1, F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))).when(F.col("home"), F.concat(as_p, as_q)).otherwise(F.concat(as_q, F.array(F.struct(F.col("piece").alias("p"), F.col("piece").alias("q")))))
    met = rows.select("shard", "fp", "home", "piece", F.explode(meets).alias("m")).select("shard", "fp", "home", "piece", "m.p", "m.q")
    return met.groupBy("shard", "p", "q").applyInArrow(_compare(all_links), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, fingerprint, component_id`` (the least id of all that links reach).

    ``fingerprint`` is 16 lowercase hex digits. Texts are lower-cased in A-Z only; words are what is between ASCII white space;
    a text with fewer than four words is one shingle. Null, empty and blank texts have fingerprint zero and are linked like
    all others, so that they are one component. Equal fingerprints are compared once. Repeated rows are in one component;
    null ids take part but name a component only if it has no other. An empty table gives an empty result.
    """
    signed = stash(fingerprints(docs, id_col, text_col))
    prints = stash(signed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(stash(linked(prints)))
    grouped = prints.join(labels.toDF("fp", "label"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = grouped.join(grouped.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("fp", "component_id")
    named = stash(named)
    unstash(prints)
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return signed.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")
