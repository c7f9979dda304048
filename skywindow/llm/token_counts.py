"""Token counts without token ids.

Every text is cut into the tokenizer's pre-tokens; pieces are counted once for each distinct pre-token, joined to the
documents' pre-token frequencies, and summed. Pre-tokens that are entries of the vocabulary (a table whose size the
tokenizer file fixes) are joined in the scan; all others are dealt by pre-token, with the documents that hold them as
compact posting lists, and counted where they meet.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TAG, binaries, settled, sliced, tagged

#: Bytes of text whose pre-tokens a task gathers before it hands them on; more means fewer, longer posting lists.
BLOCK_BYTES = 8 << 20
#: Pre-tokens whose counts a task remembers while equal ones pass by.
REMEMBERED = 200_000
#: Bytes of a block's postings from which a pre-token's blocks are dealt to several places, and how many.
LONG_POSTINGS, SALTS = 1 << 10, 256
LETTER, NUMBER, WHITE, OTHER = 1, 2, 3, 4
#: What a leading apostrophe splits off, by the letters after it (fixed values of byte-level pre-tokenizers).
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
POSTING = np.dtype([("doc", "<u2"), ("times", "u1")])
SUM = np.dtype([("tag", "<i8"), ("n", "<i8")])
#: A block's sum as it is passed on: the document's distance from the block's first tag, and pieces (a text has less than 2^31 bytes).
PART = np.dtype([("doc", "<u2"), ("n", "<u4")])
#: Sums that a task gathers before it hands them on.
SUMS = 1 << 20


class Counter:
    """The tokenizer of a file: pre-token classes, special strings, and piece counts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes = np.zeros(0x110000, np.uint8)

    def classify(self, points: np.ndarray) -> np.ndarray:
        """The class of each code point, as the tokenizer's own pre-tokenizer shows it."""
        seen = np.unique(points)
        pre = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for c in seen[self.classes[seen] == 0]:
            ch = chr(c)
            self.classes[c] = LETTER if len(pre("a" + ch)) == 1 else NUMBER if len(pre("1" + ch)) == 1 else WHITE if len(pre("\n" + ch)) == 1 else OTHER
        return self.classes[points]

    def counts(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter((len(e.ids) for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)), np.int64, len(pieces))

    @lru_cache(1)  # noqa: B019
    def vocabulary(self) -> tuple[pa.Array, np.ndarray]:
        """The vocabulary's entries that are whole text, and their own counts (one more, 0, for whatever isn't one)."""
        ids = sorted(self.tokenizer.get_vocab(with_added_tokens=False).values())
        words = [w for w in dict.fromkeys(self.tokenizer.decode([i]) for i in ids) if w and "�" not in w]
        return pa.array(words, pa.large_string()), np.append(self.counts(words), 0)


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(path)


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(size)])


def strings_of(texts: list[str], points: np.ndarray, cuts: np.ndarray) -> pa.DictionaryArray:
    """The stretches between the cuts of the joined texts, numbered by what they are."""
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[cuts]
    return pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(at), pa.py_buffer("".join(texts).encode())]).dictionary_encode()


def pretokens(points: np.ndarray, texts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where each pre-token begins (one more entry at the end), for non-empty texts that begin at ``texts[:-1]``."""
    n = len(points)
    begin = np.zeros(n + 1, bool)
    begin[texts] = True
    run = begin.copy()
    run[1:n] |= classes[1:] != classes[:-1]
    starts = np.flatnonzero(run[:n])
    ends = np.append(starts[1:], n)
    kind = classes[starts]
    final = begin[ends]
    out = run.copy()
    # white space before more text: its last character stands alone, or leads the next pre-token if it is a space
    lead = (kind == WHITE) & ~final
    last = ends[lead] - 1
    out[last] = True
    joined = last[points[last] == 0x20]
    out[joined + 1] = False
    # an apostrophe that begins a pre-token takes a contraction's letters with it
    quote = starts[(kind == OTHER) & (points[starts] == 0x27) & out[starts]]
    quote = quote[(quote + 1 < n)]
    for letters in CONTRACTIONS:
        k, here = len(letters), quote[quote + len(letters) < n]
        ok = np.ones(len(here), bool)
        for j, ch in enumerate(letters, 1):
            ok &= (points[here + j] == ord(ch)) & ~begin[here + j]
        here = here[ok & out[here]]
        out[here + 1] = False
        follow = here + k + 1
        out[follow] = True
    return np.flatnonzero(out)


def _postings(path: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block: postings of pre-tokens outside the vocabulary, and the documents' sums over all others."""
    from . import token_counts as here

    counter_ = here.counter(path)
    known, known_n = counter_.vocabulary()
    held: list[tuple[np.ndarray, list[str]]] = []
    size = rows = 0

    def out() -> pa.RecordBatch:
        tags = np.concatenate([t for t, _ in held])
        docs, parts, extra = [], [], np.zeros(len(tags), np.int64)
        for k, text in enumerate(x for _, xs in held for x in xs):
            cut = [text]
            for s in counter_.special:
                if s in text:
                    cut = [y for x in cut for y in x.split(s)]
            extra[k] = len(cut) - 1
            for x in cut:
                if x:
                    docs.append(k)
                    parts.append(x)
        found, base, pieces = [], 0, []  # (piece, doc, times), pieces numbered on from one stretch to the next
        a = 0
        while a < len(parts):
            b, n = a, 0
            while b < len(parts) and (b == a or n + len(parts[b]) <= 1 << 20):
                n += len(parts[b])
                b += 1
            points, bounds = points_of(parts[a:b])
            cuts = pretokens(points, bounds, counter_.classify(points))
            words = strings_of(parts[a:b], points, cuts)
            ids, doc = np.asarray(words.indices).astype(np.int64), np.asarray(docs[a:b])[np.searchsorted(bounds, cuts[:-1], "right") - 1]
            entry = np.asarray(pc.fill_null(pc.index_in(words.dictionary, value_set=known), len(known)))
            extra += np.bincount(doc, known_n[entry[ids]], len(tags)).astype(np.int64)
            left = entry[ids] == len(known)
            pair, times = np.unique(ids[left] * len(tags) + doc[left], return_counts=True)
            own, number = np.unique(pair // len(tags), return_inverse=True)
            found.append((base + number, pair % len(tags), times))
            pieces.append(words.dictionary.take(pa.array(own)))
            base += len(own)
            a = b
        hs, ds, ts = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        names = (pa.concat_arrays(pieces) if pieces else pa.array([], pa.large_string())).dictionary_encode()
        hs = np.asarray(names.indices).astype(np.int64)[hs]
        order = np.lexsort((ds, hs))
        hs, ds, ts = hs[order], ds[order], ts[order]
        many = (ts + 254) // 255  # a posting holds up to 255 occurrences
        hs, ds = np.repeat(hs, many), np.repeat(ds, many)
        step = np.arange(len(hs)) - np.repeat(np.cumsum(many) - many, many)
        post = np.zeros(len(hs), POSTING)
        post["doc"], post["times"] = ds, np.minimum(np.repeat(ts, many) - 255 * step, 255)
        new = np.ones(len(hs), bool)
        new[1:] = hs[1:] != hs[:-1]
        at = np.flatnonzero(new)
        count = len(at)
        piece = pa.concat_arrays([names.dictionary.take(pa.array(hs[at])).cast(pa.string()), pa.array([None], pa.string())])
        # the last row of a block carries its row tags and the sums so far
        post_col = binaries(np.frombuffer(post.tobytes(), np.uint8), np.append(at, len(hs)) * POSTING.itemsize)
        sums = np.zeros(len(tags), SUM)
        sums["tag"], sums["n"] = tags, extra
        post_col = pa.concat_arrays([post_col, pa.array([sums.tobytes()], pa.binary())])
        base = pa.array(np.full(count + 1, tags[0]))
        return pa.RecordBatch.from_arrays([piece, base, post_col], ["piece", "base", "postings"])

    for batch in sliced(batches):
        tags = np.asarray(batch.column(TAG))
        texts = [x or "" for x in batch.column("text").to_pylist()]
        # postings name a document by its distance from the block's first tag; tags run on within a task
        n = int(np.asarray(pc.binary_length(batch.column("text")).fill_null(0)).sum())
        if held and (size + n > BLOCK_BYTES or int(tags[-1]) - int(held[0][0][0]) > 0xFFFF):
            yield out()
            held, size, rows = [], 0, 0
        for a in range(0, len(texts), 0x8000):
            if held and rows + len(texts[a : a + 0x8000]) > 0x8000:
                yield out()
                held, size, rows = [], 0, 0
            held.append((tags[a : a + 0x8000], texts[a : a + 0x8000]))
            rows += len(texts[a : a + 0x8000])
        size += n
    if held:
        yield out()


def _piece_sums(path: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums by row tag, packed by block: each distinct pre-token's piece count times its frequency in each document."""
    from . import token_counts as here

    counter_, seen = here.counter(path), {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        pieces = batch.column("piece").to_pylist()
        fresh = list({p for p in pieces if p is not None and p not in seen})
        if len(seen) + len(fresh) > REMEMBERED:
            seen, fresh = {}, list({p for p in pieces if p is not None})
        seen.update(zip(fresh, counter_.counts(fresh).tolist(), strict=True))
        base, posts = np.asarray(batch.column("base")), batch.column("postings").to_pylist()
        ends = [k for k, p in enumerate(pieces) if p is None]
        whole = [np.frombuffer(posts[k], SUM) for k in ends]
        rows = [k for k, p in enumerate(pieces) if p is not None]
        post = np.frombuffer(b"".join(posts[k] for k in rows), POSTING)
        times = np.fromiter((len(posts[k]) // POSTING.itemsize for k in rows), np.int64, len(rows))
        n = np.repeat(np.fromiter((seen[pieces[k]] for k in rows), np.int64, len(rows)), times) * post["times"]
        first = np.concatenate([np.repeat(base[rows], times), *[np.full(len(w), base[k]) for w, k in zip(whole, ends, strict=True)]])
        held.append((first, np.concatenate([np.repeat(base[rows], times) + post["doc"], *[w["tag"] for w in whole]]), np.concatenate([n, *[w["n"] for w in whole]])))
        size += len(first)
        if size > SUMS:
            held = [summed(held)]
            size = len(held[0][0])
            if 2 * size > SUMS:
                yield packed(*held[0])
                held, size = [], 0
    if held:
        yield packed(*summed(held))


def summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, tag and sum of each tag, in order."""
    first, tag, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
    tags, at, inverse = np.unique(tag, return_index=True, return_inverse=True)
    return first[at], tags, np.bincount(inverse, n, len(tags)).astype(np.int64)


def packed(first: np.ndarray, tags: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row for each block: its sums by tag. The tags of a block lie together."""
    sums = np.zeros(len(tags), PART)
    sums["doc"], sums["n"] = tags - first, n
    new = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    return pa.RecordBatch.from_arrays([pa.array(first[new]), binaries(np.frombuffer(sums.tobytes(), np.uint8), np.append(new, len(tags)) * PART.itemsize)], ["base", "sums"])


def _totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each tag, out of the sums of its block, which come one after the other."""
    block, total, there = None, np.zeros(1 << 16, np.int64), np.zeros(1 << 16, bool)

    def out() -> pa.RecordBatch:
        docs = np.flatnonzero(there)
        return pa.RecordBatch.from_arrays([pa.array(block + docs), pa.array(total[docs])], [TAG, "n_tokens"])

    for batch in batches:
        for base, sums in zip(batch.column("base").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            if base != block:
                if block is not None:
                    yield out()
                block, total[:], there[:] = base, 0, False
            part = np.frombuffer(sums, PART)  # a document once
            total[part["doc"]] += part["n"]
            there[part["doc"]] = True
    if block is not None:
        yield out()


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``.

    Tokens are those of the tokenizer file without added begin or end tokens, truncation or padding; special strings
    inside a text are single tokens, as the library has it by default. Null and empty texts have 0 bytes and tokens.
    Repeated rows and repeated or null ids each keep a row of their own; other columns are not looked at.
    An empty table gives an empty result.
    """
    rows = tagged(settled(docs), id_col, text_col)
    path = tokenizer_path
    posts = rows.select(TAG, "text").mapInArrow(lambda it: _postings(path, it), "piece string, base long, postings binary")
    # a pre-token that many documents of a block have is counted in up to SALTS places, each with some of its blocks
    spread = F.when(F.col("piece").isNull(), F.col("base")).when(F.octet_length("postings") > LONG_POSTINGS, F.pmod(F.xxhash64("base"), F.lit(SALTS))).otherwise(0)
    dealt = posts.repartition(F.xxhash64("piece"), spread)
    partial = dealt.mapInArrow(lambda it: _piece_sums(path, it), "base long, sums binary")
    sums = partial.repartition("base").sortWithinPartitions("base").mapInArrow(_totals, f"{TAG} long, n_tokens long")
    sizes = rows.select(TAG, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    joined = sizes.join(sums, TAG, "left")
    n = F.coalesce("n_tokens", F.lit(0)).cast("long")
    return joined.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
