"""Passages of keys with many surroundings: whole, with one id, and without pairs."""

import random

import numpy as np
import pyarrow as pa

from skywindow.llm import masked_windows, substring_dedup

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def some(tag, n):
    return [f"{tag}{j}" for j in range(n)]


def passages(spark, monkeypatch, texts, small):
    monkeypatch.setattr(substring_dedup, "SMALL", small)
    monkeypatch.setattr(substring_dedup, "LEADERS", 1)
    monkeypatch.setattr(substring_dedup, "GROWTH", 2)
    table = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in enumerate(texts)], DOC)
    return substring_dedup.repeated_passages(table).collect()


def groups(rows):
    by = {}
    for r in rows:
        by.setdefault(r.passage_id, set()).add((r.doc_id, r.start, r.end))
    return {frozenset(g) for g in by.values()}


def test_what_a_linked_place_matches_elsewhere_is_not_left_out(spark, monkeypatch):
    """A line in many surroundings: some texts share what goes before it, some what follows, and one of each group both."""
    rng, line, texts, of = random.Random(21), some("line", 30), [], []
    for k in range(12):
        before, behind = some(f"x{k}b", 30), some(f"y{k}b", 30)
        for j in range(3):
            texts.append([*some(f"q{k}a{j}b", 30), *before, *line, *some(f"r{k}a{j}b", 30)])
            texts.append([*some(f"s{k}a{j}b", 30), *line, *behind, *some(f"t{k}a{j}b", 30)])
            of += [k, k]
        texts.append([*before, *line, *behind])
        of.append(k)
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts, of = [texts[k] for k in order], [of[k] for k in order]
    whole = {k: " ".join(t) for k, t in enumerate(texts)}
    got = passages(spark, monkeypatch, list(whole.values()), 2)
    ids = {}
    for r in got:
        ids.setdefault(of[r.doc_id], set()).add(r.passage_id)
    assert {r.doc_id for r in got} == set(whole) and all(len(i) == 1 for i in ids.values()) and len(ids) == 12
    for r in got:
        if len(texts[r.doc_id]) == 90:
            assert (r.start, r.end) == (0, len(whole[r.doc_id]))


def test_passages_do_not_depend_on_the_size_of_keys(spark, monkeypatch):
    """Edits of all kinds, stretches of one word and repeated stretches: masked windows give what all pairs give."""
    rng, texts = random.Random(22), []
    for k in range(10):
        base = [*some(f"a{k}b", rng.randint(10, 60)), *["la"] * rng.randint(20, 60), *some(f"c{k}d", rng.randint(10, 60)), *some("line", 45)]
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(copy))
                rng.choice((lambda: copy.__setitem__(at, "new"), lambda: copy.insert(at, "put"), lambda: copy.pop(at), lambda: copy.insert(at, "put in")))()
            texts.append(" ".join([*some(f"e{len(texts)}f", rng.randint(0, 40)), *copy, *some(f"g{len(texts)}h", rng.randint(0, 40))]))
    texts += [texts[0], texts[4].upper(), " ".join(["la"] * 200)]
    masked, pairs = (groups(passages(spark, monkeypatch, texts, small)) for small in (1, 10**6))
    assert masked == pairs and sum(len(g) for g in masked) >= 40


class Known:
    def __init__(self, keys):
        self.keys = keys

    @property
    def value(self):
        return self

    def has(self, h):
        return np.isin(h, self.keys)


def zone(words):
    sh, _ = substring_dedup.Words(pa.array([" ".join(words)])).shingles(5)
    return (sh >> np.uint64(48)).astype(np.uint16)


def test_gaps_are_tried_only_where_something_else_stands():
    """A stretch of one word has no gap until another text has something else in it; then only windows with that gap have keys."""
    line = some("w", 60)
    changed = [*line[:30], "other", *line[31:]]

    def rows(*texts):
        sh = [zone(t) for t in texts]
        at = [[{"c": c, "cid": k, "multi": False} for c in range(0, len(s), 10)] for k, s in enumerate(sh)]
        n = len(texts)
        b = pa.RecordBatch.from_arrays(
            [pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), pa.array([s.tobytes() for s in sh]), pa.array(at, pa.list_(pa.struct([("c", pa.int32()), ("cid", pa.int64()), ("multi", pa.bool_())]))), pa.array([[]] * n, pa.list_(pa.int32()))],
            ["z", "t", "sh", "at", "skip"],
        )
        every = Known(np.concatenate([masked_windows.Zones(b.slice(k, 1)).pairs() for k in range(n)]))
        between = {}
        for g in masked_windows._gaps(every)([b]):
            for r in g.to_pylist():
                between.setdefault(r["key"], set()).add(r["inside"])
        open_ = Known(np.array([k for k, v in between.items() if len(v) > 1], np.int64).view(np.uint64))
        return pa.Table.from_batches(masked_windows._keys(every, open_)([b])).to_pylist()

    assert all(r["form"] == 0 for r in rows(["la"] * 60))
    got = rows(line, changed)
    keys = [{r["sig"] for r in got if r["t"] == t and r["form"] == 41} for t in (0, 1)]
    assert keys[0] & keys[1] and {r["gap"] for r in got if r["form"] == 41} <= {4, 5}
    assert sum(r["form"] == 41 and r["gap"] == 5 and r["t"] == 0 for r in got) <= 41
