"""Cases of the fourth round: stretches that repeat, the mix in its order, one sum a document."""

import random

import numpy as np
import pyarrow as pa
import pytest

from skywindow.llm import mixing, substring_dedup, token_counts
from skywindow.llm.queries import tokenizer_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in enumerate(texts)], DOC)


def some(rng, tag, n):
    return [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]


@pytest.mark.parametrize("period", [1, 12, 30])
def test_stretches_that_repeat_are_one_passage(spark, period):
    rng = random.Random(period)
    unit = some(rng, "u", period)
    stretch = " ".join((unit * 300)[:300])
    texts = [" ".join([*some(rng, f"a{k}x", 40), stretch, *some(rng, f"b{k}x", 40)]) for k in range(2)]
    # the other's stretch is only just long enough
    texts.append(" ".join([*some(rng, "c", 40), *(unit * 70)[:70], *some(rng, "d", 40)]))
    got = {}
    for r in substring_dedup.repeated_passages(docs(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.passage_id))
    for k in (0, 1):
        (one,) = got[k]
        # a window that matches may hold some of what stands beside the stretch; large keys may leave off 26 words (README)
        a, words = texts[k].index(stretch), stretch.split()
        inner = texts[k].index(" ".join(words[26:-26]), a)
        assert one[0] <= inner and one[1] >= a + len(" ".join(words[:-26])) and len(texts[k][one[0] : one[1]].split()) <= 300 + 18
    assert len(got[2]) == 1 and len({p for v in got.values() for _, _, p in v}) == 1


def test_runs_stand_for_all_their_places():
    """What is found at the first places of runs, as far as the runs go, is what is found at all places."""
    rng = random.Random(7)
    for k in range(30):
        period = rng.choice((1, 3, 7, 20, 44))
        unit = some(rng, "u", period)
        texts = []
        for side in "ab":
            words = (unit * 400)[: rng.randint(60, 400)]
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join([*some(rng, side, rng.randint(0, 30)), *words, *some(rng, side, rng.randint(0, 30))]))
        sh, first = substring_dedup.Words(pa.array(texts)).shingles(5)
        d, key, c, _, _ = substring_dedup.places(sh, first)
        kept, more = substring_dedup.runs(sh, first, d, key, c)
        sides = [((sh[a:b] >> np.uint64(48)).astype(np.uint16), np.array([0, b - a])) for a, b in zip(first, first[1:], strict=False)]

        def covered(at, more, d=d, key=key, c=c, sides=sides):
            x, y = (at[d[at] == s] for s in (0, 1))
            i, j = np.nonzero(key[x][:, None] == key[y][None, :])
            m = substring_dedup.matches(*sides, np.zeros(len(i), np.int64), c[x[i]], c[y[j]]) if len(i) else np.zeros((0, 5), int)
            ok = m[:, 0] == 1
            rows = np.stack([m[:, 1], m[:, 2] + more[x[i]], m[:, 3], m[:, 4] + more[y[j]]], axis=1)[ok]
            return [{p for r in rows for p in range(r[2 * s], r[2 * s + 1])} for s in (0, 1)]

        full = np.zeros(len(d), np.int64)
        few = np.zeros(len(d), np.int64)
        few[kept] = more
        assert covered(kept, few) == covered(np.arange(len(d)), full)


def test_what_the_mix_takes_is_summed_over_its_copies_in_order(spark):
    texts = [" ".join(["w"] * (k % 7)) for k in range(60)] + [None]
    table = spark.createDataFrame([(k, t, "en", ("a", "b", None)[k % 3], 1) for k, t in enumerate(texts)], DOC)
    out = mixing.mix(table)
    assert "rangepartitioning(position" in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert len(rows) == len(texts) and all(list(r.positions) == sorted(r.positions) and (r.taken == 0) == (not r.positions) for r in rows)
    assert sum(len(r.positions) for r in rows) == mixing.mixed_order(table).count()


def test_sums_leave_a_task_once_a_block(spark, monkeypatch):
    """However often a document's pre-tokens pass by, its block's sums go out together."""
    texts = [" ".join(f"q{k}z{j}w" for j in range(300)) for k in range(40)]
    tags = pa.array(range(40), pa.int64())
    path = tokenizer_path()
    posts = pa.Table.from_batches(token_counts._postings(path, [pa.RecordBatch.from_arrays([tags, pa.array(texts)], [token_counts.TAG, "text"])]))
    want = [len(token_counts.counter(path).tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    for most in (token_counts.SUMS, 1000, 10):
        monkeypatch.setattr(token_counts, "SUMS", most)
        parts = list(token_counts._piece_sums(path, posts.to_batches(max_chunksize=100)))
        if most == token_counts.SUMS > 1000:
            assert sum(p.num_rows for p in parts) == 1
        total = pa.Table.from_batches(token_counts._totals(parts)).to_pydict()
        assert total[token_counts.TAG] == list(range(40)) and total["n_tokens"] == want
