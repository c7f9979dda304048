"""Passages: what leaves a task, and the matching of pieces of texts."""

import numpy as np
import pyarrow as pa

from skywindow.llm import substring_dedup
from skywindow.llm.phrases import bit_map


def test_finer_keys_that_no_open_place_has_stay_in_the_task(spark):
    sh = pa.array([np.arange(300, dtype=np.uint16).tobytes()], pa.binary())
    at = {n: pa.array(v) for n, v in (("key", [5] * 9), ("c", range(20, 200, 20)), ("lo", range(20, 200, 20)), ("hi", range(20, 200, 20)), ("open", [False] * 9), ("more", [0] * 9))}
    places = pa.ListArray.from_arrays(pa.array([0, 9], pa.int32()), pa.StructArray.from_arrays(list(at.values()), list(at)))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), sh, places], ["t", "sh", "at"])
    for finer in (substring_dedup._seeds, substring_dedup._longer):
        all_ = pa.Table.from_batches(finer([batch]))
        wanted = all_["key"].to_pylist()[::7]
        bits = spark.sparkContext.broadcast(bit_map(spark.createDataFrame([(k,) for k in wanted], "key long"), substring_dedup.KEY_BITS))
        kept = pa.Table.from_batches(substring_dedup._asked_only(finer, bits)([batch]), all_.schema)
        assert set(wanted) <= set(kept["key"].to_pylist()) and len(kept) < len(all_) / 2
        assert not list(substring_dedup._asked_only(finer, spark.sparkContext.broadcast(bit_map(spark.createDataFrame([], "key long"), 32)))([batch]))


def test_a_piece_around_the_hits_matches_as_the_whole_text_does():
    rng = np.random.default_rng(3)
    left = rng.integers(0, 1 << 16, 400).astype(np.uint16)
    right = left.copy()
    right[[30, 31, 32, 33, 34]] = 7  # one changed word
    right = np.concatenate([np.delete(right, np.arange(150, 155)), rng.integers(0, 1 << 16, 60).astype(np.uint16)])
    right[300:] = np.where(rng.random(len(right) - 300) < 0.5, 9, right[300:])
    c = np.arange(len(left))
    cb = np.where(c < 150, c, c - 5)
    zero, whole, other = np.zeros(len(c), np.int64), (left, np.array([0, len(left)])), (right, np.array([0, len(right)]))
    full = substring_dedup.matches(whole, other, zero, c, cb)
    assert 0 < full[:, 0].sum() < len(c)
    run = substring_dedup.RUN
    for k in c.tolist():
        cut = max(k - run + 1, 0)
        piece = left[cut : k + run]
        hits = pa.StructArray.from_arrays([pa.array([1]), *(pa.array([x], pa.int32()) for x in (k, cb[k], 0, 0))], ["key", "c", "c_b", "more", "more_b"])
        row = pa.RecordBatch.from_arrays(
            [pa.array([0]), pa.array([1]), pa.ListArray.from_arrays(pa.array([0, 1], pa.int32()), hits), pa.array([cut], pa.int32()), pa.array([piece.tobytes()]), pa.array([right.tobytes()])],
            ["a", "b", "hits", "cut", "sh_a", "sh_b"],
        )
        got = [[r[n] for n in ("from", "to", "from_b", "to_b")] for b in substring_dedup._align([row]) for r in b.to_pylist()]
        assert got == ([full[k, 1:].tolist()] if full[k, 0] else [])
