"""The hour store: versions, crashes, late spots, compaction."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skywindow.streaming.hourstore import HourlyStore

T0 = dt.datetime(2024, 5, 1)


def batch(spark, *spots):
    """(hour, minute, sender, signal) as spots."""
    rows = [(T0 + dt.timedelta(hours=h, minutes=m), "20m", "FT8", dx, "W2DE", "GF05", "JO22", snr, None) for h, m, dx, snr in spots]
    return spark.createDataFrame(rows, "ts timestamp, band string, mode string, dx_call string, de_call string, dx_grid string, de_grid string, snr_db int, parse_error string").withColumn("source", F.lit("pskreporter"))


def seen(df):
    return sorted((r.ts.hour, r.dx_call, r.snr_db) for r in df.collect())


def test_versions_and_late_spots(spark, tmp_path):
    store = HourlyStore(spark, str(tmp_path / "s"))
    assert store.versions() == [] and store.read().count() == 0
    assert store.upsert(batch(spark, (3, 1, "K1AA", -9), (4, 1, "K1AA", -5), (4, 2, "K1AA", -7), (4, 1, "bad", 0)), 0, "w") == {"qualifying": 3, "invalid_callsign": 1}
    assert seen(store.read()) == [(3, "K1AA", -9), (4, "K1AA", -5)]
    store.upsert(batch(spark, (3, 5, "K1AA", 2), (3, 20, "K1AA", -20)), 1, "w")  # a late, stronger spot, and one of another window
    assert seen(store.read()) == [(3, "K1AA", -20), (3, "K1AA", 2), (4, "K1AA", -5)]
    assert seen(store.read(1)) == [(3, "K1AA", -9), (4, "K1AA", -5)] and store.versions() == [1, 2]
    assert seen(store.read(hours=["2024-05-01-04"])) == [(4, "K1AA", -5)] and store.read(hours=["2024-05-01-09"]).count() == 0
    assert store.upsert(batch(spark, (3, 1, "K9ZZ", 0)), 1, "w") == {} and store.versions() == [1, 2]  # a batch is applied once
    assert store.upsert(batch(spark, (3, 1, "K9ZZ", 0)), 0, "other")  # by each writer
    with pytest.raises(ValueError):
        store.read(9)


def test_a_writer_that_dies_leaves_the_last_version(spark, tmp_path):
    store = HourlyStore(spark, str(tmp_path / "s"))
    store.upsert(batch(spark, (3, 1, "K1AA", -9)), 0, "w")
    before = seen(store.read())
    # in the middle of its files: the first rows are on disk, another one fails the job
    many = batch(spark, *[(h, m, f"K{m % 10}B{'ABCDEFGH'[h % 8]}", -m) for h in range(8) for m in range(0, 60, 5)]).repartition(8, "ts")
    deadly = many.withColumn("mode", F.when((F.hour("ts") == 7) & (F.minute("ts") == 55), F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("mode")))
    with pytest.raises(Exception, match="killed"):
        store.upsert(deadly, 1, "w")
    # with all files written, before the version appears
    store._commit, commit = lambda change: (_ for _ in ()).throw(KeyboardInterrupt()), store._commit
    with pytest.raises(KeyboardInterrupt):
        store.upsert(many, 1, "w")
    # with half a manifest
    (tmp_path / "s" / "_manifest" / ".half").write_text('{"version": 2, "segm')
    store._commit = commit
    again = HourlyStore(spark, str(tmp_path / "s"))
    assert seen(again.read()) == before and again.versions() == [1]
    again.upsert(many, 1, "w")
    assert len(seen(again.read())) > len(before)
    left = len(list((tmp_path / "s" / "data").iterdir()))
    assert again.vacuum(keep=1, older_than_s=-10) == left - 2  # what nobody names goes
    assert len(seen(again.read())) > len(before) and again.versions() == [2]


def test_two_writers_and_a_compaction_at_once(spark, tmp_path):
    a, b = (HourlyStore(spark, str(tmp_path / "s"), compact_at=3) for _ in range(2))
    a.upsert(batch(spark, (3, 1, "K1AA", 1)), 0, "a")
    write = a._write

    def slow(spots):
        out = write(spots)
        b.upsert(batch(spark, (3, 2, "K1BB", 2), (5, 0, "K1BB", 2)), 0, "b")  # gets there first
        a._write = write
        return out

    a._write = slow
    a.upsert(batch(spark, (3, 1, "K1CC", 3)), 1, "a")  # three segments: compacted
    assert seen(a.read()) == [(3, "K1AA", 1), (3, "K1BB", 2), (3, "K1CC", 3), (5, "K1BB", 2)]
    live = a.manifest()["segments"]
    assert sorted(map(sorted, live.values())) == [["2024-05-01-03"], ["2024-05-01-05"]]
    plan = a.read()._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # hours of one segment are read as they are
    assert a.compact(1) == 2 and seen(a.read())[0] == (3, "K1AA", 1)
