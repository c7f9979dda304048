"""Listings by filter, zipped archives by member, places of calls, sunspot months."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from skywindow.sources import archives, indices
from skywindow.sources.listing import ArchiveObjects, ArchiveReader, Wanted, ZippedCsv, ZipReader

NAME = "01J00000000000000000000000.ndjson.gz"


@pytest.fixture
def store(tmp_path):
    for day in ("2024-07-01", "2024-07-02", "2024-07-09", "not-a-day"):
        for hour in ("00", "13", "24"):
            folder = tmp_path / "raw" / day / hour
            folder.mkdir(parents=True)
            (folder / NAME).write_bytes(b"x" * 7)
            (folder / "other.gz").write_bytes(b"")
    return str(tmp_path)


def test_filters_go_into_the_listing(spark, store):
    spark.dataSource.register(ArchiveObjects)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    every = spark.read.format("archive_objects").load(store)
    assert sorted({(str(r.day), r.hour, r["size"]) for r in every.collect()}) == [(d, h, 7) for d in ("2024-07-01", "2024-07-02", "2024-07-09") for h in (0, 13)]
    some = every.where("day >= date'2024-07-02' and day < date'2024-07-09' and hour = 13 and size > 0")
    assert [(str(r.day), r.hour) for r in some.collect()] == [("2024-07-02", 13)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    kept = next(line for line in plan.splitlines() if " Filter " in line)
    assert "size" in kept and "day" not in kept and "hour" not in kept
    assert [r.path for r in every.where(F.col("day").isin(dt.date(2024, 7, 1))).where("hour in (0, 5)").collect()] == [f"{store}/raw/2024-07-01/00/{NAME}"]


def test_only_asked_days_are_listed(store):
    from pyspark.sql.datasource import EqualNullSafe, EqualTo, GreaterThan, In, LessThanOrEqual

    r = ArchiveReader(store)
    left = list(r.pushFilters([GreaterThan(("day",), dt.date(2024, 7, 1)), LessThanOrEqual(("day",), dt.date(2024, 7, 4)), EqualTo(("size",), 3), In(("hour",), (3, 13)), EqualNullSafe(("hour",), 3)]))
    assert [type(f) for f in left] == [EqualTo, EqualNullSafe]
    days = [d for p in r.partitions() for d in p.days]
    assert days == [dt.date(2024, 7, k) for k in (2, 3, 4)] and r.wanted.hours == {3, 13}
    assert [x[0] for p in r.partitions() for x in r.read(p)] == [dt.date(2024, 7, 2)]
    w = Wanted()
    assert w.take(EqualTo(("day",), dt.date(2024, 7, 1))) and w.take(In(("day",), (dt.date(2024, 7, 2),))) and w.days == set()


def test_zipped_members(spark, tmp_path):
    for n in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("readme.txt", "no rows")
            z.writestr(f"{n}.csv", "x,y\n" + "\n".join(f"{n}{k},{k}" for k in range(45_000 if n == "a" else 3)))
            z.writestr("second.CSV", "y\n7\n")
    spark.dataSource.register(ZippedCsv)
    read = spark.read.format("zipped_csv").schema("y string, x string, z string")
    got = read.load(f"{tmp_path}/*.zip")
    assert got.rdd.getNumPartitions() == 2 and got.count() == 45_003 and got.where("z is not null").count() == 0
    assert got.where("x = 'a44999'").first().y == "44999"
    assert read.option("members", "all").load(f"file://{tmp_path}/b.zip").where("x is null").first().y == "7"
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("readme.txt", "")
    with pytest.raises(ValueError, match="no .csv member"):
        ZipReader(got.schema, f"{tmp_path}/none.zip", "first").partitions()
    with pytest.raises(FileNotFoundError):
        ZipReader(got.schema, f"{tmp_path}/*.tar", "first").partitions()


def test_members_are_streamed(tmp_path, monkeypatch):
    """What is read ahead of the rows that were taken is a small part of the member."""
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("big.csv", "w") as f:
        f.write(b"x\n")
        for k in range(300):
            f.write(b"%064d\n" % k * 2000)
    read = 0
    real = zipfile.ZipExtFile.read1

    def counted(self, n=-1):
        nonlocal read
        out = real(self, n)
        read += len(out)
        return out

    monkeypatch.setattr(zipfile.ZipExtFile, "read1", counted)
    from pyspark.sql.types import StructType

    r = ZipReader(StructType().add("x", "string"), f"{tmp_path}/big.zip", "first")
    batch = next(r.read(r.partitions()[0]))
    assert batch.num_rows == 20_000 and read < 3_000_000  # of 39 MB


def test_places_of_calls(spark):
    table = [("K", 1.0, 1.0), ("KG4", 2.0, 2.0), ("KG4ABCDEF", 3.0, 3.0), ("=KG4AB", 4.0, 4.0), ("3D2/R", 5.0, 5.0), ("3D2", 6.0, 6.0), ("=K", 7.0, 7.0)]
    prefixes = spark.createDataFrame(table, "prefix string, lat double, lon double")
    calls = spark.createDataFrame([(c,) for c in ("K1AA", "KG4A", "KG4ABCDEFG", "KG4AB", "KG4ABC", "3D2/RX", "3D2AA", "ZZ9", "K", "", None)], "call string")
    got = {r.call: r.lat for r in archives.place_calls(calls, prefixes, "call", "lat", "lon").collect()}
    assert got == {"K1AA": 1, "KG4A": 2, "KG4ABCDEFG": 3, "KG4AB": 4, "KG4ABC": 2, "3D2/RX": 5, "3D2AA": 6, "ZZ9": None, "K": 7, "": None, None: None}


def test_a_missing_sunspot_month_is_an_error(spark, tmp_path):
    (tmp_path / "s").write_text('[{"time-tag": "2031-02", "ssn": 91.5, "smoothed_ssn": 88.0}, {"time-tag": "2031-03", "ssn": 77.25, "smoothed_ssn": null}]')
    read = lambda months: {r.month: r.ssn for r in indices.read_ssn(spark, str(tmp_path / "s"), months).collect()}
    assert read(["2031-03"]) == {"2031-03": 77.25} and read(None) == {"2031-02": 88.0, "2031-03": 77.25}
    with pytest.raises(Exception, match="no sunspot number for 2031-04"):
        read(["2031-02", "2031-04"])
