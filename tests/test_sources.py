"""Readers on small files, the accumulator, and the lake."""

import datetime as dt
import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from skywindow.plans.backfill import backfill
from skywindow.sources import archives, indices
from skywindow.sources.lake import register_view, write_table
from skywindow.streaming.accumulator import HourlyStore, MqttReader, accumulate, parse_reports, topic

# epoch, receiver, grid, signal, MHz, sender, grid, power, drift, km, azimuth, band code, version, code
WSPR = """9001,1719830460,OK9ZZZ,JN79,-7,14.095620,PY0TST,HI36uv,30,0,8800,48,14,2.1,0
9002,1719830460,LU8QQ,GF05ab,-18,10.138702,ZS4XY,KG33cd,23,1,7900,101,10,2.1,0
9003,1719830460,OK9ZZZ,JN79,-3,14.095620,A?B,HI36uv,30,0,8800,48,14,2.1,0
9004,cut off
"""


def test_wsprnet(spark, tmp_path):
    path = str(tmp_path / "w.csv.gz")
    with gzip.open(path, "wt") as f:
        f.write(WSPR)
    spots, reasons = archives.extract(archives.read_wsprnet(spark, path))
    got = {r.band: r for r in spots.collect()}
    assert set(got) == {"20m", "30m"} and got["20m"].freq_hz == 14095620 and got["20m"].dx_grid == "HI36UV"
    assert {r.reason: r.n for r in reasons.collect()} == {"qualifying": 2, "invalid_callsign": 1, "unparsed": 1}
    out = str(tmp_path / "spots")
    assert archives.write_extracted(archives.read_wsprnet(spark, path), out) == {"qualifying": 2, "invalid_callsign": 1, "unparsed": 1}
    assert spark.read.parquet(out).count() == 2
    one, _ = archives.extract(archives.read_wsprnet(spark, path, ["20m"]))
    assert [r.dx_call for r in one.collect()] == ["PY0TST"]


RBN = """callsign,de_pfx,de_cont,freq,band,dx,dx_pfx,dx_cont,mode,db,date,speed,tx_mode
SM7ABC-5,SM,EU,14025.9,20m,JH4XYZ,JA,AS,CQ,17,2024-07-01 10:41:05,24,CW
TF3DX,TF,EU,7012.2,40m,JH4XYZ,JA,AS,CQ,9,2024-07-01 10:41:07,24,CW
ONLY,TWO
"""


@pytest.mark.parametrize("zipped", [True, False])
def test_rbn(spark, tmp_path, zipped):
    path = str(tmp_path / ("r.zip" if zipped else "r.csv"))
    if zipped:
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("20240701.csv", RBN)
    else:
        open(path, "w").write(RBN)
    prefixes = spark.createDataFrame([("S", 10.0, 10.0), ("SM", 58.0, 15.0), ("JH", 36.0, 139.0)], "prefix string, lat double, lon double")
    rows = archives.read_rbn(spark, path, prefixes, ["20m"]).where("parse_error is null").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.de_call, r.freq_hz, r.snr_db, r.de_lat, r.dx_grid) == ("SM7ABC", 14025900, 17, 58.0, "PM96")


def test_archive(spark, tmp_path):
    base = {"timestamp": 1722518700, "frequency": 14074000, "band": "20M", "mode": "ft8", "dxCall": "zl9tst", "deCall": "ok9zzz", "dxGrid": "rf70ab", "deGrid": None, "deLat": 49.25, "deLon": 15.5, "snr": -3, "source": "pskreporter"}
    lines = [json.dumps(base), json.dumps(base | {"source": "user"}), json.dumps(base | {"timestamp": "x"}), json.dumps(base | {"dxGrid": "RR73"}), "{broken"]
    path = str(tmp_path / "a.json.gz")
    with gzip.open(path, "wt") as f:
        f.write("\n".join(lines))
    rows = archives.read_archive(spark, path)
    assert sorted(str(r.parse_error) for r in rows.collect()) == ["None", "invalid_timestamp", "malformed_json", "non_automatic_source", "rr73_grid"]
    r = rows.where("parse_error is null").first()
    assert (r.dx_grid, r.dx_lat, r.de_grid, r.band, r.mode) == ("RF70", -39.5, "JN79", "20m", "FT8")


def test_days(spark):
    assert archives.requested_days(spark, "2024-05-01", "2024-05-03").count() == 2
    assert archives.requested_days(spark, "2024-05-01", "2024-05-01").count() == 0


def test_load_month_rejects_other_sources(spark, tmp_path):
    row = ("rbn", dt.datetime(2024, 5, 3), "20m", "CW", "A1A", "B2B")
    df = spark.createDataFrame([row, (row[0], dt.datetime(2024, 6, 1), *row[2:])], "source string, ts timestamp, band string, mode string, dx_call string, de_call string")
    df.write.parquet(str(tmp_path / "m"))
    assert archives.load_month(spark, str(tmp_path / "m"), "2024-05", "rbn").count() == 1
    for columns in (["band"], ["source"], []):  # whatever is read of the rows
        with pytest.raises(Exception, match="not of pskreporter"):
            archives.load_month(spark, str(tmp_path / "m"), "2024-05", "pskreporter").select(*columns).count()
    with pytest.raises(ValueError, match="no file of 2024-05"):
        archives.load_month(spark, str(tmp_path / "m"), "2024-05", "rbn", by_file_name=True)
    df.write.parquet(str(tmp_path / "n" / "hour=2024-05-03-00"))
    assert archives.load_month(spark, str(tmp_path / "n"), "2024-05", "rbn", by_file_name=True).count() == 1
    with pytest.raises(ValueError, match="lacks"):
        df.drop("mode").write.parquet(str(tmp_path / "k"))
        archives.load_month(spark, str(tmp_path / "k"), "2024-05", "rbn")


def test_month_of_archives_skips_missing_days(spark, tmp_path):
    for day in ("20240701", "20240705", "20240801"):
        with zipfile.ZipFile(tmp_path / f"{day}.zip", "w") as z:
            z.writestr(f"{day}.csv", RBN)
    prefixes = spark.createDataFrame([("SM", 58.0, 15.0)], "prefix string, lat double, lon double")
    assert archives.read_rbn_month(spark, str(tmp_path), "2024-07", prefixes, ["40m"]).where("parse_error is null").count() == 2


def archive_line(**over):
    base = {"timestamp": 1719830460, "frequency": 14074000, "band": "20m", "mode": "FT8", "dxCall": "JH4XYZ", "deCall": "SM7ABC", "dxGrid": "PM96", "deGrid": "JO78", "snr": -4, "source": "pskreporter"}
    return json.dumps(base | over)


def test_backfill(spark, tmp_path):
    def put(day, hour, name, lines, end=None):
        folder = tmp_path / "store" / "raw" / day / hour
        folder.mkdir(parents=True, exist_ok=True)
        content = gzip.compress("\n".join(lines).encode())
        (folder / name).write_bytes(content[:end])

    ulid = "01J00000000000000000000000.ndjson.gz"
    put("2024-07-01", "10", ulid, [archive_line(), archive_line(snr=3), archive_line(source="user"), "{"])
    put("2024-07-01", "10", "readme.txt", ["no object"])
    put("2024-07-02", "99", ulid, [archive_line()])
    put("2024-07-03", "00", ulid, [archive_line(), archive_line(dxCall="JH4XYA")])
    put("2024-07-09", "00", ulid, [archive_line()], end=-12)
    root, out = str(tmp_path / "store"), str(tmp_path / "out" / "spots")
    (tmp_path / "out").mkdir()
    day = dt.date(2024, 7, 1)
    assert backfill(spark, root, day, day, out)[0] == 2
    code, counts = backfill(spark, root, day, dt.date(2024, 7, 5), out)
    assert code == 0 and counts == {"days": {"2024-07-01": 1, "2024-07-03": 2}, "objects": 2, "rejected": {"non_automatic_source": 1, "malformed_json": 1}}
    got = spark.read.parquet(out)
    assert {(str(r.day), r.snr_db) for r in got.collect()} == {("2024-07-01", 3), ("2024-07-03", -4)}
    assert backfill(spark, root, day, dt.date(2024, 7, 5), out)[0] == 2  # it is there already
    other = str(tmp_path / "out" / "other")
    assert backfill(spark, root, dt.date(2024, 7, 9), dt.date(2024, 7, 10), other)[0] == 1  # cut off
    assert backfill(spark, root, dt.date(2024, 7, 2), dt.date(2024, 7, 3), other)[0] == 1  # nothing to read
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")) == ["spots"]


def test_indices(spark, tmp_path):
    words = ["0"] * 55
    words[0], words[1], words[2], words[16], words[24], words[38], words[40], words[50] = "2014", "2", "5", "999.9", "399.", "57", "-12", "124.0"
    (tmp_path / "o").write_text(" ".join(words) + "\n")
    r = indices.read_omni2(spark, str(tmp_path / "o")).first()
    assert r.time == dt.datetime(2014, 1, 2, 5) and r.bz_gsm is None and r.kp == pytest.approx(5 + 2 / 3) and r.dst == -12 and r.f107 == 124
    (tmp_path / "k").write_text("# head\n2031 02 03 12.0 13.5 36192.5 36192.6 6.667 111 1\n2031 02 03 15.0 16.5 36192.6 36192.7 2.0 7 0\n")
    k = indices.read_definitive_kp(spark, str(tmp_path / "k")).collect()
    assert len(k) == 1 and k[0].kp == 6.667 and k[0].block_start == dt.datetime(2031, 2, 3, 12)
    (tmp_path / "bad").write_text("2031 02 03\n")
    with pytest.raises(Exception, match="malformed line"):
        indices.read_definitive_kp(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "s").write_text('[{"time-tag": "2031-02", "ssn": 91.5, "smoothed_ssn": 88.0},\n {"time-tag": "2031-03", "ssn": 77.25, "smoothed_ssn": -1.0}]')
    assert {r.month: r.ssn for r in indices.read_ssn(spark, str(tmp_path / "s")).collect()} == {"2031-02": 88.0, "2031-03": 77.25}


def test_lake(spark, tmp_path):
    df = spark.createDataFrame([("20m", dt.date(2024, 5, 1), 1), ("40m", dt.date(2024, 5, 2), 2)], "band string, date date, n int")
    for _ in range(2):
        write_table(df, str(tmp_path), "t", ["band", "date"])
    got = register_view(spark, str(tmp_path), "t")
    assert got.count() == 4 and dict(got.dtypes)["date"] == "date"
    assert spark.sql("select sum(n) from t where band = '20m'").first()[0] == 2


def payload(**over):
    base = {"f": 14074000, "md": "FT8", "rp": -3, "t": 1722519300, "t_tx": 1722519280, "sc": "PY0TST", "sl": "HI36", "rc": "OK9ZZZ", "rl": "JN79", "b": "20m"}
    return json.dumps({k: v for k, v in (base | over).items() if v is not None})


def test_parse_reports(spark):
    rows = parse_reports(spark.createDataFrame([(payload(),), (payload(t_tx=None),), (payload(rp=None),), ("[1]",), ("nonsense",), (payload(sc=""),)], "value string")).collect()
    assert [r.parse_error for r in rows] == [None, None] + ["unparsed"] * 4
    assert [r.ts for r in rows[:2]] == [dt.datetime(2024, 8, 1, 13, 34, 40), dt.datetime(2024, 8, 1, 13, 35)]


def test_accumulate_merges_late_data(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cut"))
    src = tmp_path / "in"
    src.mkdir()
    store, seen = HourlyStore(spark, str(tmp_path / "store")), []
    batches = [[payload(rp=-9), payload(sc="K2AB", t_tx=1722522900)], [payload(rp=5), payload(rp=None)], [payload(rp=-20)]]
    for k, lines in enumerate(batches):
        (src / f"{k}.json").write_text("\n".join(lines))
        q = accumulate(spark.readStream.text(str(src)), store, str(tmp_path / "progress"), on_flush=lambda c, i: seen.append({r.reason: r.n for r in c.collect()}))
        q.awaitTermination()
    got = {(r.dx_call, r.snr_db) for r in store.read().collect()}
    assert got == {("PY0TST", 5), ("K2AB", -3)}
    assert seen[1] == {"qualifying": 1, "unparsed": 1}


def test_mqtt_reader():
    class Client:
        topics = []

        def connect(self, host, port):
            self.on_connect(self)

        def loop_start(self):
            self.on_message(self, None, type("M", (), {"payload": b"x"}))

        def subscribe(self, t):
            self.topics.append(t)

    r = MqttReader({"bands": "20m,15m"}, Client)
    rows, end = r.read(r.initialOffset())
    assert list(rows) == [("x",)] and end == {"n": 1} and Client.topics == [topic("20m"), topic("15m")]
    assert list(r.readBetweenOffsets({"n": 0}, end)) == [("x",)]
    r.commit(end)
    assert list(r.read(end)[0]) == []


def test_mqtt_reader_goes_on_after_a_restart():
    class Client:
        def connect(self, host, port):
            pass

        def loop_start(self):
            for k in range(8):
                self.on_message(self, None, type("M", (), {"payload": b"%d" % k}))

    r = MqttReader({"bands": "20m"}, Client)
    rows, end = r.read({"n": 5})  # the offset of the checkpoint; the messages before it are gone
    assert [x for (x,) in rows] == [str(k) for k in range(8)] and end == {"n": 13}
    r.commit({"n": 9})
    assert [x for (x,) in r.readBetweenOffsets({"n": 9}, end)] == ["4", "5", "6", "7"]
    r.commit(end)
    r._receive(None, None, type("M", (), {"payload": b"new"}))
    assert [x for (x,) in r.read(end)[0]] == ["new"]
    again = MqttReader({"bands": "20m"}, Client)  # a batch that was planned but not committed comes first
    assert list(again.readBetweenOffsets({"n": 3}, {"n": 5})) == [] and len(list(again.read({"n": 5})[0])) == 8
