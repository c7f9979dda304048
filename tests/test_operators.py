"""Hand-worked cases of the operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skywindow.operators import acceptance, metrics
from skywindow.operators.climatology import Climatology
from skywindow.operators.dedup import dedup_spots
from skywindow.operators.evidence import receiver_uptime
from skywindow.operators.features import HISTORY_COLUMNS, add_history, add_space_weather
from skywindow.operators.labels import universe
from skywindow.operators.p533 import KeyedScorer, card, closed_form, cross_check, parse_report, sample_keys, with_keys
from skywindow.operators.sampling import sample_labels
from skywindow.plans import holdout

T0 = dt.datetime(2024, 5, 1)
SPOTS = "source string, ts timestamp, band string, mode string, dx_call string, de_call string, dx_grid string, de_grid string, snr_db short, tx_dbm short"
CELLS = "window_start timestamp, tx_field string, rx_field string, band string, n_spots long, snr_ft8eq_p50 double, open byte"


def at(h, m=0):
    return T0 + dt.timedelta(hours=h, minutes=m)


def utc(spark, df):
    return sorted(r[0] for r in df.select(F.date_format("window_start", "HH:mm")).collect())


@pytest.mark.parametrize("minute", [0, 2])
def test_spot_lights_five_windows(spark, minute):
    s = spark.createDataFrame([("wsprnet", at(12, minute), "20m", "WSPR", "ZL9TST", "OK9ZZZ", "FN20", "DM14", -10, 20)], SPOTS)
    assert utc(spark, receiver_uptime(s)) == ["11:30", "11:45", "12:00", "12:15", "12:30"]


def test_modal_grid(spark):
    rows = [("w", at(12), "20m", "WSPR", f"K{i}A", "OK9ZZZ", "FN20", g, -10, 20) for i, g in enumerate(["DM14", "CM87"] + ["EN"] * 5)]
    got = receiver_uptime(spark.createDataFrame(rows, SPOTS)).select("de_grid4").distinct().collect()
    assert [r[0] for r in got] == ["CM87"]


def test_dedup_priority(spark):
    rows = [(s, at(12, m), "20m", "WSPR", "ZL9TST", "OK9ZZZ", "FN20", "DM14", snr, 20) for s, m, snr in (("rbn", 1, 5), ("wsprnet", 2, None), ("wsprnet", 3, -10), ("wsprnet", 16, 1))]
    got = {(r.source, r.snr_db) for r in dedup_spots(spark.createDataFrame(rows, SPOTS)).collect()}
    assert got == {("wsprnet", -10), ("wsprnet", 1)}


def test_repeated_station_counts_once(spark):
    rows = [("wsprnet", at(12), "20m", "WSPR", "ZL9TST", r, "FN20", "DM14", -10, 20) for r in ("OK9ZZZ", "W7AB")]
    row = universe(spark.createDataFrame(rows, SPOTS)).where("n_spots > 0").first()
    assert (row.n_spots, row.n_tx_stations, row.n_monitors, row.evidence_tier) == (2, 1, 2, "wspr")


def history(spark, rows, target, horizon=0):
    h = spark.createDataFrame([(w, *k, n, s, 1) for w, k, n, s in rows], CELLS)
    t = spark.createDataFrame([(target, "FN", "DM", "20m")], "window_start timestamp, tx_field string, rx_field string, band string")
    return add_history(h, t, horizon).first()


CELL = ("FN", "DM", "20m")


def test_history_buffer(spark):
    got = history(spark, [(at(1, m), CELL, 1, None) for m in (0, 15, 30, 45)], at(2))
    assert got.same_cell_n_1h == 3 and got.same_cell_n_15m == 0 and got.same_cell_snr_1h is None
    assert history(spark, [(at(1, 41), CELL, 1, None)], at(2)).same_cell_n_1h == 0
    assert history(spark, [(at(1, 40), CELL, 1, None)], at(2)).same_cell_n_1h == 1


def test_history_neighbours_pool(spark):
    got = history(spark, [(at(1, 30), ("FN", "CM", "20m"), 2, 10.0), (at(1, 30), ("FN", "EM", "20m"), 4, 20.0)], at(2))
    assert got.adjacent_cell_n_1h == 6 and got.adjacent_cell_snr_1h == pytest.approx(100 / 6)
    assert got.same_cell_n_24h == 0 and got.same_cell_snr_24h is None


def test_history_other_relations(spark):
    rows = [(at(1, 30), ("DM", "FN", "20m"), 3, 5.0), (at(1, 30), ("FN", "DM", "17m"), 7, 8.0)]
    got = history(spark, rows, at(2))
    assert (got.reverse_path_n_1h, got.adjacent_band_n_1h, got.band_wide_n_1h) == (3, 7, 3)
    shifted = history(spark, rows, at(2), horizon=6)
    assert shifted.reverse_path_n_24h == 0
    assert set(HISTORY_COLUMNS) <= set(got.asDict())


def test_same_hour_yesterday(spark):
    assert history(spark, [(at(2), CELL, 1, None)], at(26)).same_hour_yesterday_open == 1
    assert history(spark, [(at(2), CELL, 1, None)], at(32), horizon=6).same_hour_yesterday_open == 1


def test_space_weather_as_of(spark):
    omni = spark.createDataFrame([(at(h), float(h), 100.0 + h, 0.0, 400.0, -5.0) for h in range(49)], "time timestamp, kp double, f107 double, bz_gsm double, solar_wind_speed double, dst double")
    cells = spark.createDataFrame([(at(48),), (at(80),)], "window_start timestamp")
    got = {r.window_start: r for r in add_space_weather(cells, omni).collect()}
    assert got[at(48)].kp_now == 48 and got[at(48)].kp_lag6h == 42 and got[at(48)].f107_daily == 147
    assert got[at(80)].kp_now is None
    assert add_space_weather(cells.limit(1), omni, 6).first().kp_now == 42
    with pytest.raises(ValueError):
        add_space_weather(cells, omni, 0.1)


def test_sample_weights(spark):
    rows = [(at(12), "FN", f"{chr(65 + i % 18)}{chr(65 + i // 18)}", "20m", 1, None, int(i < 2)) for i in range(22)]
    got = sample_labels(spark.createDataFrame(rows, CELLS)).collect()
    neg = [r for r in got if r.open == 0]
    assert len(got) == 8 and len(neg) == 6 and neg[0].sample_weight == pytest.approx(20 / 6)
    few = sample_labels(spark.createDataFrame([(at(12), "FN", f"A{chr(65 + i)}", "20m", 1, None, int(i < 5)) for i in range(8)], CELLS)).collect()
    assert len(few) == 8 and all(r.sample_weight == 1 for r in few)


def test_climatology(spark):
    c = spark.createDataFrame([(at(12), "FN", "DM", "20m", 1, None, 1), (at(12, 15), "FN", "DM", "20m", 0, None, 0), (at(13), "FN", "EM", "20m", 0, None, 0)], CELLS)
    with pytest.raises(RuntimeError):
        Climatology().predict(c)
    got = {r.rx_field: r.p_open for r in Climatology().fit(c).predict(spark.createDataFrame([(at(36), "FN", "DM", "20m", 0, None, 0), (at(36), "FN", "XX", "20m", 0, None, 0)], CELLS)).collect()}
    assert got == {"DM": 0.5, "XX": pytest.approx(1 / 3)}


def test_gap_and_folds():
    assert acceptance.gap_hours(3, 24) == 48 and acceptance.gap_hours(48, 24) == 72
    f = acceptance.folds(T0, T0 + dt.timedelta(days=40), 10, 5, 48)
    assert f[0].eval_start - f[0].train_end == dt.timedelta(hours=48) and f[1].train_start == f[0].eval_start
    assert all(x.eval_end <= T0 + dt.timedelta(days=40) for x in f)
    # by days: 10 of training and 2 between, so folds begin 12 days apart, and each needs 17
    assert [(x.train_start - T0).days for x in f] == [0, 12]
    assert len(acceptance.folds(T0, T0 + dt.timedelta(days=41), 10, 5, 48)) == 3
    assert acceptance.folds(T0, T0 + dt.timedelta(days=16), 10, 5, 48) == []


def test_enforce_gap(spark):
    a, b = (spark.createDataFrame([(t,)], "window_start timestamp") for t in (at(0), at(47)))
    with pytest.raises(ValueError):
        acceptance.enforce_gap(a, b)


def test_acceptance_exits(spark):
    cohort = spark.createDataFrame([(at(h), "FN", "DM", "20m", 1, None, h % 2) for h in range(4)], CELLS)
    arm = lambda p: cohort.withColumn("p_open", p)
    good, flat = F.when(F.col("open") == 1, 0.9).otherwise(0.1), F.lit(0.5)
    assert acceptance.run_acceptance({"gbt": arm(good), "clim": arm(flat)}, "gbt", cohort)[0] == acceptance.PASS
    assert acceptance.run_acceptance({"gbt": arm(flat), "clim": arm(good)}, "gbt", cohort)[0] == acceptance.MISS
    code, report = acceptance.run_acceptance({"gbt": arm(F.lit(2.0)), "clim": arm(good)}, "gbt", cohort)
    assert code == acceptance.UNVERIFIED and report["defects"]["gbt"]["no_probability"] == 4
    assert acceptance.cohort_digest(cohort).first() == acceptance.cohort_digest(cohort.repartition(3)).first()


class Constant:
    """A model that says the same of every cell, or what the cell was, blurred."""

    def __init__(self, p=None):
        self.p = p

    def fit(self, df):
        return self

    def predict(self, df):
        return df.withColumn("p_open", F.lit(self.p) if self.p is not None else F.when(F.col("open") == 1, 0.9).otherwise(0.1))


def test_holdout_run(spark, tmp_path):
    def loader(source, dx="K1A"):
        def load(month):
            first = dt.datetime.fromisoformat(f"{month}-10")
            rows = [(source, first + dt.timedelta(minutes=15 * k), "20m", "FT8", dx, f"W{k % 3}B", "FN20", "DM14", 1, 20) for k in range(8)]
            rows += [(source, first, "20m", "CW", "K9ZZ", "W5XY", "EM10", "DM14", 1, 20), (source, first, "40m", "FT8", "K9ZZ", "W5XY", "EM10", "DM14", 1, 20), (source, first - dt.timedelta(days=40), "20m", "FT8", "K7A", "W5XY", "EM10", "DM14", 1, 20)]
            return spark.createDataFrame(rows, SPOTS)

        return load

    months = ["2024-03", "2024-04", "2024-05"]
    hourly = spark.createDataFrame([(dt.datetime(2024, 3, 10) + dt.timedelta(hours=h), 2.0, 150.0, 1.0, 400.0, -5.0) for h in range(6)], "time timestamp, kp double, f107 double, bz_gsm double, solar_wind_speed double, dst double")
    storm = spark.createDataFrame([(dt.datetime(2024, 4, 10), 6.0), (dt.datetime(2024, 4, 11), 9.0)], "block_start timestamp, kp double")
    public = {"rbn": loader("rbn"), "wsprnet": loader("wsprnet", "K2C")}
    models = {"gbt": Constant, "climatology": lambda: Constant(0.5)}
    code, report = holdout.holdout_run(public, ["2024-01"], months, "20m", hourly, storm, models, "gbt", loader("cqdx", "K3D"), str(tmp_path / "report"))
    assert code == 0 and report["storm"] == {"block_start": "2024-04-10T00:00:00", "kp": 6.0} and report["spots"]["private"] > 0 and set(report["arms"]) == {"gbt", "climatology", "augmented"}
    assert '"exit": 0' in "\n".join(r.value for r in spark.read.text(str(tmp_path / "report")).collect())
    assert holdout.holdout_run(public, ["2024-01"], months, "20m", hourly, storm, models, "climatology")[0] == 1
    none = {**public, "pskreporter": lambda m: spark.createDataFrame([], SPOTS)}
    code, report = holdout.holdout_run(none, ["2024-01"], months, "20m", hourly, storm, models, "gbt")
    assert code == 2 and "pskreporter" in report["reason"]
    for train, held in ((["2024-01"], months[:2]), (["2024-03"], months), (["2024-01"], [months[0], *months[:2]])):
        with pytest.raises(holdout.Unusable):
            holdout.holdout_run(public, train, held, "20m", hourly, storm, models, "gbt")
    with pytest.raises(holdout.Unusable, match="storm"):
        holdout.holdout_run(public, ["2024-01"], months, "20m", hourly, storm.where("kp < 5"), models, "gbt")


def test_headline_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.8), (0, 0.4)], "open int, p_open double")
    for model in ("a", "b"):
        acceptance.append_headline(rows, model, str(tmp_path / "table"))
    got = spark.read.option("header", True).csv(str(tmp_path / "table")).collect()
    assert sorted((r.model, r.brier, r.log_loss, r.n) for r in got) == [("a", "0.100000", "0.366985", "2"), ("b", "0.100000", "0.366985", "2")]


def test_cross_check(spark, tmp_path):
    ssn = spark.createDataFrame([("2024-05", 140.5)], "month string, ssn double")
    cells = spark.createDataFrame([(at(h), "FN", f, b, 1, None, 1) for h in range(4) for f in ("DM", "EM") for b in ("20m", "6m")], CELLS)
    keys = sample_keys(with_keys(cells, ssn), 10, 7)
    assert keys.collect() == sample_keys(with_keys(cells.repartition(3), ssn), 10, 7).collect() and keys.distinct().count() == 10
    done, failed = cross_check(KeyedScorer(closed_form, ssn), keys, str(tmp_path / "csv"))
    assert done + failed == 10 and failed == keys.where("band = '6m'").count()


def test_storm_tags(spark):
    blocks = spark.createDataFrame([(at(0), 5.0), (at(3), 2.0)], "block_start timestamp, kp double")
    cells = spark.createDataFrame([(at(h), "FN", "DM", "20m", 1, None, 1) for h in (2, 3, 9)], CELLS)
    assert [r.is_storm for r in metrics.tag_storms(cells, blocks).orderBy("window_start").collect()] == [True, False, False]


def test_report_and_card(spark):
    text = "Column 01: Month\nColumn 02: SNR - Median\nColumn 03: SNRXXp - at 99%\nColumn 04: BCR - Basic\n** Calculated Parameters **\n\n1, -3.5, -20, 87.25\n"
    assert parse_report(text) == (87.25, -3.5)
    with pytest.raises(ValueError):
        parse_report("Column 01: Month\n")
    c = [F.lit(float(x)) for x in (40.5, -75.0, 34.5, -117.0)]
    got = spark.range(1).select(card(*c, F.lit(6), F.lit(0), F.lit(140.5), F.lit(14.074), "/data").alias("x")).first().x
    assert "Path.hour 1\n" in got and "Path.SSN 140\n" in got and 'DataFilePath "/data/"' in got


def test_keyed_scorer(spark, tmp_path):
    ssn = spark.createDataFrame([("2024-05", 140.5)], "month string, ssn double")
    cells = spark.createDataFrame([(at(h % 2), "FN", "DM", b, 1, None, 1) for h in range(4) for b in ("20m", "6m")], CELLS)
    model = KeyedScorer(lambda keys: [50.0] * len(keys), ssn, str(tmp_path / "cache"))
    for _ in range(2):
        got = model.predict(cells).collect()
        assert len(got) == 8 and {(r.band, r.p_open) for r in got} == {("20m", 0.5), ("6m", None)}
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2


def test_boosted_trees(spark, tmp_path):
    from skywindow.operators.gbt import GBT

    rows = [(at(h % 90, 15 * (h % 4)), "FN", "DM", "20m", 1, float(h % 10), int(h % 10 > 4)) for h in range(400)]
    cells = spark.createDataFrame(rows, CELLS).withColumn("kp_now", F.when(F.col("snr_ft8eq_p50") > 0, F.col("snr_ft8eq_p50")))
    model = GBT(["kp_now", "n_spots"], trees=40, leaves=8, rate=0.3, least_rows=20).fit(cells)
    assert metrics.scores(model.predict(cells)).first().brier < 0.1
    model.save(spark, str(tmp_path / "m"))
    again = GBT.load(spark, str(tmp_path / "m"), ["kp_now", "n_spots"])
    assert {r.p_open for r in again.predict(cells).collect()} == {r.p_open for r in model.predict(cells).collect()}
    with pytest.raises(ValueError):
        GBT.load(spark, str(tmp_path / "m"), ["other"])
