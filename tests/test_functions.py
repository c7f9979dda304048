"""Hand-worked values of the column functions."""

import pytest
from pyspark.sql import functions as F

from skywindow.functions.geo import geomag_lat, grid_lat, grid_lon, grid_of, normal_grid
from skywindow.functions.hygiene import bare_call, base_call, is_valid_call, judged, mode_class, without_skimmer
from skywindow.functions.signal import ft8_equivalent
from skywindow.operators.features import adjacent_bands, neighbors
from skywindow.operators.sampling import stratum_seed
from skywindow.schema import SPOT
from skywindow.sources.indices import kp_of


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(col.alias("x")).first().x


def test_grids(spark):
    assert one(spark, grid_lat(F.col("g")), g="FN20") == 40.5
    assert one(spark, grid_lon(F.col("g")), g="FN20") == -75.0
    assert one(spark, grid_lat(F.col("g")), g="FN") == 45.0
    assert one(spark, grid_lon(F.col("g")), g="FN") == -70.0
    assert one(spark, grid_of(F.col("a"), F.col("b")), a=40.5, b=-75.0) == "FN20"
    assert one(spark, grid_of(F.col("a"), F.col("b"), 2), a=90.0, b=180.0) == "RR"
    for g, want in (("dm14ed", "DM14"), (" fn ", "FN"), ("RR73", None), ("FN2", None), ("", None), ("ZZ99", None)):
        assert one(spark, normal_grid(F.col("g")), g=g) == want


def test_geomagnetic_pole(spark):
    assert one(spark, geomag_lat(F.col("a"), F.col("b")), a=80.65, b=-72.68) == pytest.approx(90, abs=1e-4)
    assert one(spark, geomag_lat(F.col("a"), F.col("b")), a=90.0, b=0.0) == pytest.approx(80.65, abs=1e-9)


def test_calls(spark):
    assert one(spark, bare_call(F.col("c")), c=" <zl9tst> ") == "ZL9TST"
    assert one(spark, base_call(F.col("c")), c="ZL9TST/P") == "ZL9TST"
    assert one(spark, without_skimmer(F.col("c")), c="W1NT-2") == "W1NT"
    assert one(spark, is_valid_call(F.col("c")), c="<ZL9TST>") is True
    assert one(spark, is_valid_call(F.col("c")), c="!!!") is False


def test_mode_class(spark):
    for m, want in (("ft8", "digi"), ("msk144", "digi"), ("CW", "cw"), ("SSB", "other"), (None, "other")):
        assert one(spark, mode_class(F.col("m")), m=m) == want


def test_ft8_equivalent(spark):
    x = ft8_equivalent(F.col("m"), F.col("s"), F.col("d"))
    assert one(spark, x, m="WSPR", s=-10, d=20) == 20.0
    assert one(spark, x, m="CW", s=-10, d=None) == -17.0
    assert one(spark, x, m="MSK144", s=-10, d=None) is None


def test_stratum_seed(spark):
    assert one(spark, stratum_seed(F.col("b"), F.col("d")), b="20m", d="2026-06-01") == 3021079974


def test_neighbours(spark):
    assert adjacent_bands("160m") == ["80m"]
    assert adjacent_bands("20m") == ["30m", "17m"]
    around = neighbors(F.col("f"))
    assert sorted(one(spark, around, f="FN")) == ["EM", "EN", "EO", "FM", "FO", "GM", "GN", "GO"]
    assert sorted(one(spark, around, f="AA")) == ["AB", "BA", "BB", "RA", "RB"]


def test_kp_of(spark):
    for raw, want in ((57, 5 + 2 / 3), (60, 6.0), (3, 1 / 3), (99, None), (55, None)):
        got = one(spark, kp_of(F.col("k")), k=raw)
        assert got is None if want is None else got == pytest.approx(want)


def spot(**over):
    base = dict(source="wsprnet", ts=None, band="20m", mode="WSPR", freq_hz=1, dx_call="ZL9TST", de_call="OK9ZZZ", dx_grid="FN20", de_grid="DM14", dx_field=None, de_field=None, dx_lat=None, dx_lon=None, de_lat=None, de_lon=None, snr_db=-10, tx_dbm=20)
    import datetime as dt

    base["ts"] = dt.datetime(2024, 5, 1, 12, 2)
    return tuple((base | over)[f.name] for f in SPOT.fields)


def test_reject_order(spark):
    cases = [
        (spot(), None), (spot(ts=None), "missing_required_field"), (spot(dx_call=""), "missing_required_field"), (spot(band="2m", dx_call="!!!"), "unsupported_band"), (spot(dx_call="!!!"), "invalid_callsign"),
        (spot(dx_call="ZL9TST/MM"), "mm_am_suffix"), (spot(dx_call="OK9ZZZ/P"), "self_spot"), (spot(dx_grid="rr73"), "rr73_grid"), (spot(dx_grid=None), "no_usable_location"),
        (spot(dx_grid=None, dx_lat=40.0, dx_lon=-75.0), None), (spot(dx_grid="DM14ed"), "distance_too_short"), (spot(dx_grid="FN2"), "no_usable_location"),
    ]
    df = spark.createDataFrame([(i, *s) for i, (s, _) in enumerate(cases)], "i int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SPOT.fields))
    got = {r.i: r.reject_reason for r in judged(df).select("i", "reject_reason").collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
