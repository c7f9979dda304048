"""One pass from the raw table to clean spots, and hygiene in cheaper terms that say the same."""

import glob
import os

from pyspark.sql import functions as F

from skywindow import adapter
from skywindow.functions.geo import great_circle_km, grid_lat, grid_lon, normal_grid
from skywindow.functions.hygiene import bare_call, base_call, judged
from skywindow.operators.labels import labels
from skywindow.queries import clean
from skywindow.schema import LEAST_PATH_KM, as_spots


def test_raw_spots_are_not_stored_and_cells_are_counted_in_one_reading(spark, sf):
    stored = lambda: set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/staged-*"))
    before = stored()
    spots = adapter.spots(spark, sf)
    assert stored() == before and all(os.path.basename(f) == "lineitem.parquet" for f in spots.inputFiles())
    # what was heard (with its signals), who listened and who sent
    assert labels(clean(spark, sf))._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 3


def test_grids_and_calls_as_they_were_told_apart_before(spark):
    odd = ["FN31", "fn31pr", " fn31 ", "FN", "fn", "FN3", "FNX", "FN\n", "FN31\n", "SS00", "AS00", "RR73", " rr73", "RR73A", "RR", "RR7", "", " ", "FN٠٠", "ıı00", "F", "31FN", None,
           "<k1abc>", "k1abc>\n", "<<x>>", "a<b", "k1abc", "k1abc/p", "/p", "k1/", "<", ">"]
    df = spark.createDataFrame([(x,) for x in odd], "g string")
    whole = F.upper(F.trim("g"))
    four = F.substring(whole, 1, 4)
    kinds = F.translate(four, "ABCDEFGHIJKLMNOPQR0123456789", "a" * 18 + "9" * 10)
    grid = F.when(((kinds == "aa99") & (four != "RR73")) | ((kinds == "aa") & (F.length(whole) == 2)), four)
    call = F.regexp_replace(whole, "^<|>$", "")
    rows = df.select("g", grid.alias("a"), normal_grid(F.col("g")).alias("b"), call.alias("c"), bare_call(F.col("g")).alias("d"), F.split_part(call, F.lit("/"), F.lit(1)).alias("e"), base_call(F.col("g")).alias("f")).collect()
    assert [(r.a, r.c, r.e) for r in rows] == [(r.b, r.d, r.f) for r in rows]
    assert sum(r.a is not None for r in rows) == 8  # dotless i counts as I in upper case


def test_near_paths_near_the_poles_and_by_place_only(spark):
    nan = float("nan")
    ends = [("FN31", "FN31", None, None), ("FN31", "FN32", None, None), ("AR09", "BR09", None, None), ("AR09", "RR09", None, None), ("AA00", "BA00", None, None), (None, "FN31", 41.6, -73.1),
            (None, "FN31", 41.3, -73.0), (None, "FN31", nan, -73.0), (None, "FN31", 41.5, nan), (None, "FN31", 41.72, -73.0), (None, "FN31", 41.73, -73.0), ("RR73", "FN31", 41.5, -73.0), ("RR", "FN31", None, None), (None, "FN31", None, 5.0)]
    rows = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "freq_hz long, dx_grid string, de_grid string, dx_lat double, dx_lon double")
    rows = rows.withColumns({"ts": F.timestamp_seconds(F.lit(1714600000)), "band": F.lit("20m"), "mode": F.lit("FT8"), "dx_call": F.lit("K1ABC"), "de_call": F.lit("W2DEF")})
    got = {r.freq_hz: r.reject_reason for r in judged(as_spots(rows)).collect()}
    x, e = normal_grid(F.col("dx_grid")), normal_grid(F.col("de_grid"))
    far = great_circle_km(F.coalesce(grid_lat(x), "dx_lat"), F.coalesce(grid_lon(x), "dx_lon"), grid_lat(e), grid_lon(e))
    for r in rows.select("freq_hz", "dx_grid", "dx_lat", (far < LEAST_PATH_KM).alias("near")).collect():
        want = "rr73_grid" if r.dx_grid == "RR73" else "no_usable_location" if r.dx_grid is None and r.dx_lat is None else "distance_too_short" if r.near else None
        assert got[r.freq_hz] == want, r
    assert list(got.values()).count("distance_too_short") >= 4
