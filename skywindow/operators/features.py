"""Features of a cell and window: path, sun, space weather and trailing history."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import along, bearing, geomag_lat, great_circle_km, grid_lat, grid_lon
from ..plans.tables import staged
from ..functions.solar import DAY_ZENITH, is_day, sun_terms, zenith
from ..schema import AVAILABLE_S, BANDS, CELL, LOOKBACKS, WINDOW_S, literal_map

CONTROL_KM = 1000.0
KP_LAGS = (3, 6, 12, 24, 48)
AS_OF_S = 3600
SMOOTHED_S = 27 * 86400
#: Quarters of an hour that are looked back over for the last sunrise or sunset.
TERMINATOR_STEPS = 48
RELATIONS = ("same_cell", "reverse_path", "adjacent_band", "adjacent_cell", "band_wide")

TIME_COLUMNS = ["hour_sin", "hour_cos", "doy_sin", "doy_cos", "month"]
GEOMETRY_COLUMNS = ["distance_km", "bearing_deg", "midpoint_lat", "midpoint_lon", "tx_control_lat", "tx_control_lon", "rx_control_lat", "rx_control_lon", "tx_geomag_lat", "rx_geomag_lat", "midpoint_geomag_lat"]
SOLAR_COLUMNS = ["midpoint_solar_zenith", "tx_control_solar_zenith", "rx_control_solar_zenith", "path_daylight_fraction", "midpoint_hours_since_terminator"]
SPACE_COLUMNS = ["kp_now", *[f"kp_lag{h}h" for h in KP_LAGS], "bz_gsm_now", "solar_wind_speed_now", "dst_now", "f107_daily", "f107_smoothed_27d"]
HISTORY_COLUMNS = [f"{r}_{s}_{lb}" for r in RELATIONS for s in ("n", "snr") for lb in LOOKBACKS] + ["same_hour_yesterday_open"]
FEATURE_COLUMNS = [*TIME_COLUMNS, "band_ordinal", *GEOMETRY_COLUMNS, *SOLAR_COLUMNS, *SPACE_COLUMNS, *HISTORY_COLUMNS]


def add_time(labels: DataFrame) -> DataFrame:
    hour, day = 2 * math.pi * F.hour("window_start") / 24, 2 * math.pi * F.dayofyear("window_start") / 365
    return labels.withColumns({"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "doy_sin": F.sin(day), "doy_cos": F.cos(day), "month": F.month("window_start")})


def add_band(labels: DataFrame) -> DataFrame:
    """The band's place in the order of bands; another band is an error."""
    order = F.try_element_at(literal_map({b: i for i, b in enumerate(BANDS)}), F.col("band"))
    return labels.withColumn("band_ordinal", F.coalesce(order, F.raise_error(F.concat(F.lit("unknown band "), F.coalesce("band", F.lit("null"))))).cast("long"))


def add_geometry(labels: DataFrame) -> DataFrame:
    """Path columns, worked out once for each pair of fields (at most 324 x 324 rows, kept as a table in two steps)."""
    pairs = labels.select("tx_field", "rx_field").distinct()
    ends = {f"_{s}_{n}": f(F.col(f"{s}_field")) for s in ("tx", "rx") for n, f in (("lat", grid_lat), ("lon", grid_lon))}
    pairs = staged(pairs.withColumns(ends))
    at = [F.col(c) for c in ends]
    pairs = staged(pairs.withColumns({"distance_km": great_circle_km(*at), "bearing_deg": bearing(*at), "tx_geomag_lat": geomag_lat(*at[:2]), "rx_geomag_lat": geomag_lat(*at[2:])}))
    near = F.when(F.col("distance_km") <= 2 * CONTROL_KM, 0.5).otherwise(CONTROL_KM / F.col("distance_km"))
    points = {}
    for name, share in (("midpoint", F.lit(0.5)), ("tx_control", near), ("rx_control", 1 - near)):
        points[f"{name}_lat"], points[f"{name}_lon"] = along(*at, F.col("distance_km"), share)
    pairs = staged(pairs.withColumns(points))
    pairs = pairs.withColumn("midpoint_geomag_lat", geomag_lat(F.col("midpoint_lat"), F.col("midpoint_lon")))
    return labels.join(pairs.select("tx_field", "rx_field", *GEOMETRY_COLUMNS), ["tx_field", "rx_field"], "left").select(*labels.columns, *GEOMETRY_COLUMNS)


def _since_terminator(sun: DataFrame, keys: list[str]) -> DataFrame:
    """Adds hours since day and night last changed at the midpoint, in quarters: positive by day, negative by night, at most 12.

    The quarters looked back over are rows: what depends on the time alone is worked out once for each of them (some 35,000
    a year), and the first change is a minimum that each task takes before anything is shuffled.
    """
    t = F.unix_seconds("window_start")
    now = F.col("midpoint_solar_zenith") < DAY_ZENITH
    back = sun.select("*", now.alias("_now"), F.explode(F.sequence(F.lit(1), F.lit(TERMINATOR_STEPS))).alias("_lag")).withColumn("_slot", t - F.col("_lag") * WINDOW_S)
    slots = sun.select(t.alias("t")).distinct().select(F.explode(F.sequence(F.col("t") - TERMINATOR_STEPS * WINDOW_S, F.col("t") - WINDOW_S, F.lit(WINDOW_S).cast("long"))).alias("_slot")).distinct()
    slots = slots.select("_slot", *[c.alias(f"_s{k}") for k, c in enumerate(sun_terms(F.col("_slot")))])
    day = is_day(F.col("midpoint_lat"), F.col("midpoint_lon"), tuple(F.col(f"_s{k}") for k in range(3)))
    values = [c for c in sun.columns if c not in keys]
    changed = back.join(slots, "_slot").groupBy(*keys).agg(*[F.first(c).alias(c) for c in values], F.first("_now").alias("_now"), F.min(F.when(day != F.col("_now"), F.col("_lag"))).alias("_back"))
    hours = F.coalesce(F.col("_back") * 0.25, F.lit(12.0))
    return changed.withColumn("midpoint_hours_since_terminator", F.when(F.col("_now"), hours).otherwise(-hours)).drop("_now", "_back")


def add_solar(labels: DataFrame) -> DataFrame:
    """Needs the geometry columns. The sun is worked out once for each path and window, whatever the bands."""
    pair = ["tx_field", "rx_field", "window_start"]
    when = F.unix_seconds("window_start")
    places = [f"{p}_{x}" for p in ("midpoint", "tx_control", "rx_control") for x in ("lat", "lon")]
    out = labels.select(*pair, *places).distinct()
    out = out.withColumns({f"{p}_solar_zenith": zenith(F.col(f"{p}_lat"), F.col(f"{p}_lon"), when) for p in ("midpoint", "tx_control", "rx_control")})
    lit = sum(((F.col(f"{p}_solar_zenith") < DAY_ZENITH).cast("int") for p in ("tx_control", "rx_control")), (F.col("midpoint_solar_zenith") < DAY_ZENITH).cast("int"))
    sun = _since_terminator(out.withColumn("path_daylight_fraction", lit / F.lit(3.0)), pair)
    return labels.join(sun.select(*pair, *SOLAR_COLUMNS), pair, "left").select(*labels.columns, *SOLAR_COLUMNS)


def _slots(series: DataFrame, strict: bool) -> DataFrame:
    """For each 15-minute slot, the latest row of the series at or (if strict) before it, not older than an hour.

    Each row is known in at most five slots, so the as-of join is a plain join on the slot.
    """
    t = F.unix_seconds("time")
    first = (F.floor(t / WINDOW_S) + 1) * WINDOW_S if strict else F.ceil(t / WINDOW_S) * WINDOW_S
    last = F.floor((t + AS_OF_S) / WINDOW_S) * WINDOW_S
    values = [c for c in series.columns if c != "time"]
    spread = series.where(first <= last).select(F.explode(F.sequence(first, last, F.lit(WINDOW_S).cast("long"))).alias("slot"), t.alias("t"), *values)
    return spread.groupBy("slot").agg(F.max_by(F.struct(*values), "t").alias("v"))


def _seconds(horizon_hours: float) -> int:
    if (horizon_hours * 4) % 1:
        raise ValueError("horizon_hours must be a multiple of a quarter")
    return int(horizon_hours * 3600)


def _space_at(rows: DataFrame, hourly: DataFrame) -> DataFrame:
    """Adds the space weather that is known at ``_at``."""
    t = F.unix_seconds("time")
    # the 27-day mean needs all rows in order; the series is a row an hour, so one ordered window holds it
    trailing = Window.orderBy(t).rangeBetween(-SMOOTHED_S, -1)
    series = hourly.select("time", "kp", "f107", "bz_gsm", "solar_wind_speed", "dst").withColumn("smoothed", F.avg("f107").over(trailing))
    loose, strict = _slots(series, False), _slots(series.select("time", "f107"), True)
    # one row a slot with all lags resolved, so that the labels are joined once
    known = rows.select("_at").distinct()
    for name, lag in (("now", 0), *((f"lag{h}h", h) for h in KP_LAGS)):
        take = [F.col("v.kp").alias(f"kp_{name}")] + ([F.col("v.bz_gsm").alias("bz_gsm_now"), F.col("v.solar_wind_speed").alias("solar_wind_speed_now"), F.col("v.dst").alias("dst_now"), F.col("v.smoothed").alias("f107_smoothed_27d")] if not lag else [])
        known = known.join(loose.select((F.col("slot") + lag * 3600).alias("_at"), *take), "_at", "left")
    known = known.join(strict.select(F.col("slot").alias("_at"), F.col("v.f107").alias("f107_daily")), "_at", "left")
    return rows.join(known.select("_at", *SPACE_COLUMNS), "_at").select(*rows.columns, *SPACE_COLUMNS)


def _known_at(labels: DataFrame, horizon_hours: float) -> DataFrame:
    return labels.withColumn("_at", F.unix_seconds("window_start") - _seconds(horizon_hours))


def add_space_weather(labels: DataFrame, hourly: DataFrame, horizon_hours: float = 0.0) -> DataFrame:
    """Space weather as known at the window less the horizon; the row matched decides, a null in it stays null.

    ``f107_daily`` takes rows before the time only: the day's value is not out yet. Horizons are whole quarters of an hour.
    """
    return _space_at(_known_at(labels, horizon_hours), hourly).drop("_at")


def adjacent_bands(band: str) -> list[str]:
    k = BANDS.index(band)
    return [BANDS[j] for j in (k - 1, k + 1) if 0 <= j < len(BANDS)]


def neighbors(rx):
    """Up to eight fields around one: longitude wraps, latitude doesn't."""
    x, y = F.ascii(F.substring(rx, 1, 1)) - 65, F.ascii(F.substring(rx, 2, 1)) - 65
    cells = [F.when((y + j).between(0, 17), F.concat(F.chr(F.pmod(x + i, F.lit(18)) + 65), F.chr(y + j + 65))) for j in (-1, 0, 1) for i in (-1, 0, 1) if i or j]
    return F.array_compact(F.array(*cells))


def _window_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of n, num and den over [t - L, t - 20 min] for every row; one sort by key and time for all lookbacks."""
    for lb, s in LOOKBACKS.items():
        if s > AVAILABLE_S:
            w = Window.partitionBy(*keys).orderBy("t").rangeBetween(-s, -AVAILABLE_S)
            rows = rows.withColumns({f"{c}_{lb}": F.sum(c).over(w) for c in ("n", "num", "den")})
    return rows


def _stats(prefix: str, num=lambda lb: F.col(f"num_{lb}"), den=lambda lb: F.col(f"den_{lb}"), n=lambda lb: F.col(f"n_{lb}")) -> list:
    live = {lb for lb, s in LOOKBACKS.items() if s > AVAILABLE_S}
    counts = [(F.coalesce(n(lb), F.lit(0)).cast("long") if lb in live else F.lit(0).cast("long")).alias(f"{prefix}_n_{lb}") for lb in LOOKBACKS]
    return counts + [(F.when(den(lb) > 0, num(lb) / den(lb)) if lb in live else F.lit(None).cast("double")).alias(f"{prefix}_snr_{lb}") for lb in LOOKBACKS]


def _asks(relations: tuple[str, ...]):
    """The paths that a cell asks about, as ``relation, tx, rx, b``."""
    path = lambda r, tx, rx, b: F.struct(F.lit(r).alias("relation"), tx.alias("tx"), rx.alias("rx"), b.alias("b"))
    tx, rx, band = F.col("tx_field"), F.col("rx_field"), F.col("band")
    band_map = literal_map({b: ",".join(adjacent_bands(b)) for b in BANDS})
    of = {
        "same_cell": lambda: F.array(path("same_cell", tx, rx, band)),
        "reverse_path": lambda: F.array(path("reverse_path", rx, tx, band)),
        "adjacent_band": lambda: F.transform(F.split(F.element_at(band_map, band), ","), lambda b: path("adjacent_band", tx, rx, b)),
        "adjacent_cell": lambda: F.transform(neighbors(rx), lambda r: path("adjacent_cell", tx, r, band)),
    }
    return F.concat(*[of[r]() for r in relations])


def _path_history(points: DataFrame, past: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """The statistics of the asked relations at distinct points ``tx_field, rx_field, band, _at``.

    Points of every relation are dealt to the path that they ask about and grouped by time there, so that a path's frames run
    over one row a time, however many cells, relations and horizons ask about it. Numerators and denominators of neighbours
    are pooled and divided once.
    """
    who = F.struct("ask.relation", "tx_field", "rx_field", "band")
    asked = points.select("*", F.explode(_asks(relations)).alias("ask")).select("ask.tx", "ask.rx", "ask.b", F.col("_at").alias("t"), who.alias("who"))
    rows = asked.unionByName(past, allowMissingColumns=True).repartition("tx", "rx", "b")
    rows = rows.groupBy("tx", "rx", "b", "t").agg(*[F.sum(c).alias(c) for c in ("n", "num", "den")], F.collect_list("who").alias("who"))
    summed = _window_sums(rows, ["tx", "rx", "b"]).where(F.size("who") > 0)
    live = [lb for lb, s in LOOKBACKS.items() if s > AVAILABLE_S]
    each = summed.select(F.explode("who").alias("who"), F.col("t").alias("_at"), *[f"{c}_{lb}" for c in ("n", "num", "den") for lb in live])
    pooled = each.groupBy("who.tx_field", "who.rx_field", "who.band", "_at").agg(*[F.sum(F.when(F.col("who.relation") == r, F.col(f"{c}_{lb}"))).alias(f"{r}_{c}_{lb}") for r in relations for c in ("n", "num", "den") for lb in live])
    return pooled.select("tx_field", "rx_field", "band", "_at", *[x for r in relations for x in _stats(r, *[(lambda lb, r=r, c=c: F.col(f"{r}_{c}_{lb}")) for c in ("num", "den", "n")])])


def _history_at(rows: DataFrame, history: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """Adds what had been heard by ``_at``. Points of several horizons that fall together are looked up once."""
    sec = F.unix_seconds("window_start")
    weight = F.when(F.col("snr_ft8eq_p50").isNotNull(), F.col("n_spots")).otherwise(0)
    past = history.select(F.col("tx_field").alias("tx"), F.col("rx_field").alias("rx"), F.col("band").alias("b"), sec.alias("t"), F.col("n_spots").cast("long").alias("n"), (F.col("n_spots") * F.coalesce("snr_ft8eq_p50", F.lit(0.0))).alias("num"), weight.cast("long").alias("den"))
    point = ["tx_field", "rx_field", "band", "_at"]
    points, out = rows.select(*point).distinct(), rows
    of_path = tuple(r for r in RELATIONS[:4] if r in relations)
    if of_path:
        out = out.join(_path_history(points, past, of_path), point, "left")
    if "band_wide" in relations:
        by_band = history.groupBy("band", sec.alias("t")).agg(F.sum("n_spots").cast("long").alias("n"), F.avg("snr_ft8eq_p50").alias("snr"))
        by_band = by_band.select("band", "t", "n", (F.col("n") * F.coalesce("snr", F.lit(0.0))).alias("num"), F.when(F.col("snr").isNotNull(), F.col("n")).otherwise(0).cast("long").alias("den"))
        marks = rows.select("band", F.col("_at").alias("t")).distinct().withColumn("mark", F.lit(True))
        band_sums = _window_sums(by_band.unionByName(marks, allowMissingColumns=True), ["band"]).where("mark")
        out = out.join(band_sums.select("band", F.col("t").alias("_at"), *_stats("band_wide")), ["band", "_at"], "left")
    if "yesterday" in relations:
        before = history.select("tx_field", "rx_field", "band", (sec + 86400).alias("_at"), F.col("open").alias("same_hour_yesterday_open"))
        out = out.join(before, point, "left")
    return out.select(*rows.columns, *[c for c in HISTORY_COLUMNS if any(c.startswith(r) for r in relations) or ("yesterday" in relations and c == "same_hour_yesterday_open")])


def add_history(history: DataFrame, labels: DataFrame, horizon_hours: float = 0.0, relations: tuple[str, ...] = (*RELATIONS, "yesterday")) -> DataFrame:
    """What was heard before the window less the horizon, on the same, the reverse and neighbouring paths.

    Data count once they are 20 minutes old; the 15-minute lookback is empty by construction. Only the columns of the asked
    ``relations`` are added.
    """
    return _history_at(_known_at(labels, horizon_hours), history, tuple(relations)).drop("_at")


def feature_matrices(labels: DataFrame, history: DataFrame, hourly: DataFrame, horizons: tuple[float, ...]) -> DataFrame:
    """Labels with all of ``FEATURE_COLUMNS`` for each horizon, told apart by ``horizon_hours``, in one plan.

    Time, path and sun stay at the target window, as they are known in advance: they are worked out once. What is known
    depends on the time alone at which it is asked for, so that horizons share it where their times meet.
    """
    out = add_band(add_solar(add_geometry(add_time(labels))))
    each = F.explode(F.array(*[F.struct(F.lit(float(h)).alias("horizon_hours"), F.lit(_seconds(h)).cast("long").alias("s")) for h in horizons]))
    out = out.withColumn("h", each).select("*", "h.horizon_hours", (F.unix_seconds("window_start") - F.col("h.s")).alias("_at")).drop("h")
    return _history_at(_space_at(out, hourly), history, (*RELATIONS, "yesterday")).drop("_at")


def feature_matrix(labels: DataFrame, history: DataFrame, hourly: DataFrame, horizon_hours: float = 0.0) -> DataFrame:
    """``feature_matrices`` of one horizon, without its column."""
    return feature_matrices(labels, history, hourly, (horizon_hours,)).drop("horizon_hours")
