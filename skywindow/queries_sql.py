"""DuckDB SQL for the registered queries, put differently from the plans where that can be: range joins for frames and
spread windows, ASOF joins for slots, QUALIFY for ranks."""

from __future__ import annotations

from .adapter import EPOCH, HOURLY_SQL, SPOTS_SQL
from .schema import BAND_GROUPS, BANDS, CALLSIGN, CW_MODES, DIAL_MHZ, DIGITAL_MODES, EARTH_KM, FT8_LEVEL_MODES, GEOMAG_POLE, HORIZONS_H

_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
TRAIN_END, EVAL_START = "TIMESTAMP '2024-05-02 00:00:00'", "TIMESTAMP '2024-05-04 00:00:00'"


def norm(g: str) -> str:
    g4 = f"substr(upper(trim({g})), 1, 4)"
    return f"CASE WHEN (regexp_matches({g4}, '^[A-R][A-R][0-9][0-9]$') OR regexp_matches({g4}, '^[A-R][A-R]$')) AND {g4} <> 'RR73' THEN {g4} END"


def lat(g: str) -> str:
    return f"(CASE WHEN length({g}) >= 4 THEN (ascii(substr({g}, 2, 1)) - 65) * 10 - 90 + ascii(substr({g}, 4, 1)) - 48 + 0.5 WHEN length({g}) = 2 THEN (ascii(substr({g}, 2, 1)) - 65) * 10 - 85 END)::DOUBLE"


def lon(g: str) -> str:
    return f"(CASE WHEN length({g}) >= 4 THEN (ascii(substr({g}, 1, 1)) - 65) * 20 - 180 + (ascii(substr({g}, 3, 1)) - 48) * 2 + 1 WHEN length({g}) = 2 THEN (ascii(substr({g}, 1, 1)) - 65) * 20 - 170 END)::DOUBLE"


def km(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * {EARTH_KM}::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({c} - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - ({b})) / 2), 2)))))"


def mode_class(m: str) -> str:
    return f"CASE WHEN upper(trim({m})) IN ({_list(DIGITAL_MODES)}) THEN 'digi' WHEN upper(trim({m})) IN ({_list(CW_MODES)}) THEN 'cw' ELSE 'other' END"


def call(c: str) -> str:
    return f"regexp_replace(regexp_replace(upper(trim({c})), '^<', ''), '>$', '')"


SNR = f"snr_db + CASE WHEN mode IN ({_list(FT8_LEVEL_MODES)}) THEN 0 WHEN mode IN ({_list(CW_MODES)}) THEN -7 END + coalesce(50 - tx_dbm, 0)"

JUDGED = f"""
placed AS (SELECT *, {norm('dx_grid')} AS xg2, {norm('de_grid')} AS eg2 FROM spots),
judged AS (SELECT *, CASE
  WHEN ts IS NULL OR coalesce(band, '') = '' OR coalesce(mode, '') = '' OR coalesce(dx_call, '') = '' OR coalesce(de_call, '') = '' THEN 'missing_required_field'
  WHEN band NOT IN ({_list(BANDS)}) THEN 'unsupported_band'
  WHEN NOT regexp_matches({call('dx_call')}, '{CALLSIGN}') OR NOT regexp_matches({call('de_call')}, '{CALLSIGN}') THEN 'invalid_callsign'
  WHEN suffix({call('dx_call')}, '/MM') OR suffix({call('dx_call')}, '/AM') OR suffix({call('de_call')}, '/MM') OR suffix({call('de_call')}, '/AM') THEN 'mm_am_suffix'
  WHEN split_part({call('dx_call')}, '/', 1) = split_part({call('de_call')}, '/', 1) THEN 'self_spot'
  WHEN coalesce(substr(upper(trim(dx_grid)), 1, 4) = 'RR73', false) OR coalesce(substr(upper(trim(de_grid)), 1, 4) = 'RR73', false) THEN 'rr73_grid'
  WHEN (xg2 IS NULL AND (dx_lat IS NULL OR dx_lon IS NULL)) OR (eg2 IS NULL AND (de_lat IS NULL OR de_lon IS NULL)) THEN 'no_usable_location'
  WHEN {km(f"coalesce({lat('xg2')}, dx_lat)", f"coalesce({lon('xg2')}, dx_lon)", f"coalesce({lat('eg2')}, de_lat)", f"coalesce({lon('eg2')}, de_lon)")} < 25 THEN 'distance_too_short' END AS reason
FROM placed),
good AS (SELECT * FROM judged WHERE reason IS NULL)"""


def ranked(by_source: bool) -> str:
    rank = "CASE source WHEN 'wsprnet' THEN 0 WHEN 'rbn' THEN 1 WHEN 'pskreporter' THEN 2 WHEN 'cqdx' THEN 3 ELSE 99 END, " if by_source else ""
    return f"""
clean AS (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) AS w, {mode_class('mode')} AS mc FROM good QUALIFY row_number() OVER (
  PARTITION BY dx_call, de_call, band, mode, time_bucket(INTERVAL 15 MINUTE, ts)
  ORDER BY {rank}snr_db DESC NULLS LAST, ts, de_grid NULLS LAST, dx_grid NULLS LAST, dx_lat NULLS LAST, dx_lon NULLS LAST, source NULLS LAST, tx_dbm NULLS LAST) = 1)"""


CLEAN = ranked(True)
UPTIME = f"""
ws AS (SELECT unnest(generate_series(TIMESTAMP '{EPOCH}' - INTERVAL 1 HOUR, TIMESTAMP '{EPOCH}' + INTERVAL 97 HOUR, INTERVAL 15 MINUTE)) AS w),
ev AS (SELECT ws.w, c.de_call, c.band, c.mc, c.ts, c.eg2 FROM clean c JOIN ws ON date_trunc('minute', c.ts) >= ws.w - INTERVAL 30 MINUTE AND date_trunc('minute', c.ts) < ws.w + INTERVAL 45 MINUTE WHERE c.mc <> 'other'),
place AS (SELECT w, de_call, band, mc, eg2 FROM ev WHERE eg2 IS NOT NULL GROUP BY w, de_call, band, mc, eg2 QUALIFY row_number() OVER (PARTITION BY w, de_call, band, mc ORDER BY length(eg2) DESC, count(*) DESC, eg2) = 1),
uptime AS (SELECT e.w, e.de_call, e.band, e.mc, count(*) AS n, min(e.ts) AS first_report, max(e.ts) AS last_report, p.eg2 AS grid FROM ev e JOIN place p USING (w, de_call, band, mc) GROUP BY ALL)"""
TX = """
tx AS (SELECT w, substr(xg2, 1, 2) AS tx_field, band, mc, count(DISTINCT dx_call) AS n, CASE WHEN bool_or(source = 'wsprnet') THEN 'wspr' ELSE 'spot' END AS tier FROM clean WHERE mc <> 'other' GROUP BY ALL)"""
UNIVERSE = """
fielded AS (SELECT *, substr(xg2, 1, 2) AS tx_field, substr(eg2, 1, 2) AS rx_field FROM clean WHERE xg2 IS NOT NULL AND eg2 IS NOT NULL),
pos AS (SELECT w, tx_field, rx_field, band, count(*) AS n_spots FROM fielded GROUP BY ALL),
mon AS (SELECT w, substr(grid, 1, 2) AS rx_field, band, mc, count(DISTINCT de_call) AS m FROM uptime GROUP BY ALL),
able AS (SELECT w, tx_field, rx_field, band, CAST(sum(m) AS BIGINT) AS n_monitors, CAST(sum(n) AS BIGINT) AS n_tx_stations, bool_or(tier = 'wspr') AS wspr FROM mon JOIN tx USING (w, band, mc) WHERE tx_field IS NOT NULL GROUP BY ALL),
uni AS (SELECT w, tx_field, rx_field, band, coalesce(n_spots, 0) AS n_spots, coalesce(n_spots, 0) > 0 AS is_positive, n_monitors IS NOT NULL AS is_n_eligible, coalesce(n_monitors, 0) AS n_monitors,
  coalesce(n_tx_stations, 0) AS n_tx_stations, CASE WHEN wspr THEN 'wspr' ELSE 'spot' END AS evidence_tier FROM pos FULL JOIN able USING (w, tx_field, rx_field, band))"""
LABELS = f"""
med AS (SELECT w, tx_field, rx_field, band, median(CAST({SNR} AS DOUBLE)) AS snr FROM fielded GROUP BY ALL),
lab AS (SELECT uni.*, CAST(is_positive AS INT) AS open, med.snr FROM uni LEFT JOIN med USING (w, tx_field, rx_field, band))"""


def upto(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in (SPOTS_SQL, *parts)) + "\n"


TO_LABELS = (JUDGED, CLEAN, UPTIME, TX, UNIVERSE, LABELS)
CELL = "CAST(epoch(w) AS BIGINT) AS window_s, tx_field, rx_field, band"
SPOT_OUT = "source, CAST(epoch(ts) AS BIGINT) AS ts, band, mode, dx_call, de_call, dx_grid, de_grid, snr_db, tx_dbm"


def bearing(a: str, b: str, c: str, d: str) -> str:
    x = f"degrees(atan2(sin(radians({d} - ({b}))) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - ({b})))))"
    return f"(({x} + 360.0) % 360.0)"


def slerp(share: str) -> tuple[str, str]:
    d, rad = "(d / 6371.0088::DOUBLE)", lambda c: f"radians({c})"
    a, b = f"(sin((1 - {share}) * {d}) / sin({d}))", f"(sin({share} * {d}) / sin({d}))"
    x = f"({a} * cos({rad('a')}) * cos({rad('b')}) + {b} * cos({rad('c')}) * cos({rad('e')}))"
    y = f"({a} * cos({rad('a')}) * sin({rad('b')}) + {b} * cos({rad('c')}) * sin({rad('e')}))"
    z = f"({a} * sin({rad('a')}) + {b} * sin({rad('c')}))"
    return f"CASE WHEN d <= 0 THEN a ELSE degrees(atan2({z}, sqrt({x} * {x} + {y} * {y}))) END", f"CASE WHEN d <= 0 THEN b ELSE degrees(atan2({y}, {x})) END"


def dipole(la: str, lo: str) -> str:
    p, q = f"radians({GEOMAG_POLE[0]}::DOUBLE)", f"radians({lo} - ({GEOMAG_POLE[1]}))"
    return f"degrees(asin(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sin(radians({la})) * sin({p}) + cos(radians({la})) * cos({p}) * cos({q})))))"


_MID, _TXC, _RXC = slerp("0.5"), slerp("near"), slerp("(1 - near)")
GEO = f"""
pairs AS (SELECT DISTINCT tx_field, rx_field FROM lab),
ends AS (SELECT *, {lat('tx_field')} AS a, {lon('tx_field')} AS b, {lat('rx_field')} AS c, {lon('rx_field')} AS e FROM pairs),
dist AS (SELECT *, {km('a', 'b', 'c', 'e')} AS d FROM ends),
cut AS (SELECT *, CASE WHEN d <= 2000 THEN 0.5::DOUBLE ELSE 1000::DOUBLE / d END AS near FROM dist),
geo AS (SELECT *, {bearing('a', 'b', 'c', 'e')} AS brg, {_MID[0]} AS mlat, {_MID[1]} AS mlon, {_TXC[0]} AS xlat, {_TXC[1]} AS xlon, {_RXC[0]} AS rlat, {_RXC[1]} AS rlon FROM cut)"""


def zenith(la: str, lo: str, t: str) -> str:
    """Over whole seconds ``t``."""
    day = f"(({t}) % 86400)"
    g = f"(2 * pi() / 365 * (dayofyear(make_timestamp(({t}) * 1000000)) - 1 + ({day}::DOUBLE / 3600 - 12) / 24))"
    dec = f"(0.006918 - 0.399912 * cos({g}) + 0.070257 * sin({g}) - 0.006758 * cos(2 * {g}) + 0.000907 * sin(2 * {g}) - 0.002697 * cos(3 * {g}) + 0.00148 * sin(3 * {g}))"
    eqt = f"(229.18 * (0.000075 + 0.001868 * cos({g}) - 0.032077 * sin({g}) - 0.014615 * cos(2 * {g}) - 0.040849 * sin(2 * {g})))"
    ha = f"radians(({day}::DOUBLE / 60 + {eqt} + 4 * {lo}) / 4 - 180)"
    return f"degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sin(radians({la})) * sin({dec}) + cos(radians({la})) * cos({dec}) * cos({ha})))))"


SUN = f"""
sunny AS (SELECT DISTINCT l.w, CAST(epoch(l.w) AS BIGINT) AS t, g.tx_field, g.rx_field, g.mlat, g.mlon, g.xlat, g.xlon, g.rlat, g.rlon FROM lab l JOIN geo g USING (tx_field, rx_field)),
sun AS (SELECT *, {zenith('mlat', 'mlon', 't')} AS mz, {zenith('xlat', 'xlon', 't')} AS xz, {zenith('rlat', 'rlon', 't')} AS rz FROM sunny)"""
EDGE = f"""
mids AS (SELECT DISTINCT t, mlat, mlon, mz < 90 AS lit FROM sun),
back AS (SELECT t, mlat, mlon, lit, min(i) AS i FROM mids, (SELECT unnest(range(1, 49)) AS i) WHERE ({zenith('mlat', 'mlon', '(t - i * 900)')} < 90) <> lit GROUP BY ALL),
edge AS (SELECT m.t, m.mlat, m.mlon, CASE WHEN m.lit THEN 1 ELSE -1 END * coalesce(b.i * 0.25::DOUBLE, 12.0::DOUBLE) AS hrs FROM mids m LEFT JOIN back b USING (t, mlat, mlon))"""


def space(horizon_s: int) -> str:
    def asof(name: str, lag: int, cols: str, strict: bool = False) -> str:
        op = ">" if strict else ">="
        picks = ", ".join(f"CASE WHEN epoch(a.moment) - {lag} - epoch(h.time) <= 3600 THEN h.{c} END AS {alias}" for c, alias in (x.split(":") for x in cols.split()))
        return f"{name} AS (SELECT a.w, {picks} FROM ats a ASOF LEFT JOIN series h ON a.moment - to_seconds({lag}) {op} h.time)"

    lags = [asof(f"k{h}", h * 3600, f"kp:kp_lag{h}h") for h in (3, 6, 12, 24, 48)]
    return ",\n".join(
        [
            HOURLY_SQL.strip("\n"),
            "series AS (SELECT h.*, (SELECT avg(x.f107) FROM hourly x WHERE x.time >= h.time - INTERVAL 27 DAY AND x.time < h.time) AS smooth FROM hourly h)",
            f"ats AS (SELECT DISTINCT w, w - to_seconds({horizon_s}) AS moment FROM lab)",
            asof("k0", 0, "kp:kp_now bz_gsm:bz_gsm_now solar_wind_speed:solar_wind_speed_now dst:dst_now smooth:f107_smoothed_27d"),
            *lags,
            asof("fd", 0, "f107:f107_daily", True),
            "space AS (SELECT * FROM k0 JOIN k3 USING (w) JOIN k6 USING (w) JOIN k12 USING (w) JOIN k24 USING (w) JOIN k48 USING (w) JOIN fd USING (w))",
        ]
    )


SPACE_COLUMNS = ("kp_now", "kp_lag3h", "kp_lag6h", "kp_lag12h", "kp_lag24h", "kp_lag48h", "bz_gsm_now", "solar_wind_speed_now", "dst_now", "f107_daily", "f107_smoothed_27d")
_space_out = "SELECT CAST(epoch(w) AS BIGINT) AS window_s, " + ", ".join(f"round({c}, 6) AS {c}" for c in SPACE_COLUMNS) + " FROM space"

_bands = " UNION ALL ".join(f"SELECT '{b}' AS band, '{BANDS[j]}' AS other" for i, b in enumerate(BANDS) for j in (i - 1, i + 1) if 0 <= j < len(BANDS))
_f = "chr(CAST(65 + x AS INT)) || chr(CAST(65 + y AS INT))"
NEIGHBORS = f"""
fields AS (SELECT x, y, {_f} AS f FROM (SELECT unnest(range(18)) AS x), (SELECT unnest(range(18)) AS y)),
near AS (SELECT a.f AS rx_field, b.f AS other FROM fields a JOIN fields b ON a.f <> b.f AND abs(a.y - b.y) <= 1 AND ((a.x - b.x + 18) % 18 IN (0, 1, 17))),
bandmap AS ({_bands})"""
HIST = "hist AS (SELECT w, tx_field, rx_field, band, n_spots AS n, n_spots * coalesce(snr, 0) AS num, CASE WHEN snr IS NOT NULL THEN n_spots ELSE 0 END AS den FROM lab)"


def history(relation: str, anchors: str, horizon_s: int = 0, source: str = "hist", keys: str = "h.tx_field = a.tx AND h.rx_field = a.rx AND h.band = a.b", more: str = "") -> str:
    """A range join of anchors (cell and the path that they ask about) with history rows."""
    sums = ", ".join(
        f"CAST(coalesce(sum(h.n) FILTER (WHERE h.w >= a.t - INTERVAL {lb}), 0) AS BIGINT) AS n_{k}, sum(h.num) FILTER (WHERE h.w >= a.t - INTERVAL {lb}) AS num_{k}, sum(h.den) FILTER (WHERE h.w >= a.t - INTERVAL {lb}) AS den_{k}"
        for k, lb in (("1h", "1 HOUR"), ("3h", "3 HOUR"), ("24h", "24 HOUR"))
    )
    out = f"CAST(0 AS BIGINT) AS {relation}_n_15m, " + ", ".join(f"n_{k} AS {relation}_n_{k}" for k in ("1h", "3h", "24h"))
    out += f", CAST(NULL AS DOUBLE) AS {relation}_snr_15m, " + ", ".join(f"CASE WHEN den_{k} > 0 THEN round(num_{k} / den_{k}, 6) END AS {relation}_snr_{k}" for k in ("1h", "3h", "24h"))
    return (
        upto(*TO_LABELS, NEIGHBORS, HIST, f"anc AS (SELECT w, tx_field, rx_field, band, w - to_seconds({horizon_s}) AS t, {anchors}), "
        f"agg AS (SELECT a.w, a.tx_field, a.rx_field, a.band, {sums} FROM anc a LEFT JOIN {source} h ON {keys} AND h.w >= a.t - INTERVAL 24 HOUR AND h.w <= a.t - INTERVAL 20 MINUTE GROUP BY a.w, a.tx_field, a.rx_field, a.band)")
        + f"SELECT {CELL}, {out}{more} FROM agg"
    )


def yesterday(horizon_s: int) -> str:
    return f", (SELECT l.open FROM lab l WHERE l.w = agg.w - to_seconds({86400 + horizon_s}) AND l.tx_field = agg.tx_field AND l.rx_field = agg.rx_field AND l.band = agg.band) AS same_hour_yesterday_open"


RELATIONS = {
    "same_cell": ("tx_field AS tx, rx_field AS rx, band AS b FROM lab", "hist", "h.tx_field = a.tx AND h.rx_field = a.rx AND h.band = a.b"),
    "reverse_path": ("rx_field AS tx, tx_field AS rx, band AS b FROM lab", "hist", "h.tx_field = a.tx AND h.rx_field = a.rx AND h.band = a.b"),
    "adjacent_band": ("tx_field AS tx, rx_field AS rx, other AS b FROM lab JOIN bandmap USING (band)", "hist", "h.tx_field = a.tx AND h.rx_field = a.rx AND h.band = a.b"),
    "adjacent_cell": ("tx_field AS tx, other AS rx, band AS b FROM lab JOIN near USING (rx_field)", "hist", "h.tx_field = a.tx AND h.rx_field = a.rx AND h.band = a.b"),
    "band_wide": ("band AS b FROM lab", "(SELECT w, band, sum(n_spots) AS n, sum(n_spots) * coalesce(avg(snr), 0) AS num, CASE WHEN avg(snr) IS NOT NULL THEN sum(n_spots) ELSE 0 END AS den FROM lab GROUP BY w, band)", "h.band = a.b"),
}


def matrix(horizon_s: int) -> str:
    """All features of the evaluation rows, by range joins; then count, known values and mean of each."""
    parts, cols, joins = [], [], []
    for relation, (anchors, source, keys) in RELATIONS.items():
        sums = ", ".join(
            f"CAST(coalesce(sum(h.n) FILTER (WHERE h.w >= a.t - INTERVAL {lb}), 0) AS DOUBLE) AS {relation}_n_{k}, sum(h.num) FILTER (WHERE h.w >= a.t - INTERVAL {lb}) / nullif(sum(h.den) FILTER (WHERE h.w >= a.t - INTERVAL {lb}), 0) AS {relation}_snr_{k}"
            for k, lb in (("1h", "1 HOUR"), ("3h", "3 HOUR"), ("24h", "24 HOUR"))
        )
        parts.append(f"anc_{relation} AS (SELECT w, tx_field, rx_field, band, w - to_seconds({horizon_s}) AS t, {anchors} WHERE w >= {EVAL_START})")
        parts.append(f"agg_{relation} AS (SELECT a.w, a.tx_field, a.rx_field, a.band, 0.0::DOUBLE AS {relation}_n_15m, CAST(NULL AS DOUBLE) AS {relation}_snr_15m, {sums} FROM anc_{relation} a LEFT JOIN {source} h ON {keys} AND h.w >= a.t - INTERVAL 24 HOUR AND h.w <= a.t - INTERVAL 20 MINUTE GROUP BY a.w, a.tx_field, a.rx_field, a.band)")
        joins.append(f"LEFT JOIN agg_{relation} USING (w, tx_field, rx_field, band)")
        cols += [f"{relation}_{c}_{lb}" for c in ("n", "snr") for lb in ("15m", "1h", "3h", "24h")]
    named = {
        "hour_sin": "sin(2 * pi() * hour(w) / 24)", "hour_cos": "cos(2 * pi() * hour(w) / 24)", "doy_sin": "sin(2 * pi() * dayofyear(w) / 365)", "doy_cos": "cos(2 * pi() * dayofyear(w) / 365)", "month": "month(w)",
        "band_ordinal": f"list_position([{_list(BANDS)}], band) - 1", "distance_km": "d", "bearing_deg": "brg", "midpoint_lat": "geo.mlat", "midpoint_lon": "geo.mlon", "tx_control_lat": "geo.xlat", "tx_control_lon": "geo.xlon",
        "rx_control_lat": "geo.rlat", "rx_control_lon": "geo.rlon", "tx_geomag_lat": dipole("a", "b"), "rx_geomag_lat": dipole("c", "e"), "midpoint_geomag_lat": dipole("geo.mlat", "geo.mlon"),
        "midpoint_solar_zenith": "mz", "tx_control_solar_zenith": "xz", "rx_control_solar_zenith": "rz", "path_daylight_fraction": "((mz < 90)::INT + (xz < 90)::INT + (rz < 90)::INT) / 3.0::DOUBLE", "midpoint_hours_since_terminator": "hrs",
        **{c: c for c in (*SPACE_COLUMNS, *cols)}, "same_hour_yesterday_open": "y.open",
    }
    body = (
        f"m AS MATERIALIZED (SELECT {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in named.items())} FROM (SELECT * FROM lab WHERE w >= {EVAL_START}) late JOIN geo USING (tx_field, rx_field) JOIN sun USING (w, tx_field, rx_field)"
        f" JOIN edge ON sun.t = edge.t AND sun.mlat = edge.mlat AND sun.mlon = edge.mlon JOIN space USING (w) {' '.join(joins)}"
        f" LEFT JOIN (SELECT w + to_seconds({86400 + horizon_s}) AS w, tx_field, rx_field, band, open FROM lab) y USING (w, tx_field, rx_field, band))"
    )
    each = " UNION ALL ".join(f"SELECT '{k}' AS feature, count(*) AS n, count({k}) AS n_known, round(avg({k}), 6) + 0.0 AS mean FROM m" for k in named)
    return upto(*TO_LABELS, GEO, SUN, EDGE, space(horizon_s), NEIGHBORS, HIST, *parts, body) + each


def matrices() -> str:
    """The same for each horizon."""
    return " UNION ALL ".join(f"SELECT CAST({h} AS DOUBLE) AS horizon_hours, * FROM ({matrix(h * 3600)})" for h in HORIZONS_H)


LIVE = """
live AS (SELECT 'pskreporter' AS source, ts, lower(trim(band)) AS band, upper(trim(mode)) AS mode, upper(trim(dx_call)) AS dx_call, upper(trim(de_call)) AS de_call, dx_grid, de_grid, NULL::DOUBLE AS dx_lat, NULL::DOUBLE AS dx_lon,
  NULL::DOUBLE AS de_lat, NULL::DOUBLE AS de_lon, snr_db, NULL AS tx_dbm FROM spots WHERE ts IS NOT NULL AND snr_db IS NOT NULL AND coalesce(dx_call, '') <> '' AND coalesce(de_call, '') <> '' AND coalesce(mode, '') <> '' AND coalesce(band, '') <> '')"""
_mhz = "CASE band " + " ".join(f"WHEN '{b}' THEN {f}::DOUBLE" for b, f in DIAL_MHZ.items()) + " END"

CLIM = f"""
train AS (SELECT *, hour(w) AS hr FROM lab WHERE w < {TRAIN_END}), late AS (SELECT *, hour(w) AS hr FROM lab WHERE w >= {EVAL_START}),
rate AS (SELECT tx_field, rx_field, band, hr, CAST(sum(open) AS DOUBLE) / count(*) AS p, count(*) AS n FROM train GROUP BY ALL),
pred AS (SELECT late.*, coalesce(rate.p, (SELECT CAST(sum(open) AS DOUBLE) / count(*) FROM train)) AS p FROM late LEFT JOIN rate USING (tx_field, rx_field, band, hr))"""
TO_PRED = (*TO_LABELS, CLIM)
SCORE = "round(avg((p - open) * (p - open)), 6) AS brier, round(-avg(open * ln(greatest(least(p, 1 - 1e-12), 1e-12)) + (1 - open) * ln(1 - greatest(least(p, 1 - 1e-12), 1e-12))), 6) AS log_loss, count(*) AS n"


def check(number: int, name: str, value: str, enough: str, passes: str, source: str) -> str:
    return f"SELECT {number} AS check_id, '{name}' AS name, CASE WHEN v IS NULL THEN 'insufficient_data' WHEN {passes} THEN 'pass' ELSE 'fail' END AS status, round(v, 6) AS value FROM (SELECT CASE WHEN {enough} THEN CAST({value} AS DOUBLE) END AS v FROM ({source}))"


_midlon = "(((b + ((((e - b + 540) % 360.0) + 360.0) % 360.0 - 180) / 2 + 540) % 360.0 + 360.0) % 360.0 - 180)"
_local = f"(((hour(w) + {_midlon} / 15) % 24.0 + 24.0) % 24.0)"
_rates = f"SELECT avg(open) FILTER (WHERE lt BETWEEN 12 AND 17) AS day, avg(open) FILTER (WHERE lt >= 22 OR lt <= 3) AS night FROM (SELECT open, {_local} AS lt FROM lab JOIN geo USING (tx_field, rx_field) WHERE "
FULL = (*TO_LABELS, GEO, SUN, EDGE, space(0))

SQL: dict[str, str] = {
    "spots_adapter": upto() + f"SELECT {SPOT_OUT} FROM spots",
    "hygiene_rejects": upto(JUDGED) + "SELECT coalesce(reason, 'qualifying') AS reason, count(*) AS n FROM judged GROUP BY 1",
    "qualifying_spots": upto(JUDGED) + f"SELECT {SPOT_OUT} FROM good",
    "deduplicated_spots": upto(JUDGED, CLEAN) + f"SELECT {SPOT_OUT} FROM clean",
    "dedup_without_source_rank": upto(JUDGED, ranked(False)) + f"SELECT {SPOT_OUT} FROM clean",
    "source_totals": upto(JUDGED, CLEAN) + "SELECT source, count(*) AS n FROM clean GROUP BY 1",
    "receiver_uptime_windows": upto(JUDGED, CLEAN, UPTIME) + "SELECT CAST(epoch(w) AS BIGINT) AS window_s, de_call, band, mc AS mode_class, n AS n_evidence_reports, CAST(epoch(first_report) AS BIGINT) AS first_report, CAST(epoch(last_report) AS BIGINT) AS last_report, substr(grid, 1, 2) AS de_field, CASE WHEN length(grid) = 4 THEN grid END AS de_grid4 FROM uptime",
    "transmit_windows": upto(JUDGED, CLEAN, TX) + "SELECT CAST(epoch(w) AS BIGINT) AS window_s, tx_field, band, mc AS mode_class, n AS n_evidence_reports, tier AS evidence_tier FROM tx",
    "universe": upto(*TO_LABELS[:-1]) + f"SELECT {CELL}, n_spots, CAST(is_positive AS INT) AS is_positive, CAST(is_n_eligible AS INT) AS is_n_eligible, n_monitors, n_tx_stations, evidence_tier FROM uni",
    "labels": upto(*TO_LABELS) + f"SELECT {CELL}, open, n_spots, n_monitors, n_tx_stations, evidence_tier, round(snr, 6) AS snr_ft8eq_p50 FROM lab",
    "unlabeled_fraction": upto(*TO_LABELS[:-1])
    + """SELECT band, CAST(CAST(w AS DATE) AS VARCHAR) AS date, count(*) AS n_candidates, any_value(u) AS n_universe, round(1 - CAST(any_value(u) AS DOUBLE) / count(*), 6) AS unlabeled_fraction FROM (
  SELECT DISTINCT x.w, x.band, x.f, y.f AS g FROM (SELECT w, band, tx_field AS f FROM fielded UNION SELECT w, band, rx_field FROM fielded) x JOIN (SELECT w, band, tx_field AS f FROM fielded UNION SELECT w, band, rx_field FROM fielded) y USING (w, band))
LEFT JOIN (SELECT band, CAST(w AS DATE) AS d, count(*) AS u FROM uni GROUP BY ALL) n USING (band) WHERE n.d = CAST(w AS DATE) GROUP BY 1, 2""",
    "snr_by_mode": upto(JUDGED, CLEAN) + f"SELECT band, mode, count(*) AS n, count({SNR}) AS n_snr, round(median(CAST({SNR} AS DOUBLE)), 6) AS median_snr FROM clean GROUP BY 1, 2",
    "stratified_sample": upto(*TO_LABELS)
    + f"""SELECT window_s, tx_field, rx_field, band, open, round(CASE WHEN open = 0 AND k < nn THEN CAST(nn AS DOUBLE) / k ELSE 1.0 END, 6) AS sample_weight FROM (
  SELECT {CELL}, open, np, nn, CASE WHEN np > 0 THEN least(CAST(floor(np * 0.25) AS BIGINT), nn) ELSE nn END AS k, row_number() OVER (PARTITION BY band, d, open ORDER BY o, w, tx_field, rx_field) AS r FROM (
    SELECT *, CAST(w AS DATE) AS d, sum(open) OVER (PARTITION BY band, CAST(w AS DATE)) AS np, sum(1 - open) OVER (PARTITION BY band, CAST(w AS DATE)) AS nn,
      sha256(CAST(CAST('0x' || substr(sha256(band || '|' || CAST(CAST(w AS DATE) AS VARCHAR)), 1, 8) AS BIGINT) AS VARCHAR) || '|' || strftime(w, '%Y-%m-%dT%H:%M:%S') || '|' || tx_field || '|' || rx_field || '|' || band) AS o FROM lab))
WHERE open = 1 OR r <= k""",
    "geo_features": upto(*TO_LABELS, GEO)
    + f"SELECT tx_field, rx_field, round(d, 6) AS distance_km, round(brg, 6) AS bearing_deg, round(mlat, 6) AS midpoint_lat, round(mlon, 6) AS midpoint_lon, round(xlat, 6) AS tx_control_lat, round(xlon, 6) AS tx_control_lon, round(rlat, 6) AS rx_control_lat, round(rlon, 6) AS rx_control_lon, round({dipole('a', 'b')}, 6) AS tx_geomag_lat, round({dipole('c', 'e')}, 6) AS rx_geomag_lat, round({dipole('mlat', 'mlon')}, 6) AS midpoint_geomag_lat FROM geo",
    "solar_features": upto(*TO_LABELS, GEO, SUN) + "SELECT t AS window_s, tx_field, rx_field, round(mz, 5) AS midpoint_solar_zenith, round(xz, 5) AS tx_control_solar_zenith, round(rz, 5) AS rx_control_solar_zenith, round(((mz < 90)::INT + (xz < 90)::INT + (rz < 90)::INT) / 3.0::DOUBLE, 5) AS path_daylight_fraction FROM sun",
    "hours_since_terminator": upto(*TO_LABELS, GEO, SUN, EDGE) + "SELECT sun.t AS window_s, tx_field, rx_field, hrs AS midpoint_hours_since_terminator FROM sun JOIN edge ON sun.t = edge.t AND sun.mlat = edge.mlat AND sun.mlon = edge.mlon",
    "time_band_features": upto(*TO_LABELS)
    + f"SELECT DISTINCT CAST(epoch(w) AS BIGINT) AS window_s, band, round(sin(2 * pi() * hour(w) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(w) / 24), 6) + 0.0 AS hour_cos, round(sin(2 * pi() * dayofyear(w) / 365), 6) + 0.0 AS doy_sin, round(cos(2 * pi() * dayofyear(w) / 365), 6) + 0.0 AS doy_cos, month(w) AS month, CAST(list_position([{_list(BANDS)}], band) - 1 AS BIGINT) AS band_ordinal FROM lab",
    "spaceweather_features": upto(*TO_LABELS, space(0)) + _space_out,
    "spaceweather_features_h6": upto(*TO_LABELS, space(21600)) + _space_out,
    "history_same_cell": history("same_cell", "tx_field AS tx, rx_field AS rx, band AS b FROM lab"),
    "history_reverse": history("reverse_path", "rx_field AS tx, tx_field AS rx, band AS b FROM lab"),
    "history_adjacent_band": history("adjacent_band", "tx_field AS tx, rx_field AS rx, other AS b FROM lab JOIN bandmap USING (band)"),
    "history_adjacent_cell": history("adjacent_cell", "tx_field AS tx, other AS rx, band AS b FROM lab JOIN near USING (rx_field)"),
    "history_band_wide": history("band_wide", "band AS b FROM lab", source="(SELECT w, band, sum(n_spots) AS n, sum(n_spots) * coalesce(avg(snr), 0) AS num, CASE WHEN avg(snr) IS NOT NULL THEN sum(n_spots) ELSE 0 END AS den FROM lab GROUP BY w, band)", keys="h.band = a.b"),
    "history_yesterday": upto(*TO_LABELS) + f"SELECT {CELL}{yesterday(0)} FROM lab agg",
    "history_h6": history("same_cell", "tx_field AS tx, rx_field AS rx, band AS b FROM lab", 21600, more=yesterday(21600)),
    "open_rate_by_hour": upto(*TO_LABELS[:-1]) + "SELECT band, hour(w) AS hour, count(*) AS n_cells, CAST(sum(is_positive::INT) AS BIGINT) AS n_open, round(CAST(sum(is_positive::INT) AS DOUBLE) / count(*), 6) AS open_rate FROM uni GROUP BY 1, 2",
    "climatology_fit": upto(*TO_PRED) + "SELECT tx_field, rx_field, band, hr AS hour, round(p, 6) AS p, n FROM rate",
    "climatology_predict": upto(*TO_PRED) + f"SELECT {CELL}, open, round(p, 6) AS p_open FROM pred",
    "brier_logloss": upto(*TO_PRED) + f"SELECT band, {SCORE} FROM pred GROUP BY band",
    "reliability_bins": upto(*TO_PRED)
    + f"SELECT bin, coalesce(n, 0) AS n, mean_p, mean_y FROM (SELECT unnest(range(10)) AS bin) LEFT JOIN (SELECT {' + '.join(f'(p > CAST({k} AS DOUBLE) * CAST(0.1 AS DOUBLE))::INT' for k in range(1, 10))} AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(open), 6) AS mean_y FROM pred GROUP BY 1) USING (bin)",
    "pr_auc": upto(*TO_PRED)
    + "SELECT round(sum(pos * CAST(tp AS DOUBLE) / al) / sum(pos), 6) AS average_precision, CAST(sum(pos) AS BIGINT) AS n_pos FROM (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS al FROM (SELECT p, sum(open) AS pos, count(*) AS n FROM pred GROUP BY p))",
    "storm_slices": upto(*TO_PRED, HOURLY_SQL)
    + f"""SELECT 'climatology' AS model, slice, {SCORE} FROM (SELECT pred.*, coalesce(kp >= 5, false) AS storm, unnest(['overall', CASE WHEN coalesce(kp >= 5, false) THEN 'storm' ELSE 'quiet' END]) AS slice FROM pred
LEFT JOIN (SELECT time_bucket(INTERVAL 3 HOUR, time) AS b, max(kp) AS kp FROM hourly WHERE kp IS NOT NULL GROUP BY 1) k ON k.b = time_bucket(INTERVAL 3 HOUR, w)) GROUP BY slice""",
    "band_group_slices": upto(*TO_PRED) + f"SELECT CASE {' '.join(f'WHEN band IN ({_list(bs)}) THEN {chr(39)}{g}{chr(39)}' for g, bs in BAND_GROUPS.items())} END AS band_group, {SCORE} FROM pred GROUP BY 1",
    "band_group_horizons": upto(*TO_PRED) + f"SELECT CAST(hz AS DOUBLE) AS horizon_hours, 'climatology' AS model, CASE {' '.join(f'WHEN band IN ({_list(bs)}) THEN {chr(39)}{g}{chr(39)}' for g, bs in BAND_GROUPS.items())} END AS band_group, {SCORE} FROM pred, (SELECT unnest([{', '.join(map(str, HORIZONS_H))}]) AS hz) GROUP BY ALL",
    "storm_periods": upto(*TO_LABELS)
    + "SELECT CASE WHEN w < TIMESTAMP '2024-05-02 06:00:00' THEN 'before' WHEN w < TIMESTAMP '2024-05-03 00:00:00' THEN 'during' ELSE 'after' END AS period, band, count(*) AS n, round(avg(open), 6) AS open_rate FROM lab WHERE w >= TIMESTAMP '2024-05-01 06:00:00' AND w < TIMESTAMP '2024-05-04 00:00:00' GROUP BY 1, 2",
    "hourly_timeline": upto(*TO_PRED) + "SELECT CAST(epoch(date_trunc('hour', w)) AS BIGINT) AS hour, round(avg(open), 6) AS open_rate, round(avg(p), 6) AS mean_p, count(*) AS n FROM pred GROUP BY 1",
    "qa_diurnal": upto(*TO_LABELS, GEO) + check(1, "20m_diurnal", "day / night", "night > 0", "v > 2", _rates + "band = '20m' AND d BETWEEN 3000 AND 8000)"),
    "qa_lowband": upto(*TO_LABELS, GEO) + check(2, "lowband_diurnal", "night / day", "day > 0", "v > 5", _rates + "band IN ('160m', '80m') AND d > 2000)"),
    "qa_grayline": upto(*FULL)
    + check(3, "grayline_40m", "edge - noon", "edge IS NOT NULL AND noon IS NOT NULL", "v > 0", "SELECT avg(open) FILTER (WHERE abs(hrs) <= 1) AS edge, avg(open) FILTER (WHERE mz <= 30) AS noon FROM lab JOIN geo USING (tx_field, rx_field) JOIN sun USING (w, tx_field, rx_field) JOIN edge ON sun.t = edge.t AND sun.mlat = edge.mlat AND sun.mlon = edge.mlon WHERE band = '40m' AND d > 6000"),
    "qa_sporadic_e": upto(*TO_LABELS, GEO) + check(4, "sporadic_e_seasonal", "s / z", "z > 0", "v >= 3", "SELECT avg(open) FILTER (WHERE month(w) IN (5, 6, 7)) AS s, avg(open) FILTER (WHERE month(w) IN (11, 12, 1)) AS z FROM lab JOIN geo USING (tx_field, rx_field) WHERE band = '6m' AND d BETWEEN 1000 AND 2300"),
    "qa_reciprocity": upto(*TO_LABELS, "r AS (SELECT tx_field, rx_field, band, month(w) AS m, avg(open) AS o FROM lab GROUP BY ALL)")
    + check(5, "reciprocity", "r", "n >= 5", "v > 0.6", "SELECT corr(x.o, y.o) AS r, count(*) AS n FROM r x JOIN r y ON x.tx_field = y.rx_field AND x.rx_field = y.tx_field AND x.band = y.band AND x.m = y.m").replace("round(v, 6)", "round(v, 5)"),
    "qa_solar_cycle": upto(*TO_LABELS, GEO, space(0))
    + check(6, "solar_cycle", "r", "n >= 12", "v > 0.5", "SELECT corr(o, f) AS r, count(*) AS n FROM (SELECT date_trunc('month', w) AS m, avg(open) AS o, avg(f107_daily) AS f FROM lab JOIN geo USING (tx_field, rx_field) JOIN space USING (w) WHERE band = '10m' AND d > 6000 GROUP BY 1)"),
    "qa_storm": upto(*TO_LABELS, GEO, space(0))
    + check(7, "storm_response", "ratio", "ratio IS NOT NULL", "v <= 0.5", f"SELECT avg(s / q) AS ratio FROM (SELECT band, hour(w) AS h, month(w) AS m, avg(open) FILTER (WHERE kp_now >= 6) AS s, avg(open) FILTER (WHERE kp_now <= 2) AS q FROM lab JOIN geo USING (tx_field, rx_field) JOIN space USING (w) WHERE abs({dipole('mlat', 'mlon')}) > 60 GROUP BY ALL) WHERE s IS NOT NULL AND q > 0"),
    "qa_volume": upto(JUDGED) + check(8, "volume_hygiene", "x", "true", "v < 0.005", "SELECT CAST(count(*) FILTER (WHERE reason = 'rr73_grid') AS DOUBLE) / count(*) AS x FROM judged"),
    "coverage_antijoin": upto(*TO_LABELS, "pr AS (SELECT w, tx_field, CASE WHEN rx_field = 'DN' THEN 'ZZ' ELSE rx_field END AS rx_field, band FROM lab WHERE band <> '17m')")
    + "SELECT 'missing' AS kind, count(*) AS n FROM lab ANTI JOIN pr USING (w, tx_field, rx_field, band) UNION ALL SELECT 'extra', count(*) FROM pr ANTI JOIN lab USING (w, tx_field, rx_field, band)",
    "cohort_digest": upto(*TO_LABELS, "ln AS (SELECT strftime(w, '%Y-%m-%dT%H') AS b, strftime(w, '%Y-%m-%dT%H:%M:%S') || ',' || tx_field || ',' || rx_field || ',' || band || ',' || open AS line FROM lab)")
    + "SELECT sha256(string_agg(b || ' ' || h, chr(10) ORDER BY b)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM (SELECT b, sha256(string_agg(s || h, chr(10) ORDER BY s)) AS h, sum(n) AS n FROM (SELECT b, substr(sha256(line), 1, 2) AS s, sha256(string_agg(line, chr(10) ORDER BY line)) AS h, count(*) AS n FROM ln GROUP BY ALL) GROUP BY b)",
    "bcr_closed_form": upto(JUDGED, CLEAN)
    + """SELECT dx_call, de_call, band, mode, ts, round(snr, 6) AS snr, round(CASE WHEN snr >= 20 THEN least(130 - 80 / (1 + (snr - 20) / dl), 100.0) ELSE greatest(80 / (1 + (20 - snr) / du) - 30, 0.0) END, 6) AS bcr FROM (
  SELECT *, pr - 120 - 10 * log10(x) - 10 * log10(2500.0::DOUBLE) + 204 AS snr, sqrt(pow(10 * log10(lo / x), 2) + 64.0 + 25.0) AS du, sqrt(pow(10 * log10(hi / x), 2) + 121.0 + 64.0) AS dl FROM (
    SELECT dx_call, de_call, band, mode, CAST(epoch(ts) AS BIGINT) AS ts, CAST(snr_db AS DOUBLE) AS pr, pow(10.0::DOUBLE, 2.0) + pow(10.0::DOUBLE, (40 + CAST(snr_db AS DOUBLE) / 10) / 10) + pow(10.0::DOUBLE, 1.5) AS x,
      pow(10.0::DOUBLE, 1.4) + pow(10.0::DOUBLE, (34 + CAST(snr_db AS DOUBLE) / 10) / 10) + pow(10.0::DOUBLE, 0.9) AS lo, pow(10.0::DOUBLE, 2.9) + pow(10.0::DOUBLE, (49 + CAST(snr_db AS DOUBLE) / 10) / 10) + pow(10.0::DOUBLE, 2.4) AS hi FROM clean WHERE snr_db IS NOT NULL))""",
    "prediction_surface": upto(*TO_LABELS, "rt AS (SELECT tx_field, rx_field, band, hour(w) AS hr, CAST(sum(open) AS DOUBLE) / count(*) AS p FROM lab GROUP BY ALL), ov AS (SELECT CAST(sum(open) AS DOUBLE) / count(*) AS p FROM lab)")
    + f"""SELECT tx_field, rx_field, band, string_agg(CAST(CAST(round(coalesce(rt.p, ov.p) * 100) AS INT) AS VARCHAR), ',' ORDER BY h) AS p_open_pct, CASE WHEN max(n_monitors) >= 4 THEN 'high' WHEN max(n_monitors) >= 1 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT l.*, h, (hour(w) + h) % 24 AS hr FROM lab l, (SELECT unnest([0, 1, 3]) AS h) WHERE w = {EVAL_START}) x LEFT JOIN rt USING (tx_field, rx_field, band, hr) CROSS JOIN ov GROUP BY 1, 2, 3""",
    "lake_roundtrip": upto(JUDGED, CLEAN) + "SELECT band, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n, count(DISTINCT dx_call) AS n_calls FROM clean GROUP BY 1, 2",
    "feature_matrix": matrix(10800),
    "feature_matrix_horizons": matrices(),
    "stream_hourly_upsert": upto(LIVE, JUDGED.replace("FROM spots", "FROM live"))
    + "SELECT CAST(epoch(date_trunc('hour', w)) AS BIGINT) AS hour, count(*) AS n, CAST(sum(s) AS BIGINT) AS snr_sum FROM (SELECT dx_call, de_call, band, mode, time_bucket(INTERVAL 15 MINUTE, ts) AS w, max(snr_db) AS s FROM good GROUP BY ALL) GROUP BY 1",
    "p533_keyed_score": upto(*TO_LABELS, GEO)
    + f"""SELECT band, count(*) AS n, count(p) AS n_scored, round(avg(p), 6) AS mean_p FROM (
  SELECT band, (CASE WHEN mg >= 0 THEN least(130 - 80 / (1 + mg / sqrt(128.0::DOUBLE)), 100) ELSE greatest(80 / (1 - mg / sqrt(89.0::DOUBLE)) - 30, 0) END) / 100 AS p FROM (
    SELECT band, 20 - (32.45::DOUBLE + 20 * log10(greatest(d, 1) * f) + 40 * greatest(0, cos(2 * pi() * (hour(w) - 12) / 24)) * pow(7 / f, 2))
      - 10 * log10(pow(10, (52 - 23 * log10(f)) / 10) + pow(10, (67.2::DOUBLE - 27.7::DOUBLE * log10(f)) / 10) + pow(10, (40 - f + 7) / 10)) - 10 * log10(2500) + 204 - 20 AS mg
    FROM (SELECT *, {_mhz} AS f FROM lab JOIN geo USING (tx_field, rx_field)) WHERE f BETWEEN 1 AND 30)) GROUP BY band""",
    "storm_block": upto(*TO_LABELS, HOURLY_SQL)
    + f"""SELECT CAST(epoch(b) AS BIGINT) AS block_s, round(kp, 6) AS kp FROM (SELECT time_bucket(INTERVAL 3 HOUR, time) AS b, max(kp) AS kp FROM hourly WHERE kp IS NOT NULL GROUP BY 1)
WHERE kp >= 5 AND b IN (SELECT time_bucket(INTERVAL 3 HOUR, w) FROM lab WHERE w >= {EVAL_START}) ORDER BY kp DESC, b LIMIT 1""",
}
