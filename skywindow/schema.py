"""The spot schema and fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
BANDS = ("160m", "80m", "60m", "40m", "30m", "20m", "17m", "15m", "12m", "10m", "6m")
BAND_GROUPS = {"low": ("160m", "80m", "60m", "40m"), "mid": ("30m", "20m", "17m", "15m"), "high": ("12m", "10m", "6m")}
WSPR_BAND_CODES = {1: "160m", 3: "80m", 5: "60m", 7: "40m", 10: "30m", 14: "20m", 18: "17m", 21: "15m", 24: "12m", 28: "10m", 50: "6m"}
SOURCE_RANK = {"wsprnet": 0, "rbn": 1, "pskreporter": 2, "cqdx": 3}
OTHER_RANK = 99
DIGITAL_MODES = ("FT8", "FT4", "WSPR", "FST4", "FST4W", "JS8", "JT65", "JT9", "Q65", "MSK144")
CW_MODES = ("CW", "RTTY")
FT8_LEVEL_MODES = tuple(m for m in DIGITAL_MODES if m != "MSK144")
CW_OFFSET_DB = -7
FULL_POWER_DBM = 50
CALLSIGN = r"^[A-Z0-9]{1,3}[0-9][A-Z0-9]{0,3}[A-Z](/[A-Z0-9]{1,4})?$"
GRID4, FIELD = r"^[A-R]{2}[0-9]{2}$", r"^[A-R]{2}$"
LEAST_PATH_KM = 25.0
EARTH_KM = 6371.0088
GEOMAG_POLE = (80.65, -72.68)
WINDOW_S, PAD_BEFORE_S, PAD_AFTER_S = 900, 1800, 2700
AVAILABLE_S = 1200
LOOKBACKS = {"15m": 900, "1h": 3600, "3h": 10800, "24h": 86400}
HORIZONS_H = (0, 1, 3, 6, 12, 24)
NEGATIVES_PER_POSITIVE = 3.0
STORM_KP = 5.0
DIAL_MHZ = {"160m": 1.840, "80m": 3.573, "60m": 5.357, "40m": 7.074, "30m": 10.136, "20m": 14.074, "17m": 18.100, "15m": 21.074, "12m": 24.915, "10m": 28.074, "6m": 50.313}
LOG_LOSS_CLIP = 1e-12

SPOT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("source",)]
    + [T.StructField("ts", T.TimestampType())]
    + [T.StructField(n, T.StringType()) for n in ("band", "mode")]
    + [T.StructField("freq_hz", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("dx_call", "de_call", "dx_grid", "de_grid", "dx_field", "de_field")]
    + [T.StructField(n, T.DoubleType()) for n in ("dx_lat", "dx_lon", "de_lat", "de_lon")]
    + [T.StructField(n, T.ShortType()) for n in ("snr_db", "tx_dbm")]
)
CELL = ["window_start", "tx_field", "rx_field", "band"]


def as_spots(df: DataFrame, *more: str) -> DataFrame:
    """The spot columns in order and type, and ``more``: missing ones null, others dropped, band lower and mode upper case."""
    have = set(df.columns)
    cols = {f.name: (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType) for f in SPOT.fields}
    cols["band"], cols["mode"] = F.lower(cols["band"]), F.upper(cols["mode"])
    return df.select(*[c.alias(n) for n, c in cols.items()], *more)


def union_spots(*frames: DataFrame) -> DataFrame:
    """All rows of several sources, by column name."""
    out = as_spots(frames[0])
    for f in frames[1:]:
        out = out.unionByName(as_spots(f))
    return out


def window_start(ts: Column) -> Column:
    """The 15-minute window, aligned to UTC, that ``ts`` falls in."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / WINDOW_S) * WINDOW_S)


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
