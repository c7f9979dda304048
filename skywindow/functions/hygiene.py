"""Which spots qualify: one ordered cascade of reasons, first match wins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BANDS, CALLSIGN, CW_MODES, DIGITAL_MODES, EARTH_KM, LEAST_PATH_KM
from .geo import grid_lat, grid_lon, great_circle_km, normal_grid

#: The reasons of ``judged``, in their order.
REASONS = ("missing_required_field", "unsupported_band", "invalid_callsign", "mm_am_suffix", "self_spot", "rr73_grid", "no_usable_location", "distance_too_short")

#: Twice what the least distance is in degrees of latitude: ends further apart than that in latitude are not too near.
NEAR_DEG = 2 * math.degrees(LEAST_PATH_KM / EARTH_KM)


def mode_class(mode: Column) -> Column:
    m = F.upper(F.trim(mode))
    return F.when(m.isin(*DIGITAL_MODES), "digi").when(m.isin(*CW_MODES), "cw").otherwise("other")


def is_rr73(grid: Column) -> Column:
    return F.coalesce(F.substring(F.upper(F.trim(grid)), 1, 4) == "RR73", F.lit(False))


def bare_call(call: Column) -> Column:
    """Upper case, without one leading ``<`` and one trailing ``>``."""
    c = F.upper(F.trim(call))
    return F.when(c.contains("<") | c.contains(">"), F.regexp_replace(c, "^<|>$", "")).otherwise(c)


def base_call(call: Column) -> Column:
    return F.substring_index(bare_call(call), "/", 1)


def is_valid_call(call: Column) -> Column:
    return F.coalesce(bare_call(call).rlike(CALLSIGN), F.lit(False))


def is_mobile(call: Column) -> Column:
    c = bare_call(call)
    return c.endswith("/MM") | c.endswith("/AM")


def without_skimmer(call: Column) -> Column:
    return F.regexp_replace(call, r"-\d+$", "")


def judged(spots: DataFrame) -> DataFrame:
    """Adds ``reject_reason``: null for a spot that qualifies, else the first reason that applies.

    Calls and grids are normalised once, in a struct that is unpacked from an array: unlike a projection, that is not merged
    with the cascade or with a filter on the reason, which would work each of them out again wherever it is named. The
    distance goes from grid centres where there are grids, else from the given places; it is not worked out for latitudes
    that are further apart than the least distance.
    """
    c = F.col
    clean = {"_xg": normal_grid(c("dx_grid")), "_eg": normal_grid(c("de_grid")), "_xc": bare_call(c("dx_call")), "_ec": bare_call(c("de_call"))}
    rows = spots.select("*", F.inline(F.array(F.struct(*[v.alias(n) for n, v in clean.items()]))))
    place = lambda g, lat, lon: (F.coalesce(grid_lat(c(g)), c(lat)), F.coalesce(grid_lon(c(g)), c(lon)))
    missing = lambda n: c(n).isNull() | (c(n) == "")
    valid = lambda n: F.coalesce(c(n).rlike(CALLSIGN), F.lit(False))
    mobile = lambda n: c(n).endswith("/MM") | c(n).endswith("/AM")
    ends = (*place("_xg", "dx_lat", "dx_lon"), *place("_eg", "de_lat", "de_lon"))
    rr73 = lambda n, g: c(g).isNull() & is_rr73(c(n))
    lost = lambda g, lat, lon: c(g).isNull() & (c(lat).isNull() | c(lon).isNull())
    reason = (
        F.when(c("ts").isNull() | missing("band") | missing("mode") | missing("dx_call") | missing("de_call"), "missing_required_field")
        .when(~c("band").isin(*BANDS), "unsupported_band")
        .when(~valid("_xc") | ~valid("_ec"), "invalid_callsign")
        .when(mobile("_xc") | mobile("_ec"), "mm_am_suffix")
        .when(F.substring_index("_xc", "/", 1) == F.substring_index("_ec", "/", 1), "self_spot")
        .when(rr73("dx_grid", "_xg") | rr73("de_grid", "_eg"), "rr73_grid")
        .when(lost("_xg", "dx_lat", "dx_lon") | lost("_eg", "de_lat", "de_lon"), "no_usable_location")
        .when((F.abs(ends[2] - ends[0]) < NEAR_DEG) & (great_circle_km(*ends) < LEAST_PATH_KM), "distance_too_short")
    )
    return rows.select(*[F.col(f"`{n}`") for n in spots.columns], F.inline(F.array(F.struct(reason.alias("reject_reason")))))


def qualifying(spots: DataFrame) -> DataFrame:
    return judged(spots).where("reject_reason is null").drop("reject_reason")


def reject_counts(spots: DataFrame) -> DataFrame:
    """How many spots each reason rejects; qualifying ones count under ``qualifying``."""
    return judged(spots).groupBy(F.coalesce("reject_reason", F.lit("qualifying")).alias("reason")).agg(F.count("*").alias("n"))
