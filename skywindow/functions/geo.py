"""Maidenhead grids, great circles and magnetic latitude, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EARTH_KM, GEOMAG_POLE


def _letter(g: Column, at: int) -> Column:
    return F.ascii(F.substring(g, at, 1)) - 65


def grid_lat(g: Column) -> Column:
    """Latitude of the centre of a field or four-character grid; longer grids count by their first four."""
    return (_letter(g, 2) * 10 - 90 + F.coalesce(F.substring(g, 4, 1).try_cast("int") + 0.5, F.lit(5.0))).cast("double")


def grid_lon(g: Column) -> Column:
    return (_letter(g, 1) * 20 - 180 + F.coalesce(F.substring(g, 3, 1).try_cast("int") * 2 + 1.0, F.lit(10.0))).cast("double")


def grid_of(lat: Column, lon: Column, precision: int = 4) -> Column:
    """The field (2) or grid (4) that holds a place; places beyond the poles or the date line count at the edge."""
    x = F.least(F.greatest(lon + 180, F.lit(0.0)), F.lit(359.999999))
    y = F.least(F.greatest(lat + 90, F.lit(0.0)), F.lit(179.999999))
    out = F.concat(F.chr(F.lit(65) + F.floor(x / 20)), F.chr(F.lit(65) + F.floor(y / 10)))
    if precision == 4:
        out = F.concat(out, F.floor((x % 20) / 2).cast("string"), F.floor(y % 10).cast("string"))
    return F.when(lat.isNotNull() & lon.isNotNull(), out)


def valid_or_null(value: Column, bound: float) -> Column:
    return F.when(~F.isnan(value) & value.between(-bound, bound), value)


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def along(lat1: Column, lon1: Column, lat2: Column, lon2: Column, distance_km: Column, share: Column) -> tuple[Column, Column]:
    """Latitude and longitude at a share of the great circle; a path of no length stays at its start."""
    d = distance_km / EARTH_KM
    a, b = F.sin((1 - share) * d) / F.sin(d), F.sin(share * d) / F.sin(d)
    p1, l1, p2, l2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    x = a * F.cos(p1) * F.cos(l1) + b * F.cos(p2) * F.cos(l2)
    y = a * F.cos(p1) * F.sin(l1) + b * F.cos(p2) * F.sin(l2)
    z = a * F.sin(p1) + b * F.sin(p2)
    here = d <= 0
    return F.when(here, lat1).otherwise(F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))), F.when(here, lon1).otherwise(F.degrees(F.atan2(y, x)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def geomag_lat(lat: Column, lon: Column) -> Column:
    """Latitude in the centred dipole."""
    pole, at = F.radians(F.lit(GEOMAG_POLE[0])), F.radians(lon - GEOMAG_POLE[1])
    s = F.sin(F.radians(lat)) * F.sin(pole) + F.cos(F.radians(lat)) * F.cos(pole) * F.cos(at)
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))))


#: A grid of four characters at the start, or exactly a field; RR73 is a sign-off, not a place.
_GRID = r"^(?!RR73)(?:[A-R]{2}[0-9]{2}|[A-R]{2}\z)"


def normal_grid(g: Column) -> Column:
    """The first four characters, upper case, if they are a grid or exactly a field; RR73 is a sign-off, not a place."""
    whole = F.upper(F.trim(g))
    return F.when(whole.rlike(_GRID), F.substring(whole, 1, 4))
