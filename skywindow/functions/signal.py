"""Signal strengths on one scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CW_MODES, CW_OFFSET_DB, FT8_LEVEL_MODES, FULL_POWER_DBM


def ft8_equivalent(mode: Column, snr: Column, dbm: Column) -> Column:
    """Signal-to-noise ratio as if sent in FT8 at full power; null for modes without a known offset."""
    m = F.upper(F.trim(mode))
    offset = F.when(m.isin(*FT8_LEVEL_MODES), 0).when(m.isin(*CW_MODES), CW_OFFSET_DB)
    return (snr + offset + F.coalesce(FULL_POWER_DBM - dbm, F.lit(0))).cast("double")
