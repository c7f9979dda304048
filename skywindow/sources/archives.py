"""Spot archives: each reader gives spot columns plus ``parse_error`` (null where the record could be read)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import grid_lat, grid_lon, grid_of, normal_grid, valid_or_null
from ..functions.hygiene import REASONS
from ..functions.hygiene import judged as judge
from ..functions.hygiene import qualifying, reject_counts, without_skimmer
from ..operators.dedup import dedup_spots
from ..schema import WSPR_BAND_CODES, as_spots, literal_map
from .listing import ZippedCsv

RBN_COLUMNS = ("callsign", "de_pfx", "de_cont", "freq", "band", "dx", "dx_pfx", "dx_cont", "mode", "db", "date", "speed", "tx_mode")
AUTOMATIC_SOURCES = ("pskreporter", "rbn")
#: What a record's ``parse_error`` can be besides the reasons of hygiene.
PARSE_ERRORS = ("unparsed", "malformed_json", "non_automatic_source", "invalid_timestamp")
ARCHIVE_SCHEMA = "source string, timestamp string, frequency string, band string, mode string, dxCall string, deCall string, dxGrid string, deGrid string, dxLat double, dxLon double, deLat double, deLon double, snr string, _corrupt string"


def _upper(c: Column) -> Column:
    """Trimmed upper case; empty becomes null."""
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def _int(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("long"))


def read_wsprnet(spark: SparkSession, path: str, bands: Iterable[str] | None = None) -> DataFrame:
    """Monthly CSV archives, plain or gzipped, without header: 13 columns or more. One scan serves any number of bands."""
    p = F.split("value", ",")
    part = lambda k: F.get(p, F.lit(k))
    epoch, code, snr, dbm = (_int(part(k)) for k in (1, 12, 4, 8))
    raw = spark.read.text(path).select(
        F.lit("wsprnet").alias("source"), F.timestamp_seconds(epoch).alias("ts"), F.try_element_at(literal_map(WSPR_BAND_CODES), F.coalesce(code, F.lit(-1)).cast("int")).alias("band"),
        F.lit("WSPR").alias("mode"), F.round(part(5).try_cast("double") * 1_000_000).cast("long").alias("freq_hz"),
        F.upper(F.trim(part(6))).alias("dx_call"), F.upper(F.trim(part(2))).alias("de_call"), _upper(part(7)).alias("dx_grid"), _upper(part(3)).alias("de_grid"),
        snr.alias("snr_db"), dbm.alias("tx_dbm"), (F.size(p) < 13).alias("short"),
    )
    bad = F.col("short") | F.col("ts").isNull() | F.col("band").isNull() | F.col("snr_db").isNull() | F.col("tx_dbm").isNull()
    out = raw.withColumn("parse_error", F.when(F.coalesce(bad, F.lit(True)), "unparsed"))
    return out if bands is None else out.where(F.col("band").isin(*bands) | F.col("parse_error").isNotNull())


def read_rbn(spark: SparkSession, path: str, prefixes: DataFrame, bands: Iterable[str] | None = None) -> DataFrame:
    """Daily archives, zipped (see ``ZippedCsv``) or plain CSV with a header. ``prefixes`` places calls (see ``place_calls``)."""
    if path.endswith(".zip"):
        spark.dataSource.register(ZippedCsv)
        raw = spark.read.format("zipped_csv").schema(", ".join(f"{c} string" for c in RBN_COLUMNS)).load(path)
    else:
        raw = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in RBN_COLUMNS))
    if bands is not None:
        raw = raw.where(F.col("band").isin(*bands))
    ts = F.try_to_timestamp("date", F.lit("yyyy-MM-dd HH:mm:ss"))
    rows = raw.select(
        F.lit("rbn").alias("source"), ts.alias("ts"), F.col("band"), _upper(F.col("tx_mode")).alias("mode"), F.round(F.col("freq").try_cast("double") * 1000).cast("long").alias("freq_hz"),
        without_skimmer(F.upper(F.trim("dx"))).alias("dx_call"), without_skimmer(F.upper(F.trim("callsign"))).alias("de_call"), _int(F.col("db")).alias("snr_db"),
    )
    for side in ("dx", "de"):
        rows = place_calls(rows, prefixes, f"{side}_call", f"{side}_lat", f"{side}_lon").withColumn(f"{side}_grid", grid_of(F.col(f"{side}_lat"), F.col(f"{side}_lon")))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    bad = F.col("ts").isNull() | F.col("freq_hz").isNull() | F.col("snr_db").isNull() | empty("band") | empty("mode") | empty("dx_call") | empty("de_call")
    return rows.withColumn("parse_error", F.when(bad, "unparsed"))


def place_calls(rows: DataFrame, prefixes: DataFrame, call: str, lat: str, lon: str) -> DataFrame:
    """Adds the place of a call: that of the call itself where ``prefixes`` (prefix, lat, lon) has it as ``=<call>``, else of
    the longest prefix that it begins with; null if there is none.

    Each distinct call is looked up by equality with all that it begins with, so the table may be of any size and prefixes of
    any length.
    """
    calls = rows.select(F.col(call).alias("_call")).where("_call <> ''").distinct()
    tries = calls.select("_call", F.explode(F.sequence(F.lit(1), F.length("_call") + 1)).alias("_k"))
    tries = tries.withColumn("prefix", F.when(F.col("_k") > F.length("_call"), F.concat(F.lit("="), "_call")).otherwise(F.expr("substr(_call, 1, _k)")))
    best = tries.join(prefixes.select("prefix", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "prefix").groupBy("_call").agg(F.max_by(F.struct("_lat", "_lon"), "_k").alias("_p"))
    return rows.join(best, rows[call] == best["_call"], "left").select(*rows.columns, F.col("_p._lat").alias(lat), F.col("_p._lon").alias(lon))


def read_archive(spark: SparkSession, path: str | list[str], file_col: str | None = None) -> DataFrame:
    """Newline JSON archives, plain or gzipped. A corrupt gzip fails the read; a malformed line gets a parse error.

    Hygiene judges the grids as they came; then places come from grids, or grids from places. ``file_col`` names a column
    for the path of each record's file.
    """
    raw = spark.read.schema(ARCHIVE_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    file = [F.col("_metadata.file_path").alias(file_col)] if file_col else []
    lat = lambda c: valid_or_null(F.col(c), 90.0)
    lon = lambda c: valid_or_null(F.col(c), 180.0)
    base = raw.select(
        F.lit("cqdx").alias("source"), F.lower(F.trim("source")).alias("payload_source"), F.timestamp_seconds(_int(F.col("timestamp"))).alias("ts"),
        F.nullif(F.lower(F.trim("band")), F.lit("")).alias("band"), _upper(F.col("mode")).alias("mode"), _int(F.col("frequency")).alias("freq_hz"),
        *[_upper(F.col(f"{s}Call")).alias(f"{s}_call") for s in ("dx", "de")], *[_upper(F.col(f"{s}Grid")).alias(f"{s}_grid") for s in ("dx", "de")],
        *[F.when(lon(f"{s}Lon").isNotNull(), lat(f"{s}Lat")).alias(f"{s}_lat") for s in ("dx", "de")], *[F.when(lat(f"{s}Lat").isNotNull(), lon(f"{s}Lon")).alias(f"{s}_lon") for s in ("dx", "de")],
        _int(F.col("snr")).alias("snr_db"), F.lit(None).cast("short").alias("tx_dbm"), F.col("_corrupt"), *file,
    )
    error = F.when(F.col("_corrupt").isNotNull(), "malformed_json").when(~F.coalesce(F.col("payload_source"), F.lit("")).isin(*AUTOMATIC_SOURCES), "non_automatic_source").when(F.col("ts").isNull(), "invalid_timestamp")
    judged = judge(base).withColumn("parse_error", F.coalesce(error, F.col("reject_reason"))).drop("reject_reason")
    for s in ("dx", "de"):
        grid = normal_grid(F.col(f"{s}_grid"))
        judged = judged.withColumns({f"{s}_lat": F.coalesce(grid_lat(grid), F.col(f"{s}_lat")), f"{s}_lon": F.coalesce(grid_lon(grid), F.col(f"{s}_lon")), f"{s}_grid": F.coalesce(grid, grid_of(F.col(f"{s}_lat"), F.col(f"{s}_lon")))})
    return judged.drop("payload_source", "_corrupt")


def extract(records: DataFrame, by_source: bool = True) -> tuple[DataFrame, DataFrame]:
    """Qualifying, deduplicated spots, and counts by reason (unparsed records under their parse error)."""
    parsed = as_spots(records.where("parse_error is null"))
    errors = records.where("parse_error is not null").groupBy(F.col("parse_error").alias("reason")).agg(F.count("*").alias("n"))
    return dedup_spots(qualifying(parsed), by_source), reject_counts(parsed).unionByName(errors)


def write_extracted(records: DataFrame, path: str, by_source: bool = True) -> dict[str, int]:
    """Writes the spots of ``extract`` as Parquet; how many records had each reason, counted in the same pass."""
    rows = judge(as_spots(records, "parse_error")).withColumn("reason", F.coalesce("parse_error", "reject_reason", F.lit("qualifying")))
    seen = Observation()
    rows = rows.observe(seen, *[F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in ("qualifying", *PARSE_ERRORS, *REASONS)])
    dedup_spots(as_spots(rows.where("reason = 'qualifying'")), by_source).write.parquet(path)
    return {k: v for k, v in seen.get.items() if v}


def requested_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Each day of the half-open range."""
    return spark.range(1).select(F.explode(F.when(F.lit(start) < F.lit(end), F.expr(f"sequence(date'{start}', date'{end}' - 1)")).otherwise(F.array().cast("array<date>"))).alias("day"))


def month_bounds(month: str) -> tuple[Column, Column]:
    """First moment of the month and of the next one."""
    if not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", month):
        raise ValueError(f"not a month: {month}")
    first = F.lit(f"{month}-01").cast("timestamp")
    return first, F.add_months(first, 1).cast("timestamp")


def load_month(spark: SparkSession, root: str, month: str, source: str, bands: Iterable[str] | None = None, by_file_name: bool = False) -> DataFrame:
    """Hourly Parquet files of one month of one source; a row of another source is an error, whatever is read of the rows.

    With ``by_file_name`` only files are read whose name holds a date of the month (``YYYY-MM-DD``, as the hourly store
    writes it); a folder without any is an error, as is a file without the columns that a spot must have.
    """
    first, following = month_bounds(month)
    files = spark.read.option("recursiveFileLookup", "true").parquet(root)
    if missing := {"source", "ts", "band", "mode", "dx_call", "de_call"} - set(files.columns):
        raise ValueError(f"{root} lacks {', '.join(sorted(missing))}")
    if by_file_name:
        files = files.where(F.col("_metadata.file_path").rlike(rf"{month}-\d\d[^/]*(/[^/]*)?$"))
        if files.isEmpty():
            raise ValueError(f"{root} has no file of {month}")
    # a filter that raises can't be pruned away, as a column could
    other = F.concat(F.lit(f"a row that is not of {source}: "), F.coalesce(F.col("source"), F.lit("null")))
    rows = as_spots(files.where(F.when(F.col("source") == source, F.lit(True)).otherwise(F.raise_error(other).cast("boolean"))))
    rows = rows.where((F.col("ts") >= first) & (F.col("ts") < following))
    return rows if bands is None else rows.where(F.col("band").isin(*bands))


def read_rbn_month(spark: SparkSession, root: str, month: str, prefixes: DataFrame, bands: Iterable[str] | None = None) -> DataFrame:
    """All daily archives ``YYYYMMDD.zip`` of a month that are there; days without one are skipped."""
    month_bounds(month)
    return read_rbn(spark, f"{root}/{month.replace('-', '')}[0-3][0-9].zip", prefixes, bands)
