"""Spots and hourly series out of the generic order tables, by integer formulas that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import as_spots

EPOCH = "2024-05-01 00:00:00"
DAYS = 4
H = "(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31)"
SK, PK = "(l_suppkey % 20)", "(l_partkey % 30)"


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spot for each line item: four days of 15-minute windows, with rows for every reason to reject."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    letter = lambda n: f"chr(cast({n} as int))"
    keys = li.selectExpr(f"{H} as h", f"{SK} as sk", f"{PK} as pk", "cast(l_quantity as bigint) as q")
    parts = keys.selectExpr(
        "*", f"concat({letter('69 + sk % 4')}, {letter('77 + (sk div 4) % 2')}, sk % 10, (sk div 3) % 10) as xg",
        f"concat({letter('67 + pk % 3')}, {letter('77 + (pk div 3) % 2')}, pk % 10, (pk div 7) % 10) as eg", f"concat('W', pk % 10, 'B', {letter('65 + pk % 26')}) as ec",
    )
    rows = parts.selectExpr(
        "case when h % 10 in (0, 1) then 'rbn' when h % 10 = 2 then 'pskreporter' when h % 10 = 3 then 'cqdx' else 'wsprnet' end as source",
        f"timestamp_seconds(unix_seconds(timestamp'{EPOCH}Z') + (h * 61) % 345600) as ts",
        "case when h % 13 = 0 then '2m' when h % 13 in (1, 2) then '40m' when h % 13 in (3, 4) then '15m' when h % 13 = 5 then '17m' else '20m' end as band",
        "case when h % 7 = 0 then 'CW' when h % 7 = 1 then 'FT8' when h % 7 = 2 then 'FT4' when h % 7 = 3 then 'SSB' else 'WSPR' end as mode",
        f"case when h % 211 = 0 then null when h % 199 = 0 then '!!!' when h % 193 = 0 then concat(ec, '/P') when h % 89 = 0 then concat('<k', sk % 10, 'a', lower({letter('65 + sk')}), '>') else concat('K', sk % 10, 'A', {letter('65 + sk')}, case when h % 97 = 0 then '/MM' else '' end) end as dx_call",
        "ec as de_call",
        "case when h % 101 = 0 then 'RR73' when h % 103 = 0 then null when h % 107 = 0 then substr(xg, 1, 2) when h % 109 = 0 then lower(xg) when h % 113 = 0 then eg else xg end as dx_grid",
        "case when h % 127 = 0 then substr(eg, 1, 2) else eg end as de_grid",
        "case when h % 103 = 0 and h % 2 = 0 then 45.0D end as dx_lat", "case when h % 103 = 0 and h % 2 = 0 then -75.0D end as dx_lon",
        "case when h % 19 = 0 then null else q - 35 end as snr_db", "case when h % 10 >= 4 then 20 + (h % 4) * 10 end as tx_dbm",
    )
    return as_spots(rows)  # not stored: what is made of it goes on in the same pass


SPOTS_SQL = f"""
raw AS (SELECT {H} AS h, {SK} AS sk, {PK} AS pk, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
raw2 AS (SELECT *, chr(CAST(69 + sk % 4 AS INT)) || chr(CAST(77 + (sk // 4) % 2 AS INT)) || (sk % 10) || ((sk // 3) % 10) AS xg,
  chr(CAST(67 + pk % 3 AS INT)) || chr(CAST(77 + (pk // 3) % 2 AS INT)) || (pk % 10) || ((pk // 7) % 10) AS eg, 'W' || (pk % 10) || 'B' || chr(CAST(65 + pk % 26 AS INT)) AS ec FROM raw),
spots AS (SELECT
  CASE WHEN h % 10 IN (0, 1) THEN 'rbn' WHEN h % 10 = 2 THEN 'pskreporter' WHEN h % 10 = 3 THEN 'cqdx' ELSE 'wsprnet' END AS source,
  TIMESTAMP '{EPOCH}' + to_seconds((h * 61) % 345600) AS ts,
  CASE WHEN h % 13 = 0 THEN '2m' WHEN h % 13 IN (1, 2) THEN '40m' WHEN h % 13 IN (3, 4) THEN '15m' WHEN h % 13 = 5 THEN '17m' ELSE '20m' END AS band,
  CASE WHEN h % 7 = 0 THEN 'CW' WHEN h % 7 = 1 THEN 'FT8' WHEN h % 7 = 2 THEN 'FT4' WHEN h % 7 = 3 THEN 'SSB' ELSE 'WSPR' END AS mode,
  CASE WHEN h % 211 = 0 THEN NULL WHEN h % 199 = 0 THEN '!!!' WHEN h % 193 = 0 THEN ec || '/P' WHEN h % 89 = 0 THEN '<k' || (sk % 10) || 'a' || lower(chr(CAST(65 + sk AS INT))) || '>'
    ELSE 'K' || (sk % 10) || 'A' || chr(CAST(65 + sk AS INT)) || CASE WHEN h % 97 = 0 THEN '/MM' ELSE '' END END AS dx_call, ec AS de_call,
  CASE WHEN h % 101 = 0 THEN 'RR73' WHEN h % 103 = 0 THEN NULL WHEN h % 107 = 0 THEN substr(xg, 1, 2) WHEN h % 109 = 0 THEN lower(xg) WHEN h % 113 = 0 THEN eg ELSE xg END AS dx_grid,
  CASE WHEN h % 127 = 0 THEN substr(eg, 1, 2) ELSE eg END AS de_grid,
  CASE WHEN h % 103 = 0 AND h % 2 = 0 THEN 45.0::DOUBLE END AS dx_lat, CASE WHEN h % 103 = 0 AND h % 2 = 0 THEN -75.0::DOUBLE END AS dx_lon, NULL::DOUBLE AS de_lat, NULL::DOUBLE AS de_lon,
  CASE WHEN h % 19 = 0 THEN NULL ELSE q - 35 END AS snr_db, CASE WHEN h % 10 >= 4 THEN 20 + (h % 4) * 10 END AS tx_dbm
FROM raw2)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hourly space-weather series from the orders: averages of integer formulas by hour, with hours left out."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    g = o.selectExpr("cast(o_orderkey % 2000 as bigint) as k", "cast(o_custkey as bigint) as c").groupBy("k").agg(F.sum("c").alias("s"), F.count("*").alias("n"))
    g = g.where("k % 17 <> 3")
    return g.selectExpr(
        f"timestamp_seconds(unix_seconds(timestamp'{EPOCH}Z') + (k - 1800) * 3600) as time",
        "case when s % 29 = 0 then null else (s % 28) / 3.0D end as kp", "case when s % 31 = 0 then null else 70.0D + s % 180 end as f107",
        "case when s % 37 = 0 then null else (s % 41 - 20) / 2.0D end as bz_gsm", "300.0D + s % 400 as solar_wind_speed", "cast(s % 120 - 100 as double) as dst",
    )


HOURLY_SQL = f"""
hk AS (SELECT CAST(o_orderkey % 2000 AS BIGINT) AS k, CAST(sum(CAST(o_custkey AS BIGINT)) AS BIGINT) AS s FROM orders GROUP BY 1),
hourly AS (SELECT TIMESTAMP '{EPOCH}' + to_seconds((k - 1800) * 3600) AS time, CASE WHEN s % 29 = 0 THEN NULL ELSE (s % 28) / 3.0::DOUBLE END AS kp,
  CASE WHEN s % 31 = 0 THEN NULL ELSE 70.0::DOUBLE + s % 180 END AS f107, CASE WHEN s % 37 = 0 THEN NULL ELSE (s % 41 - 20) / 2.0::DOUBLE END AS bz_gsm,
  300.0::DOUBLE + s % 400 AS solar_wind_speed, CAST(s % 120 - 100 AS DOUBLE) AS dst FROM hk WHERE k % 17 <> 3)"""
