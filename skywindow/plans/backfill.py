"""Backfill of archive days: all requested days in one job, staged beside the target and shown whole or not at all."""

from __future__ import annotations

from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.hygiene import REASONS, qualifying
from ..operators.dedup import dedup_spots
from ..schema import as_spots
from ..sources.archives import PARSE_ERRORS, read_archive
from ..sources.listing import OBJECT, ArchiveObjects

DONE, FAILED, REFUSED = 0, 1, 2


def archive_objects(spark: SparkSession, root: str, start: date, end: date) -> list[tuple[str, date]]:
    """Path and day of each object of the half-open range of days; only those days' folders are listed, in tasks."""
    spark.dataSource.register(ArchiveObjects)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("archive_objects").load(root).where((F.col("day") >= F.lit(start)) & (F.col("day") < F.lit(end)))
    return [(r.path, r.day) for r in rows.select("day", "path").collect()]


def archive_days(spark: SparkSession, objects: list[tuple[str, date]]) -> tuple[DataFrame, Observation]:
    """Spots of the objects, one for each path, band, mode and window of a day, with ``day``; rejects by reason are observed
    when they are written."""
    day = F.to_date(F.regexp_extract(F.col("_file"), OBJECT, 1))
    seen = Observation()
    records = read_archive(spark, [p for p, _ in objects], file_col="_file").withColumn("day", day)
    records = records.observe(seen, *[F.count(F.when(F.col("parse_error") == r, 1)).alias(r) for r in (*PARSE_ERRORS, *REASONS)])
    # days are deduplicated apart: each is what one archive day says
    spots = qualifying(as_spots(records.where("parse_error is null"), "day"))
    return dedup_spots(spots, by_source=False, within=("day",)), seen


def backfill(spark: SparkSession, root: str, start: date, end: date, out: str) -> tuple[int, dict]:
    """Writes the spots of the days as Parquet by ``day`` to the new folder ``out``: exit code and counts.

    2: the range is empty, or ``out`` is there already. 1: an object can't be read to its end, or no spot qualifies; nothing
    stays behind. 0: done. A day without spots has no partition.
    """
    if start >= end:
        return REFUSED, {"error": "the first day must be before the last"}
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    target = jvm.org.apache.hadoop.fs.Path(out.rstrip("/"))
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        return REFUSED, {"error": f"{out} is there already"}
    staging = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.staging")
    fs.delete(staging, True)
    objects = archive_objects(spark, root, start, end)
    if not objects:
        return FAILED, {"error": "no qualifying spots"}
    try:
        spots, seen = archive_days(spark, objects)
        spots.hint("rebalance", F.col("day")).write.partitionBy("day").option("compression", "zstd").parquet(staging.toString())
        written = spark.read.schema(spots.schema).parquet(staging.toString())
        counts = {str(r.day): r.n for r in written.groupBy("day").agg(F.count("*").alias("n")).collect()}
        rejected = {k: v for k, v in seen.get.items() if v}
        if not counts:
            return FAILED, {"error": "no qualifying spots", "rejected": rejected}
        if not fs.rename(staging, target):
            return FAILED, {"error": f"{out} could not be written"}
    except (PySparkException, Py4JJavaError) as e:  # a job that fails comes as the latter
        return FAILED, {"error": str(e).splitlines()[0]}
    finally:
        fs.delete(staging, True)
    return DONE, {"days": counts, "objects": len(objects), "rejected": rejected}
