"""Hive-partitioned Parquet tables and their views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, root: str, table: str, by: list[str], mode: str = "append") -> None:
    """Appends by partition. Rows of a partition are brought together first, so that each gets few files; a large one is
    dealt to several tasks by its measured size."""
    df.hint("rebalance", *[F.col(c) for c in by]).write.mode(mode).partitionBy(*by).option("compression", "zstd").parquet(f"{root}/{table}")


def write_labels(labels: DataFrame, root: str) -> None:
    write_table(labels.withColumn("date", F.to_date("window_start")), root, "labels", ["band", "date"])


def register_view(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table as a view; partition columns come from the paths, dates as dates."""
    df = spark.read.parquet(f"{root}/{name}")
    df.createOrReplaceTempView(name)
    return df
