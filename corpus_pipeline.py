"""A corpus pipeline of five stages, each an operator of ``skywindow.llm``.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and reread as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skywindow.llm import decontaminate, mixing, near_dup, quality_knn, secret_scan
from skywindow.llm.common import stash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour classifier rejects go."""
    return quality_knn.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dup.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; every document stays."""
    out = secret_scan.redact_secrets(docs)
    return out if "n_chars" not in docs.columns else _recount(out, docs)


def _recount(out: DataFrame, docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    n = F.when(F.col("text").isNull() | F.col("n_chars").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: a row for each copy that is taken, in the order of its position."""
    return mixing.mixed_order(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("leaks", leaks), ("secrets", secrets), ("mixture", mixture)]

#: The stages learn, verify edits and lex text: SQL can't express them. ``tests/llm`` holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and reread."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), spark)
    return STAGES[-1][1](spark, docs, sf_dir)
