"""Spots that queries share, and the files of the stream."""

import glob

from pyspark.sql import functions as F

from skywindow import adapter
from skywindow.queries import QUERIES, clean, labels_of


def test_spots_and_what_is_made_of_them_are_stored_once(spark, sf):
    for table in (adapter.spots, clean, labels_of):
        assert table(spark, sf).inputFiles() == table(spark, sf).inputFiles()


def test_stream_has_as_many_files_as_the_spots_have_splits(spark, sf):
    root, split, cost = spark.conf.get("spark.checkpoint.dir"), "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = set(glob.glob(f"{root}/scratch-*/in"))
    was = {k: spark.conf.get(k) for k in (split, cost)}
    spark.conf.set(split, "20000")
    spark.conf.set(cost, "1000")
    try:
        n = QUERIES["stream_hourly_upsert"](spark, sf).agg(F.sum("n")).first()[0]
        splits = adapter.spots(spark, sf).rdd.getNumPartitions()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    (made,) = set(glob.glob(f"{root}/scratch-*/in")) - before
    assert n > 0 and splits > 4 and len(glob.glob(f"{made}/part-*")) == splits
