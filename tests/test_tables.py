"""Tables that queries share."""

from pyspark.sql import functions as F

from skywindow.plans.tables import shared


def test_shared_once_for_each_plan_and_state_of_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    plan = lambda: spark.read.parquet(path).groupBy((F.col("id") % 3).alias("k")).count()
    one, two = shared(plan()), shared(plan())
    assert one.inputFiles() == two.inputFiles() and one.count() == 3
    assert shared(plan().where("k > 0")).count() == 2
    spark.range(5, 50).write.mode("overwrite").parquet(path)
    three = shared(plan())
    assert three.inputFiles() != one.inputFiles() and three.agg(F.sum("count")).first()[0] == 45


def test_score_cache_is_not_shuffled(spark, tmp_path):
    from skywindow.operators import p533

    rows = spark.createDataFrame([("FN", "DM", "20m", 5, k % 24, 140) for k in range(100)], "tx_field string, rx_field string, band string, month int, hour int, ssn_round int")
    cache = p533.ScoreCache(spark, str(tmp_path / "c"), 8)
    cache.add(rows.distinct().where("hour < 12").withColumn("bcr", F.lit(5.0)))
    cache.add(rows.distinct().where("hour = 3").withColumn("bcr", F.lit(5.0)))  # another writer had the same key
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    missing = p533.KeyedScorer(None, None, str(tmp_path / "c")).missing(rows, cache)
    assert "Exchange" not in plan(cache.read()) and plan(missing).count("Exchange") == 1  # that of the asked keys
    assert cache.read().count() == 12 and sorted(r.hour for r in missing.collect()) == list(range(12, 24))
