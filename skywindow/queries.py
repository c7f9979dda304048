"""The registered queries. Each reads the tables of a folder and gives one frame; times are whole seconds since 1970."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapter
from .functions.hygiene import qualifying, reject_counts
from .functions.signal import ft8_equivalent
from .operators import acceptance, features, metrics, p533, qa, sampling
from .operators.climatology import Climatology
from .operators.dedup import dedup_spots, source_counts
from .operators.evidence import receiver_uptime, transmit_evidence
from .operators.gbt import GBT
from .operators.labels import labels as build_labels
from .operators.labels import universe as build_universe
from .operators.labels import unlabeled_fraction as build_unlabeled
from .plans.nowcast import prediction_surface as surface
from .plans.tables import scratch, shared, staged
from .queries_sql import SQL
from .schema import CELL, HORIZONS_H

__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Training ends here; evaluation begins two days later (the adapter's spots span four days).
TRAIN_END_S, EVAL_START_S = 1714608000, 1714780800


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def seconds(df: DataFrame, *names: str) -> DataFrame:
    """Timestamps as whole seconds, ``window_start`` as ``window_s``."""
    for n in names or [c for c, t in df.dtypes if t == "timestamp"]:
        df = df.withColumn(n, F.unix_seconds(n)).withColumnRenamed(n, n.replace("_start", "_s") if n.endswith("_start") else n)
    return df


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) if t == "double" else F.col(c)).alias(c) for c, t in df.dtypes])


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualifying, deduplicated spots: what nearly every query begins with, stored once."""
    return shared(dedup_spots(qualifying(adapter.spots(spark, sf_dir))))


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(build_labels(clean(spark, sf_dir)))


SPOT_OUT = ["source", "ts", "band", "mode", "dx_call", "de_call", "dx_grid", "de_grid", "snr_db", "tx_dbm"]


@query
def spots_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seconds(adapter.spots(spark, sf_dir)).select(*SPOT_OUT)
    return out.withColumns({c: F.col(c).cast("long") for c in ("snr_db", "tx_dbm")})


@query
def hygiene_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_counts(adapter.spots(spark, sf_dir))


@query
def qualifying_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seconds(qualifying(adapter.spots(spark, sf_dir))).select(*SPOT_OUT)
    return out.withColumns({c: F.col(c).cast("long") for c in ("snr_db", "tx_dbm")})


@query
def deduplicated_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seconds(clean(spark, sf_dir)).select(*SPOT_OUT)
    return out.withColumns({c: F.col(c).cast("long") for c in ("snr_db", "tx_dbm")})


@query
def dedup_without_source_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seconds(dedup_spots(qualifying(adapter.spots(spark, sf_dir)), by_source=False)).select(*SPOT_OUT)
    return out.withColumns({c: F.col(c).cast("long") for c in ("snr_db", "tx_dbm")})


@query
def source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_counts(clean(spark, sf_dir))


@query
def receiver_uptime_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seconds(receiver_uptime(clean(spark, sf_dir)))
    return out.select("window_s", "de_call", "band", "mode_class", F.col("n_evidence_reports").cast("long").alias("n_evidence_reports"), "first_report", "last_report", "de_field", "de_grid4")


@query
def transmit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seconds(transmit_evidence(clean(spark, sf_dir)))


@query
def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seconds(build_universe(clean(spark, sf_dir)))
    return out.withColumns({c: F.col(c).cast("int") for c in ("is_positive", "is_n_eligible")})


@query
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seconds(labels_of(spark, sf_dir)).withColumn("open", F.col("open").cast("int")))


@query
def unlabeled_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(build_unlabeled(clean(spark, sf_dir)).withColumn("date", F.col("date").cast("string")))


@query
def snr_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = clean(spark, sf_dir).withColumn("s", ft8_equivalent(F.col("mode"), F.col("snr_db"), F.col("tx_dbm")))
    return rounded(s.groupBy("band", "mode").agg(F.count("*").alias("n"), F.count("s").alias("n_snr"), F.median("s").alias("median_snr")))


@query
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.sample_labels(labels_of(spark, sf_dir), ratio=0.25)
    return rounded(seconds(out).select("window_s", "tx_field", "rx_field", "band", F.col("open").cast("int").alias("open"), "sample_weight"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels_of(spark, sf_dir).select("tx_field", "rx_field").distinct()


@query
def geo_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.add_geometry(_pairs(spark, sf_dir)))


@query
def solar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.add_solar(features.add_geometry(labels_of(spark, sf_dir).select(*CELL[:3]).distinct()))
    return rounded(seconds(out).select("window_s", "tx_field", "rx_field", *features.SOLAR_COLUMNS[:4]), 5)


@query
def hours_since_terminator(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.add_solar(features.add_geometry(labels_of(spark, sf_dir).select(*CELL[:3]).distinct()))
    return rounded(seconds(out).select("window_s", "tx_field", "rx_field", "midpoint_hours_since_terminator"))


@query
def time_band_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.add_band(features.add_time(labels_of(spark, sf_dir).select("window_start", "band").distinct()))
    return rounded(seconds(out).withColumn("month", F.col("month").cast("long")))


def _space(spark: SparkSession, sf_dir: str, horizon: float) -> DataFrame:
    out = features.add_space_weather(labels_of(spark, sf_dir).select("window_start").distinct(), adapter.hourly(spark, sf_dir), horizon)
    return rounded(seconds(out))


@query
def spaceweather_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _space(spark, sf_dir, 0)


@query
def spaceweather_features_h6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _space(spark, sf_dir, 6)


def _history(spark: SparkSession, sf_dir: str, *relations: str, horizon: float = 0) -> DataFrame:
    cells = labels_of(spark, sf_dir)
    out = features.add_history(cells, cells.select(*CELL), horizon, relations)
    if "yesterday" in relations:
        out = out.withColumn("same_hour_yesterday_open", F.col("same_hour_yesterday_open").cast("int"))
    return rounded(seconds(out))


@query
def history_same_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir, "same_cell")


@query
def history_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir, "reverse_path")


@query
def history_adjacent_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir, "adjacent_band")


@query
def history_adjacent_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir, "adjacent_cell")


@query
def history_band_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir, "band_wide")


@query
def history_yesterday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir, "yesterday")


@query
def history_h6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir, "same_cell", "yesterday", horizon=6)


def split(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    t = F.unix_seconds("window_start")
    return cells.where(t < TRAIN_END_S), cells.where(t >= EVAL_START_S)


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, late = split(labels_of(spark, sf_dir))
    return Climatology().fit(train).predict(late)


@query
def open_rate_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each band was open, by UTC hour, counting only provable negatives."""
    cells = build_universe(clean(spark, sf_dir))
    out = cells.groupBy("band", F.hour("window_start").cast("long").alias("hour")).agg(F.count("*").alias("n_cells"), F.sum(F.col("is_positive").cast("long")).alias("n_open"))
    return out.select("band", "hour", "n_cells", "n_open", F.round(F.col("n_open") / F.col("n_cells"), 6).alias("open_rate"))


@query
def climatology_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = split(labels_of(spark, sf_dir))
    return rounded(Climatology().fit(train).rates.withColumn("hour", F.col("hour").cast("long")))


@query
def climatology_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seconds(_predicted(spark, sf_dir).select(*CELL, F.col("open").cast("int").alias("open"), "p_open")))


@query
def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.scores(_predicted(spark, sf_dir), "band"))


@query
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.reliability(_predicted(spark, sf_dir)))


@query
def pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.average_precision(_predicted(spark, sf_dir)))


def kp_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-hour blocks out of the hourly series: the largest Kp."""
    h = adapter.hourly(spark, sf_dir).where("kp is not null")
    return h.groupBy(F.timestamp_seconds(F.floor(F.unix_seconds("time") / 10800) * 10800).alias("block_start")).agg(F.max("kp").alias("kp"))


@query
def storm_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = metrics.tag_storms(_predicted(spark, sf_dir), kp_blocks(spark, sf_dir))
    return rounded(metrics.slice_scores(tagged, F.lit("climatology").alias("model")))


@query
def band_group_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.band_group_scores(_predicted(spark, sf_dir)))


@query
def band_group_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band group by horizon: climatology says the same at each, as the target window is what it looks at."""
    each = F.explode(F.array(*[F.lit(float(h)) for h in HORIZONS_H])).alias("horizon_hours")
    return rounded(metrics.band_group_scores(_predicted(spark, sf_dir).select("*", each, F.lit("climatology").alias("model")), "horizon_hours", "model"))


@query
def storm_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = metrics.tag_period(labels_of(spark, sf_dir), "2024-05-02 06:00:00", "2024-05-03 00:00:00")
    return rounded(cells.groupBy("period", "band").agg(F.count("*").alias("n"), F.avg(F.col("open").cast("double")).alias("open_rate")))


@query
def hourly_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seconds(metrics.hourly_timeline(_predicted(spark, sf_dir)), "hour"))


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_space_weather(features.add_solar(features.add_geometry(labels_of(spark, sf_dir))), adapter.hourly(spark, sf_dir))


@query
def qa_diurnal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qa.diurnal(labels_of(spark, sf_dir)))


@query
def qa_lowband(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qa.low_band(labels_of(spark, sf_dir)))


@query
def qa_grayline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qa.gray_line(_full(spark, sf_dir)))


@query
def qa_sporadic_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qa.sporadic_e(labels_of(spark, sf_dir)))


@query
def qa_reciprocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qa.reciprocity(labels_of(spark, sf_dir)), 5)


@query
def qa_solar_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qa.solar_cycle(_full(spark, sf_dir)))


@query
def qa_storm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qa.storm_response(_full(spark, sf_dir)))


@query
def qa_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qa.volume(reject_counts(adapter.spots(spark, sf_dir))))


@query
def coverage_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = labels_of(spark, sf_dir).select(*CELL, "open")
    predicted = cells.where("band <> '17m'").withColumn("rx_field", F.when(F.col("rx_field") == "DN", "ZZ").otherwise(F.col("rx_field")))
    return acceptance.coverage(predicted, cells)


@query
def cohort_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acceptance.cohort_digest(labels_of(spark, sf_dir))


@query
def bcr_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circuit reliability for each spot with a signal: signal and noise levels out of its numbers."""
    s = clean(spark, sf_dir).where("snr_db is not null").select("dx_call", "de_call", "band", "mode", F.unix_seconds("ts").alias("ts"), F.col("snr_db").cast("double").alias("pr0"))
    pr = F.col("pr0") - 120
    noise = [F.lit(20.0), F.lit(40.0) + F.col("pr0") / 10, F.lit(15.0)]
    snr = p533.snr_db(pr, noise, F.lit(2500.0))
    upper = p533.decile(noise, [x - 6 for x in noise], F.lit(8.0), p533.HOUR_UPPER_DB)
    lower = p533.decile(noise, [x + 9 for x in noise], F.lit(11.0), p533.HOUR_LOWER_DB)
    return rounded(s.select("dx_call", "de_call", "band", "mode", "ts", snr.alias("snr"), p533.basic_reliability(snr, F.lit(20.0), upper, lower).alias("bcr")))


@query
def prediction_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = labels_of(spark, sf_dir)
    model = Climatology().fit(cells)
    at = cells.where(F.unix_seconds("window_start") == EVAL_START_S)
    shifted = {h * 3600: model.predict(at.withColumn("window_start", F.timestamp_seconds(F.unix_seconds("window_start") + h * 3600))) for h in (0, 1, 3)}
    out = surface(shifted)
    return out.select("tx_field", "rx_field", "band", F.concat_ws(",", F.transform("p_open_pct", lambda x: F.coalesce(x.cast("string"), F.lit("null")))).alias("p_open_pct"), "confidence")


def _feature_facts(m: DataFrame, *keys: str) -> DataFrame:
    """Count, known values and mean of each feature column."""
    stats = m.groupBy(*keys).agg(*[F.struct(F.count("*").alias("n"), F.count(c).alias("n_known"), F.avg(F.col(c).cast("double")).alias("mean")).alias(c) for c in features.FEATURE_COLUMNS])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in features.FEATURE_COLUMNS]))
    return rounded(stats.select(*keys, rows.alias("r")).select(*keys, "r.feature", "r.s.n", "r.s.n_known", "r.s.mean"))


@query
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feature columns of the evaluation rows at a horizon of three hours: count, nulls and mean of each."""
    cells = labels_of(spark, sf_dir)
    _, late = split(cells)
    return _feature_facts(features.feature_matrix(late, cells, adapter.hourly(spark, sf_dir), 3))


@query
def feature_matrix_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at all horizons, in one plan."""
    cells = labels_of(spark, sf_dir)
    _, late = split(cells)
    return _feature_facts(features.feature_matrices(late, cells, adapter.hourly(spark, sf_dir), HORIZONS_H), "horizon_hours")


@query
def lake_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots written as a hive table by band and date, and counted through its partitions."""
    from .sources.lake import write_table

    spots = clean(spark, sf_dir).withColumn("date", F.to_date("ts"))
    root = scratch(spark)
    write_table(spots, root, "spots", ["band", "date"])
    back = spark.read.parquet(f"{root}/spots")
    return back.groupBy("band", F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"), F.countDistinct("dx_call").alias("n_calls"))


@query
def stream_hourly_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots as JSON payloads through the streaming accumulator in several micro-batches, late hours included."""
    from .streaming.accumulator import accumulate
    from .streaming.hourstore import HourlyStore

    s = adapter.spots(spark, sf_dir)
    fields = {"f": F.lit("14074000"), "md": F.col("mode"), "rp": F.col("snr_db").cast("string"), "t": F.unix_seconds("ts").cast("string"), "sc": F.col("dx_call"), "sl": F.col("dx_grid"), "rc": F.col("de_call"), "rl": F.col("de_grid"), "b": F.col("band")}
    root = scratch(spark)
    # as many files as the spots have splits, four at least, each in half of the batches or less
    files = max(4, s.rdd.getNumPartitions())
    s.select(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("value")).repartition(files).write.text(f"{root}/in")
    store = HourlyStore(spark, f"{root}/store")
    q = accumulate(spark.readStream.option("maxFilesPerTrigger", files // 2).text(f"{root}/in"), store, f"{root}/progress")
    q.awaitTermination()
    back = store.read()
    return back.groupBy(F.unix_seconds(F.date_trunc("HOUR", "ts")).alias("hour")).agg(F.count("*").alias("n"), F.sum(F.col("snr_db").cast("long")).alias("snr_sum"))


@query
def gbt_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of boosted trees with calibration beside climatology, on the same evaluation rows."""
    cells = labels_of(spark, sf_dir)
    train, late = split(cells)
    hourly = adapter.hourly(spark, sf_dir)
    names = [*features.TIME_COLUMNS, "band_ordinal", *features.GEOMETRY_COLUMNS, *features.SPACE_COLUMNS, "same_cell_n_1h", "same_cell_n_24h", "reverse_path_n_24h", "adjacent_cell_n_24h", "band_wide_n_1h"]
    matrix = lambda rows: staged(features.feature_matrix(rows, cells, hourly, 0).select(*CELL, "open", *names))
    model = GBT(names, trees=15, leaves=16).fit(matrix(train))
    tree = metrics.scores(model.predict(matrix(late)), F.lit("gbt").alias("model"))
    return rounded(tree.unionByName(metrics.scores(Climatology().fit(train).predict(late), F.lit("climatology").alias("model"))))


@query
def p533_keyed_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed scorer with its cache: every distinct key is scored once, then joined to all rows."""
    ssn = spark.range(1).select(F.lit("2024-05").alias("month"), F.lit(140.5).alias("ssn"))
    model = p533.KeyedScorer(p533.closed_form, ssn, scratch(spark, "scores"))
    out = model.predict(labels_of(spark, sf_dir))
    return rounded(out.groupBy("band").agg(F.count("*").alias("n"), F.count("p_open").alias("n_scored"), F.avg("p_open").alias("mean_p")))


@query
def storm_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest three-hour block among those that hold evaluation rows."""
    _, late = split(labels_of(spark, sf_dir))
    return rounded(seconds(metrics.storm_block(late, kp_blocks(spark, sf_dir))))
