"""Every registered query of the core against its DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from skywindow.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The dearer half of the history relations and whole models run in bench and in the driver's own comparison.
FAST = [
    "hygiene_rejects", "deduplicated_spots", "dedup_without_source_rank", "receiver_uptime_windows", "transmit_windows", "universe", "labels", "unlabeled_fraction", "stratified_sample", "geo_features",
    "solar_features", "spaceweather_features_h6", "history_adjacent_cell", "history_band_wide", "history_h6", "climatology_predict", "reliability_bins", "pr_auc", "storm_slices", "qa_diurnal", "qa_reciprocity",
    "coverage_antijoin", "cohort_digest", "bcr_closed_form", "prediction_surface", "lake_roundtrip", "feature_matrix", "feature_matrix_horizons", "band_group_horizons", "stream_hourly_upsert", "p533_keyed_score", "storm_block",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{(glob.glob(f'{sf}/{t}.parquet/*') or [f'{sf}/{t}.parquet'])[0]}')")
    return con


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
    assert set(FAST) <= set(SQL)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    b = sorted((str(tuple(r[i] for i in order)) for r in want.fetchall()))
    a = sorted(str(tuple(r[c] for c in cols)) for r in got.collect())
    assert a == b
