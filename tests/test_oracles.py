"""Queries against their SQL on the smallest tables; ``tools/check.py`` runs all of them on any scale."""

import pytest
from check import compare, duck

from almanac.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = [
    "clean_sentinels", "unpivot_days", "calendar_spine", "detect_frequency", "dedupe_dates", "continuous_segments",
    "missing_blocks", "trim_large_blocks", "impute_linear", "impute_polynomial", "impute_auto", "imputation_summary",
    "structure_confidence", "quality_gate", "basic_statistics", "trend_analysis", "iqr_outliers_events", "stations_summary",
    "rolling_stats", "trend_window", "position_stats", "spectral_features", "decompose", "classify_components",
    "reconstruct_forecast", "predictions_table", "dry_fraction_fix", "fit_distribution", "alert_message", "alert_summary",
    "load_thresholds", "model_table",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    message, ok = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.columns == ["level", "name", "n"]
    assert df.count() > 0
