"""Every query has a SQL check unless listed; a spread of them is compared on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare
from daygrid.plans import load
from daygrid.plans.registry import ORACLES, QUERIES

NO_SQL = {"forest_model", "forest_search", "boosted_model", "ablation_table"}
COMPARED = [
    "scan_pruned", "json_records_coerce", "day_truncate", "roundtrip_flag", "half_even_round", "explode_ids", "holiday_flag",
    "segment_counts", "segment_sums_orders", "zone_event_mass", "event_encodings", "panel_features", "zone_onehot", "missing_days",
    "calendar_residual", "exog_anomaly", "zone_mean_metrics", "ridge_fixed_alpha", "ridge_loo", "top_coefs", "shock_mae", "shallow_tree",
    "ridge_search", "incremental_r2", "axis_verdict", "effects_2x2", "bootstrap_corr_ci", "fisher_z", "cell_tests", "stream_daily_counts",
    "json_columnar_unpack", "agg_cache_reuse", "line_quantiles", "system_own_split", "system_coefs", "mode_own_split", "mode_own_tests",
    "leak_lag", "leak_rolling", "leak_fold", "permutation_importance",
]


@pytest.fixture(scope="module")
def duck(sample_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sample_dir}/{t}.parquet'")
    return con


def test_registry_is_complete():
    load()
    assert set(QUERIES) - set(ORACLES) == NO_SQL
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, duck, sample_dir, name):
    got = entry.queries()[name](spark, sample_dir).toPandas()
    assert compare(got, duck.execute(entry.oracle_sql()[name]).df()) == "ok"
