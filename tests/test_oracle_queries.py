"""Every query with an oracle matches DuckDB on the same parquet (sf0.001)."""

import pytest

import __spark_entry__ as E
from .compare import compare, duckdb_conn

from .conftest import SF0001

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duckdb_conn(SF0001)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF0001)
    r = compare(df, con, ORACLE[name])
    assert r["columns_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r


def test_every_query_registered_has_oracle_or_is_model():
    from tidecast.plans.catalog import QUERIES
    no_oracle = set(QUERIES) - set(ORACLE)
    assert no_oracle <= {"ar5_forecast", "arma_forecast",
                         "auto_order_forecast", "additive_forecast", "additive_daily_forecast",
                         "releases_additive_tail", "lookback_forecast", "forecast_report",
                         "lookback_training_loss", "supplier_commits_additive", "additive_sparse_forecast",
                         "dashboard_page", "lookback_network_curve", "lookback_network_forecast",
                         "lookback_training_curve", "lookback_trees_forecast", "rolling_comparison", "smooth_trend",
                         "smoothing_refined_forecast"}


def test_statuses_are_all_seven(spark):
    rows = E.queries()["status_report_fits"](spark, SF0001).collect()
    assert {r["status"] for r in rows} == {"ok", "invalid_repo", "no_data", "no_column", "not_enough_data", "failed",
                                           "degenerate"}


def test_commits_are_reported(spark):
    rows = E.queries()["status_report"](spark, SF0001).where("metric = 'commits'").collect()
    assert {r["repo"] for r in rows if r["status"] == "ok"} == {"lineitem/A", "lineitem/N"}
    assert {r["status"] for r in rows if r["repo"] == "R"} == {"invalid_repo"}


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["repo", "ds", "alpha", "yhat"]
