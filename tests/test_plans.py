"""Physical-plan checks: pushdown, pruning, no Python before the record
aggregate, no single-partition windows, and the R4 sink."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tidecast.plans import publish as PUB
from tidecast.plans import report as R

from .conftest import SF0001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    p = _plan(E.queries()["recent_releases"](spark, SF0001))
    assert "EqualTo(o_orderpriority,1-URGENT)" in p
    assert "GreaterTh" in p  # the since() bound (printing truncates the rest)
    # orders scan reads only the columns it needs
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz,o_orderpriority:string>" in p


def test_no_python_before_record_aggregate(spark):
    for name in ("pulls_monthly", "issues_daily_count", "issues_peak_days", "pulls_ses_forecast"):
        p = _plan(E.queries()[name](spark, SF0001))
        assert "ArrowEvalPython" not in p and "MapInPandas" not in p and "BatchEvalPython" not in p, name


def test_partial_aggregation_before_shuffle(spark):
    p = _plan(E.queries()["commits_daily_filled"](spark, SF0001))
    assert "partial_count" in p


def test_no_single_partition_exchange(spark):
    for name in ("contributors_timeline", "issues_in_windows_capped", "lookback_windows_30", "ar5_forecast"):
        p = _plan(E.queries()[name](spark, SF0001))
        assert "SinglePartition" not in p, name


def test_windowed_ranks_drop_nothing(spark):
    """Every windowed issue has a rank and a page; both scans get the range filter."""
    from .conftest import SF001
    df = E.queries()["issues_in_windows_capped"](spark, SF001)
    assert df.count() == E.queries()["issues_in_windows"](spark, SF001).count()
    p = _plan(E.queries()["issues_in_windows"](spark, SF001))
    assert "GreaterThanOrEqual(l_shipdate" in p and "GreaterThanOrEqual(o_orderdate" in p


def test_write_forecasts_dynamic_overwrite(spark, scratch):
    path = os.path.join(scratch, "fc")
    a = spark.createDataFrame([("r", "pulls", "ses", 1.0), ("r", "commits", "ar5", 2.0)],
                              "repo STRING, metric STRING, model STRING, yhat DOUBLE")
    PUB.write_forecasts(a, path)
    b = spark.createDataFrame([("r", "pulls", "ses", 9.0)], "repo STRING, metric STRING, model STRING, yhat DOUBLE")
    PUB.write_forecasts(b, path)
    got = {(r.metric, r.yhat) for r in PUB.read_forecasts(spark, path).collect()}
    assert got == {("pulls", 9.0), ("commits", 2.0)}


def test_write_forecasts_keeps_other_repositories(spark, scratch, monkeypatch):
    monkeypatch.setattr(PUB, "FORECAST_BUCKETS", 1)  # both repositories share every folder
    path = os.path.join(scratch, "fc")
    schema = "repo STRING, metric STRING, model STRING, yhat DOUBLE"
    PUB.write_forecasts(spark.createDataFrame([("o/a", "pulls", "ses", 1.0), ("o/b", "pulls", "ses", 2.0)], schema), path)
    PUB.write_forecasts(spark.createDataFrame([("o/a", "pulls", "ses", 5.0)], schema), path)
    got = {(r.repo, r.yhat) for r in PUB.read_forecasts(spark, path).collect()}
    assert got == {("o/a", 5.0), ("o/b", 2.0)}


def test_a_publication_that_dies_changes_nothing(spark, scratch, monkeypatch):
    """It fails between two folders, then before its manifest: readers see the old state, and a later one repairs all."""
    path = os.path.join(scratch, "fc")
    schema = "repo STRING, metric STRING, model STRING, yhat DOUBLE"
    state = lambda: {(r.repo, r.metric, r.yhat) for r in PUB.read_forecasts(spark, path).collect()}
    first = {("o/a", "pulls", 1.0), ("o/b", "commits", 2.0)}
    assert PUB.write_forecasts(spark.createDataFrame([(r, m, "ses", y) for r, m, y in first], schema), path) == 1
    assert state() == first
    # the second row of the second folder cannot be computed: the first folder's rows are already on their way
    broken = spark.createDataFrame([("o/a", "pulls", "ses", 7.0), ("o/b", "commits", "ses", 0.0)], schema) \
        .withColumn("yhat", F.when(F.col("metric") == "commits", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("yhat")))
    monkeypatch.setattr(PUB, "cut_lineage", lambda df: df)
    with pytest.raises(Exception, match="lost"):
        PUB.write_forecasts(broken, path)
    assert state() == first
    # complete data, but the job is gone before it names a manifest
    new = spark.createDataFrame([("o/a", "pulls", "ses", 7.0), ("o/c", "pulls", "ses", 8.0)], schema)
    with monkeypatch.context() as m:
        m.setattr(PUB.F, "lit", lambda v, real=F.lit: (_ for _ in ()).throw(OSError("gone")) if str(v).startswith("p") and len(str(v)) == 33 else real(v))
        with pytest.raises(OSError, match="gone"):
            PUB.write_forecasts(new, path)
    assert state() == first and PUB.manifest(spark, path)[0] == 1
    assert PUB.write_forecasts(new, path) == 2
    assert state() == {("o/a", "pulls", 7.0), ("o/c", "pulls", 8.0), ("o/b", "commits", 2.0)}
    assert {(r.repo, r.yhat) for r in PUB.read_forecasts(spark, path, 1).collect()} == {("o/a", 1.0), ("o/b", 2.0)}
    # another publisher took the version meanwhile
    monkeypatch.setattr(PUB, "manifest", lambda s, p, v=None, real=PUB.manifest: real(s, p, 1))
    with pytest.raises(Exception, match="version=2"):
        PUB.write_forecasts(new, path)


def test_nothing_published_yet(spark, scratch):
    with pytest.raises(ValueError, match="nothing published"):
        PUB.read_forecasts(spark, os.path.join(scratch, "none"))


def test_report_nested_columns(spark):
    from tidecast.sources import standins as SI
    t = SI.Tables(spark, SF0001)
    rep = R.issue_report(SI.issues(t)).where(F.col("repo") == "orders/1-URGENT") \
        .select(F.map_keys("created_issues_by_month").alias("k"), "created_issues_by_month").first()
    assert rep.k == sorted(rep.k) and sum(rep.created_issues_by_month.values()) > 0


def test_dashboard_tables(spark):
    from tidecast.plans import pipeline as PL
    from tidecast.sources import standins as SI
    d = PL.dashboard_tables(SI.Tables(spark, SF0001))
    assert {"forecasts", "status", "issue_report", "pulls_report", "releases_report"} <= set(d)
    fc = d["forecasts"]
    slots = {(r.metric, r.slot) for r in fc.select("metric", "slot").distinct().collect()}
    assert ("pulls", "statsmodels") in slots and ("issues", "prophet") in slots and ("releases", "lstm") in slots
    st = d["status"]
    assert st.where(F.col("status").isNull()).count() == 0
    assert {r.status for r in st.collect()} <= {"ok", "invalid_repo", "no_data", "not_enough_data", "failed", "degenerate"}
    rep = d["issue_report"].collect()
    assert len(rep) == 5 and all(r.prophet_forecast for r in rep)
    pr = [r for r in d["pulls_report"].collect() if r.n_records]
    assert len(pr) == 5 and all(r.statsmodels_status == "ok" for r in pr)


def test_no_cross_or_nested_loop_joins_anywhere(spark):
    from tidecast.plans.catalog import QUERIES
    bad = []
    for name, fn in QUERIES.items():
        p = _plan(fn(spark, SF0001))
        if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p:
            bad.append(name)
    assert bad == []


def test_commits_are_forecast(spark):
    rows = E.queries()["forecast_report"](spark, SF0001).where(F.col("metric") == "commits") \
        .select("repo", "slot").distinct().collect()
    assert {(r.repo, r.slot) for r in rows} == {(f"lineitem/{f}", s) for f in "ANR" for s in ("lstm", "prophet", "statsmodels")}
