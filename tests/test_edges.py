"""Hand-made edge fixtures (FIXTURES.md section 5)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidecast.functions.timecols import parse_time
from tidecast.operators import clean as C
from tidecast.operators import eligibility as EL
from tidecast.operators import insights as I
from tidecast.operators import series as S
from tidecast.operators import windows as W
from tidecast.sources import windows as SW

from .helpers import col_list, monthly_frame


def _status(spark, counts):
    df = spark.createDataFrame(counts, "repo STRING, metric STRING, n_records BIGINT, n_points BIGINT")
    return {(r.repo, r.slot): r.status for r in EL.eligibility(df).collect()}


def test_empty_is_no_data(spark):
    st = _status(spark, [("a/b", "pulls", 0, 0)])
    assert set(st.values()) == {"no_data"}


def test_one_month_split_uses_all_rows(spark):
    s = monthly_frame(spark, [3.0])
    assert [r.split for r in W.split_hashed(s).collect()] == ["both"]


@pytest.mark.parametrize("n,smoothing,ar5", [(1, "not_enough_data", "not_enough_data"),
                                              (5, "not_enough_data", "not_enough_data"),
                                              (6, "ok", "not_enough_data"), (11, "ok", "not_enough_data"),
                                              (12, "ok", "ok"), (24, "ok", "ok")])
def test_gates_flip_exactly(spark, n, smoothing, ar5):
    st_p = _status(spark, [("a/b", "pulls", n, n)])
    st_c = _status(spark, [("a/b", "commits", n, n)])
    assert st_p[("a/b", "statsmodels")] == smoothing
    assert st_c[("a/b", "statsmodels")] == ar5


@pytest.mark.parametrize("n", [23, 24])
def test_holt_winters_threshold(spark, n):
    from tidecast.operators import smoothing as SM
    s = monthly_frame(spark, [float(i % 12) for i in range(n)])
    models = {r.model for r in SM.smoothing_forecast(s).collect()}
    assert models == ({"holt_winters"} if n >= 24 else {"ses"})


@pytest.mark.parametrize("n,prophet,arma", [(1, "not_enough_data", "not_enough_data"),
                                             (2, "ok", "not_enough_data"), (3, "ok", "ok")])
def test_release_gate_counts_releases_not_months(spark, n, prophet, arma):
    st = _status(spark, [("a/b", "releases", n, 1)])
    assert st[("a/b", "prophet")] == prophet
    assert st[("a/b", "statsmodels")] == arma


def test_bad_dates_are_dropped(spark):
    df = spark.createDataFrame([("a/b", "x"), ("a/b", ""), ("a/b", None), ("a/b", "2024-13-01"),
                                ("a/b", "2024-03-05T10:11:12Z")], "repo STRING, t STRING")
    parsed = df.withColumn("ts", parse_time("t"))
    assert parsed.where(F.col("ts").isNotNull()).count() == 1
    m = S.monthly_count(parsed, "ts", "pulls").collect()
    assert [(r.ds, r.y) for r in m] == [(dt.date(2024, 3, 1), 1.0)]
    strict = df.withColumn("ts", parse_time("t", strict=True)).where(F.col("ts").isNotNull())
    assert strict.count() == 1


def test_open_issue_absent_from_closed_counts(spark):
    df = spark.createDataFrame([("a/b", 1, dt.date(2024, 1, 3), None), ("a/b", 2, dt.date(2024, 1, 4),
                                                                        dt.date(2024, 2, 1))],
                               "repo STRING, issue_number BIGINT, created_at DATE, closed_at DATE")
    closed = S.count_by_month_text(df, "closed_at").collect()
    assert [(r.month, r.n) for r in closed] == [("2024-02", 1)]


def test_boundary_issue_counted_once(spark):
    as_of = dt.date(2024, 6, 15)
    bounds = SW.window_bounds(as_of)
    boundary = bounds[0][1]  # start of window 1 == end of window 2
    df = spark.createDataFrame([("a/b", 1, boundary)], "repo STRING, issue_number BIGINT, created_at DATE")
    out = SW.records_in_windows(df, as_of).collect()
    assert len(out) == 1 and out[0].window_idx == 2


def test_end_of_month_windows_drift():
    b = SW.window_bounds(dt.date(2026, 3, 31))
    assert b[0][1] == dt.date(2026, 2, 28) and b[1][1] == dt.date(2026, 1, 28)


@pytest.mark.parametrize("key,status", [("a/b", "ok"), ("a", "invalid_repo"), ("a/b/c", "invalid_repo"),
                                        (None, "invalid_repo"), ("", "invalid_repo")])
def test_repo_names(spark, key, status):
    df = spark.createDataFrame([(key,)], "repo STRING")
    assert C.validate_repo(df).first().status == status


def test_same_repo_part_stays_separate(spark):
    df = spark.createDataFrame([("a/x", dt.date(2024, 1, 1)), ("b/x", dt.date(2024, 1, 2))],
                               "repo STRING, created_at DATE")
    assert S.monthly_count(df, "created_at", "pulls").count() == 2


def test_month_gap_is_zero_filled(spark):
    df = spark.createDataFrame([("a/b", "m", dt.date(2024, 1, 1), 2.0), ("a/b", "m", dt.date(2024, 4, 1), 5.0)],
                               "repo STRING, metric STRING, ds DATE, y DOUBLE")
    f = S.gap_fill(df, "month")
    assert col_list(f, "y") == [2.0, 0.0, 0.0, 5.0]


def test_constant_series_scales_to_zero(spark):
    s = W.minmax_scale(monthly_frame(spark, [4.0] * 24))
    assert set(col_list(s, "y_scaled")) == {0.0}
    back = W.minmax_unscale(s, "y_scaled", "y_back")
    assert set(col_list(back, "y_back")) == {4.0}


def test_weekday_tie_goes_to_monday(spark):
    df = spark.createDataFrame([("a/b", dt.date(2024, 1, 2)), ("a/b", dt.date(2024, 1, 1))],
                               "repo STRING, created_at DATE")
    assert I.peak_weekday(df, "created_at").first().peak_weekday == "Monday"


def test_future_grids(spark):
    s = monthly_frame(spark, [1.0, 2.0, 3.0], start=dt.date(2024, 1, 1))
    starts = col_list(S.future_month_starts(s), "ds")
    ends = col_list(S.future_month_ends(s), "ds")
    assert starts[0] == dt.date(2024, 4, 1) and starts[-1] == dt.date(2025, 3, 1) and len(starts) == 12
    assert ends[0] == dt.date(2024, 3, 31) and ends[-1] == dt.date(2025, 2, 28) and len(ends) == 12


def test_short_daily_stream_has_no_lookback_windows(spark):
    # the events table spans 30 days: too short for a 30-day look-back after an 80/20 split
    from tidecast.sources import standins as SI
    ev = SI.events(SI.Tables(spark, "/root/testdata/sf0.001"))
    s = S.gap_fill(S.daily_series(ev, "created_at", "events"), "day")
    lb = W.lookback_windows(W.split_ordered(s), 30)
    assert lb.count() == 0


def test_missing_column_status(spark):
    df = spark.createDataFrame([("a/b", 1), ("c/d", 2)], "repo STRING, number BIGINT")
    st = EL.missing_column_status(df, "pulls", ["created_at"])
    rows = st.collect()
    assert len(rows) == 6 and {r.status for r in rows} == {"no_column"}
    ok = spark.createDataFrame([("a/b", dt.datetime(2024, 1, 1))], "repo STRING, created_at TIMESTAMP")
    assert EL.missing_column_status(ok, "pulls", ["created_at"]) is None


def test_restrict_to_selected_repositories(spark):
    from tidecast.sources.landed import restrict_to
    df = spark.createDataFrame([("a/b", 1), ("c/d", 2), ("e/f", 3)], "repo STRING, number BIGINT")
    sel = spark.createDataFrame([("a/b",), ("e/f",), ("e/f",)], "repo STRING")
    assert sorted(r.number for r in restrict_to(df, sel).collect()) == [1, 3]


def test_project_series_and_month_windows(spark):
    df = spark.createDataFrame([("a/b", dt.date(2024, 1, 5), 3)], "repo STRING, t DATE, v BIGINT")
    s = C.project_series(df, "t", "v", "m").first()
    assert (s.repo, s.metric, s.ds, s.y) == ("a/b", "m", dt.date(2024, 1, 5), 3.0)
    w = SW.month_windows(spark, dt.date(2024, 3, 31)).orderBy("window_idx").collect()
    assert len(w) == 12 and w[0].hi == dt.date(2024, 3, 31) and w[0].lo == dt.date(2024, 2, 29)
    assert all(a.lo == b.hi for a, b in zip(w, w[1:]))
