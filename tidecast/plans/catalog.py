"""Named queries over the stand-in tables: ``name -> fn(spark, sf_dir)``.

Every query reads the parquet tables of ``sf_dir`` in full and returns all
repositories at once. Computed columns are aliased to the names used by
the matching oracle SQL in ``plans.oracle``; doubles that come out of
arithmetic are rounded to 4 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series as S
from ..operators import smoothing as SM
from ..sources import standins as SI

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r4(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


def staged(series: DataFrame) -> DataFrame:
    """Materialise a series once (reliable checkpoint in the session's
    checkpoint folder) before a model reads it along several branches, so
    the raw records are scanned and aggregated once and a lost executor
    recomputes from here, not from the raw tables."""
    from ..session import cut_lineage
    return cut_lineage(series)


def pulls_monthly_series(t: SI.Tables) -> DataFrame:
    return S.monthly_count(SI.pulls(t), "created_at", "pulls")


@query("pulls_ses_forecast")
def pulls_ses_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 -> F1 -> T9: SES on monthly pull counts, 12 month-starts ahead."""
    t = SI.Tables(spark, sf_dir)
    fc = SM.ses_forecast(pulls_monthly_series(t))
    return fc.select("repo", "ds", r4("alpha").alias("alpha"), r4("yhat").alias("yhat"))


# ---------------------------------------------------------------- issues
from ..operators import clean as C  # noqa: E402
from ..operators import eligibility as EL  # noqa: E402
from ..operators import insights as I  # noqa: E402
from ..operators import timeline as TL  # noqa: E402
from ..operators import windows as W  # noqa: E402
from ..sources import windows as SW  # noqa: E402


@query("issues_created_by_month")
def issues_created_by_month(spark, sf_dir):
    """A1: issues per created 'YYYY-MM'."""
    return S.count_by_month_text(SI.issues(SI.Tables(spark, sf_dir)), "created_at")


@query("issues_closed_by_month")
def issues_closed_by_month(spark, sf_dir):
    """A2: closed issues per closed 'YYYY-MM' (open issues excluded)."""
    return S.count_by_month_text(SI.issues(SI.Tables(spark, sf_dir)), "closed_at")


@query("issues_peak_days")
def issues_peak_days(spark, sf_dir):
    """I1 + I2: the three insights per repository."""
    return I.issue_insights(SI.issues(SI.Tables(spark, sf_dir)))


@query("weekday_histogram")
def weekday_histogram(spark, sf_dir):
    """Pull requests per weekday name."""
    return I.weekday_histogram(SI.pulls(SI.Tables(spark, sf_dir)), "created_at").drop("weekday_pos")


@query("month_histogram")
def month_histogram(spark, sf_dir):
    """Pull requests per month name."""
    return I.month_histogram(SI.pulls(SI.Tables(spark, sf_dir)), "created_at").drop("month")


def _issues_windowed(spark, sf_dir):
    t = SI.Tables(spark, sf_dir)
    iss = SI.issues(t, since=SW.window_bounds(SI.AS_OF)[-1][1])
    return SW.records_in_windows(iss, SI.AS_OF, "created_at")


@query("issues_in_windows")
def issues_in_windows(spark, sf_dir):
    """S4 + S5 + J2: issues created in the 12 monthly windows before as_of."""
    return _issues_windowed(spark, sf_dir).select(
        "repo", "issue_number", "created_at", "closed_at", "window_idx")


@query("issues_in_windows_capped")
def issues_in_windows_capped(spark, sf_dir):
    """S5 + O3: every windowed issue with its rank in (repo, window) by
    (day, number) and its page of 100. (The name is historic: no cap.)"""
    return SW.paged(_issues_windowed(spark, sf_dir)).select(
        "repo", "issue_number", "created_at", "window_idx", "rank_in_window", "page")


# ---------------------------------------------------------- monthly series
def _series_out(df):
    return df.select("repo", "ds", "y")


@query("pulls_monthly")
def pulls_monthly(spark, sf_dir):
    """A3 + T3: pull requests per month (observed months only)."""
    return _series_out(pulls_monthly_series(SI.Tables(spark, sf_dir)))


def commits_monthly_series(t):
    return S.monthly_count(SI.commits(t), "date", "commits")


@query("commits_monthly")
def commits_monthly(spark, sf_dir):
    return _series_out(commits_monthly_series(SI.Tables(spark, sf_dir)))


def releases_monthly_series(t):
    return S.monthly_count(SI.releases(t), "published_at", "releases")


@query("releases_monthly")
def releases_monthly(spark, sf_dir):
    return _series_out(releases_monthly_series(SI.Tables(spark, sf_dir)))


def branches_monthly_series(t):
    return TL.synthetic_monthly(SI.branches(t), SI.AS_OF, "branches")


@query("branches_monthly")
def branches_monthly(spark, sf_dir):
    """T8 + A3: branches per synthetic month (list position -> day)."""
    return _series_out(branches_monthly_series(SI.Tables(spark, sf_dir)))


def contributors_monthly_series(t):
    return TL.synthetic_monthly(SI.contributors(t), SI.AS_OF, "contributors", value_col="contributions")


@query("contributors_monthly")
def contributors_monthly(spark, sf_dir):
    """T8 + A5: contributions summed per synthetic month."""
    return _series_out(contributors_monthly_series(SI.Tables(spark, sf_dir)))


@query("contributors_timeline")
def contributors_timeline(spark, sf_dir):
    """T8 per row: list position and synthetic day of every contributor."""
    t = SI.Tables(spark, sf_dir)
    df = TL.rank_spaced_timeline(SI.contributors(t), SI.AS_OF, SI.CONTRIBUTOR_ORDER)
    return df.select("repo", "name", "contributions", "position", "synthetic_day")


@query("pulls_month_profile")
def pulls_month_profile(spark, sf_dir):
    """A4: pull requests per calendar month 1-12."""
    return S.month_of_year_profile(SI.pulls(SI.Tables(spark, sf_dir)), "created_at")


def issues_daily_series(t, value="count"):
    return S.daily_series(SI.issues(t), "created_at", "issues", value=value)


@query("issues_daily_count")
def issues_daily_count(spark, sf_dir):
    """Issues created per day."""
    return _series_out(issues_daily_series(SI.Tables(spark, sf_dir)))


@query("issues_daily_sum_number")
def issues_daily_sum_number(spark, sf_dir):
    """A6 with the reference's value (sum of issue numbers, D1)."""
    return _series_out(issues_daily_series(SI.Tables(spark, sf_dir), "sum_number"))


@query("releases_monthly_filled")
def releases_monthly_filled(spark, sf_dir):
    """T6 + J1 + A7: dense month-start grid of releases, zeros in gaps."""
    return _series_out(S.gap_fill(releases_monthly_series(SI.Tables(spark, sf_dir)), "month"))


@query("issues_daily_filled")
def issues_daily_filled(spark, sf_dir):
    """T5 + J1: dense daily grid of created issues, zeros in gaps."""
    return _series_out(S.gap_fill(issues_daily_series(SI.Tables(spark, sf_dir)), "day"))


@query("recent_releases")
def recent_releases(spark, sf_dir):
    """P7 + P9 + T2 + P8: releases of the last 730 days, strict timestamps."""
    t = SI.Tables(spark, sf_dir)
    r = C.since(SI.releases(t), "published_at", SI.AS_OF, 730)
    r = C.published_only(r, "published_text")
    from ..functions.timecols import parse_time
    r = r.withColumn("parsed", parse_time("published_text", strict=True))
    r = C.only_present(r, "parsed")
    return r.select("repo", "name", F.col("parsed").cast("date").alias("published_at"))


@query("repo_validation")
def repo_validation(spark, sf_dir):
    """P10 over keys derived from part: 'word/word' (valid), brand (no
    slash) and 'type/word/word' (three parts)."""
    p = SI.Tables(spark, sf_dir).part
    k1 = p.select(F.regexp_replace("p_name", " ", "/").alias("repo"))
    k2 = p.select(F.col("p_brand").alias("repo"))
    k3 = p.select(F.concat(F.col("p_type"), F.lit("/"), F.regexp_replace("p_name", " ", "/")).alias("repo"))
    keys = k1.unionByName(k2).unionByName(k3).distinct()
    return C.validate_repo(keys).select("repo", "status", "owner", "name")


# ------------------------------------------------------------- eligibility
MONTHLY = ("pulls", "commits", "branches", "contributors", "releases")


def metric_series(t, metric: str):
    """Points (repo, metric, ds, y, n) of one metric per the registry's
    grain and gap rule; n is the number of records of the point."""
    if metric == "contributors":
        return TL.synthetic_monthly(SI.contributors(t), SI.AS_OF, metric, "contributions", with_n=True)
    series = {"issues": lambda: S.gap_fill(S.daily_series(SI.issues_created(t), "created_at", "issues"), "day"),
              "pulls": lambda: pulls_monthly_series(t), "commits": lambda: S.monthly_count(SI.reported_commits(t), "date", "commits"),
              "branches": lambda: branches_monthly_series(t),
              "releases": lambda: S.gap_fill(releases_monthly_series(t), "month")}[metric]()
    return series.withColumn("n", F.col("y").cast("long"))


def report_series(t, metrics):
    """The series of several metrics, written once; counts, statuses and
    the series themselves are all read from there."""
    out = None
    for m in metrics:
        s = metric_series(t, m).select("repo", "metric", "ds", "y", "n")
        out = s if out is None else out.unionByName(s)
    return staged(out)


def metric_statuses(t, series, metrics):
    """P12 over every known repository and each of ``metrics``."""
    return EL.eligibility(EL.series_counts(series, SI.repositories(t), list(metrics)))


@query("series_eligibility")
def series_eligibility(spark, sf_dir):
    """P12 + A8: status of every (repo, metric, model slot)."""
    t, metrics = SI.Tables(spark, sf_dir), ("issues", *MONTHLY)
    return metric_statuses(t, report_series(t, metrics), metrics)


@query("eligible_series")
def eligible_series(spark, sf_dir):
    """J4 (left semi): monthly series passing the statsmodels-slot gate."""
    t = SI.Tables(spark, sf_dir)
    s = report_series(t, MONTHLY)
    return EL.eligible_series(s, metric_statuses(t, s, MONTHLY), "statsmodels").select("repo", "metric", "ds", "y")


@query("rejected_series")
def rejected_series(spark, sf_dir):
    """J4 (left anti): monthly series failing the statsmodels-slot gate."""
    t = SI.Tables(spark, sf_dir)
    s = report_series(t, MONTHLY)
    return EL.rejected_series(s, metric_statuses(t, s, MONTHLY), "statsmodels").select("repo", "metric", "ds", "y")


# ------------------------------------------------------------------ grids
@query("future_month_starts")
def future_month_starts(spark, sf_dir):
    """12 month-starts after each pull series' last month."""
    return S.future_month_starts(pulls_monthly_series(SI.Tables(spark, sf_dir))).select("repo", "step", "ds")


@query("future_month_ends")
def future_month_ends(spark, sf_dir):
    """12 month-ends starting with the last observed month."""
    return S.future_month_ends(pulls_monthly_series(SI.Tables(spark, sf_dir))).select("repo", "step", "ds")


@query("future_days")
def future_days(spark, sf_dir):
    """Issue history days plus the next 30 days."""
    return S.future_days(issues_daily_series(SI.Tables(spark, sf_dir))).select("repo", "ds", "future")


# ---------------------------------------------------------- windows/splits
@query("series_index_scaled")
def series_index_scaled(spark, sf_dir):
    """T7 + W2: month index and min-max scaled value per pull series."""
    s = S.add_index(pulls_monthly_series(SI.Tables(spark, sf_dir)))
    s = W.minmax_scale(s, fit_on="all")
    return s.select("repo", "ds", "idx", "y", r4("y_scaled").alias("y_scaled"))


@query("series_split_ordered")
def series_split_ordered(spark, sf_dir):
    """Ordered 80/20 split of each pull series."""
    return W.split_ordered(pulls_monthly_series(SI.Tables(spark, sf_dir))).select("repo", "ds", "idx", "split")


@query("series_split_hashed")
def series_split_hashed(spark, sf_dir):
    """Seeded shuffled 80/20 split of each pull series."""
    return W.split_hashed(pulls_monthly_series(SI.Tables(spark, sf_dir))).select("repo", "ds", "idx", "split")


def pulls_daily_filled(t):
    return S.gap_fill(S.daily_series(SI.pulls(t), "created_at", "pulls"), "day")


@query("lookback_windows_30")
def lookback_windows_30(spark, sf_dir):
    """Previous 30 daily pull counts per day, made inside each split."""
    s = W.split_ordered(pulls_daily_filled(SI.Tables(spark, sf_dir)))
    lb = W.lookback_windows(s, 30)
    x = F.array_join(F.transform("x", lambda v: v.cast("long").cast("string")), ",")
    return lb.select("repo", "ds", "split", x.alias("x"), "y")


@query("diff_and_lags")
def diff_and_lags(spark, sf_dir):
    """W5 + W6: first difference of monthly commits and its lags 1..5."""
    d = W.lag_matrix(W.difference(commits_monthly_series(SI.Tables(spark, sf_dir))), 5)
    return d.select("repo", "ds", "y", "dy", *[f"lag{i}" for i in range(1, 6)])


# ------------------------------------------------------------------ models
from ..operators import ar as AR  # noqa: E402
from ..operators import evaluate as EV  # noqa: E402
from ..operators import linalg as LA  # noqa: E402
from ..operators import order_search as OS  # noqa: E402
from ..operators import trend as TR  # noqa: E402


@query("ar1_forecast")
def ar1_forecast(spark, sf_dir):
    """F4 with p = 1 (closed form) on monthly commits, 12 months ahead."""
    fc = AR.ar1_forecast(staged(commits_monthly_series(SI.Tables(spark, sf_dir))))
    return fc.select("repo", "step", "ds", r4("phi").alias("phi"), r4("yhat").alias("yhat"))


@query("gram_entries")
def gram_entries(spark, sf_dir):
    """K1 before the solve: X'X and X'y of the AR(5) design on monthly pull
    differences (upper triangle, 1-based lag positions; j = 0 for X'y)."""
    d = AR.ar_design(pulls_monthly_series(SI.Tables(spark, sf_dir)), 5)
    return LA.gram_long(d, ["repo", "metric"], "x", "dy", 5).select("repo", "kind", "i", "j", "value")


def _hashed_trend(spark, sf_dir):
    s = W.split_hashed(staged(pulls_monthly_series(SI.Tables(spark, sf_dir))))
    return TR.index_trend_fit(s)


@query("index_trend_fit")
def index_trend_fit(spark, sf_dir):
    """linear month-index trend fitted on the hashed-split train rows,
    predicted in-sample for every month (monthly pulls)."""
    f = _hashed_trend(spark, sf_dir)
    return f.select("repo", "ds", "idx", "split", "y", r4("yhat").alias("yhat"))


@query("index_trend_mse")
def index_trend_mse(spark, sf_dir):
    """E1 over F10: mean squared error per split."""
    f = _hashed_trend(spark, sf_dir).withColumn("segment", F.col("split")).withColumn("model", F.lit("index_trend"))
    m = EV.mse(f, segment=None)
    return m.select("repo", F.col("segment").alias("split"), r4("mse").alias("mse"))


def _holdout(spark, sf_dir):
    s = W.split_ordered(staged(pulls_monthly_series(SI.Tables(spark, sf_dir))))
    return EV.holdout_index_trend(s).unionByName(EV.holdout_ses(s))


@query("actual_vs_predicted")
def actual_vs_predicted(spark, sf_dir):
    """E2 + F12: train fit and test forecast of index trend and SES."""
    return _holdout(spark, sf_dir).select("repo", "model", "segment", "ds", "y", r4("yhat").alias("yhat"))


@query("model_comparison")
def model_comparison(spark, sf_dir):
    """Models ranked per repository by hold-out mse."""
    c = EV.compare_models(_holdout(spark, sf_dir))
    return c.select("repo", "model", r4("mse").alias("mse"), "rank")


# -------------------------------------------- iterative fits (numpy-checked)
def _fc_out(fc):
    return fc.select("repo", "model", "step", "ds", r4("yhat").alias("yhat"),
                     r4("yhat_lower").alias("yhat_lower"), r4("yhat_upper").alias("yhat_upper"))


@query("hw_forecast")
def hw_forecast(spark, sf_dir):
    """Holt-Winters (additive season 12, no trend) on monthly pulls."""
    return _fc_out(SM.hw_forecast(pulls_monthly_series(SI.Tables(spark, sf_dir))))


@query("smoothing_forecast")
def smoothing_forecast(spark, sf_dir):
    """Holt-Winters for >= 24 months, SES for 6-23, on monthly releases."""
    return _fc_out(SM.smoothing_forecast(releases_monthly_series(SI.Tables(spark, sf_dir))))


@query("ar5_forecast")
def ar5_forecast(spark, sf_dir):
    """ARIMA(5,1,0) on monthly commits."""
    return _fc_out(AR.ar_forecast(staged(commits_monthly_series(SI.Tables(spark, sf_dir))), 5))


@query("arma_forecast")
def arma_forecast(spark, sf_dir):
    """ARIMA(1,1,1) (Hannan-Rissanen) on monthly contributions."""
    return _fc_out(AR.arma_forecast(staged(contributors_monthly_series(SI.Tables(spark, sf_dir)))))


@query("auto_order_forecast")
def auto_order_forecast(spark, sf_dir):
    """F6 + F12: order chosen on the first 80 % of daily created issues,
    forecast over the held-out days."""
    s = W.split_ordered(staged(S.gap_fill(issues_daily_series(SI.Tables(spark, sf_dir)), "day")))
    train = s.where(F.col("split") == "train").select("repo", "metric", "ds", "y")
    h = s.where(F.col("split") == "test").groupBy("repo", "metric").agg(F.count(F.lit(1)).cast("int").alias("h"))
    fc = OS.order_search_forecast(train, h)
    return fc.select("repo", "model", "d", "p", "q", "step", "ds", r4("yhat").alias("yhat"),
                     r4("yhat_lower").alias("yhat_lower"), r4("yhat_upper").alias("yhat_upper"))


@query("differencing_order")
def differencing_order(spark, sf_dir):
    """KPSS statistics of monthly pulls and their differences, and d."""
    k = OS.differencing(pulls_monthly_series(SI.Tables(spark, sf_dir)))
    return k.select("repo", *[r4(F.col("kpss")[i]).alias(f"kpss{i}") for i in range(3)], "d")


from ..operators import additive as AD  # noqa: E402
from ..operators import lookback as LB  # noqa: E402


def _band_out(fc):
    return fc.select("repo", "model", "segment", "ds", "y", r4("yhat").alias("yhat"),
                     r4("yhat_lower").alias("yhat_lower"), r4("yhat_upper").alias("yhat_upper"))


@query("additive_forecast")
def additive_forecast(spark, sf_dir):
    """F7 + F8: additive model on monthly pulls, history + 12 month-starts."""
    return _band_out(AD.additive_forecast(staged(pulls_monthly_series(SI.Tables(spark, sf_dir))), "month"))


@query("additive_daily_forecast")
def additive_daily_forecast(spark, sf_dir):
    """F7 + F8 on daily created issues: history + 30 days."""
    s = staged(S.gap_fill(issues_daily_series(SI.Tables(spark, sf_dir)), "day"))
    return _band_out(AD.additive_forecast(s, "day"))


@query("releases_additive_tail")
def releases_additive_tail(spark, sf_dir):
    """F7 + T11 + T12: the release endpoint's view -- zero-filled monthly
    releases, month-end continuation, last 12 rows only."""
    s = staged(S.gap_fill(releases_monthly_series(SI.Tables(spark, sf_dir)), "month"))
    fc = AD.additive_forecast(s, "month", month_end=True)
    return _band_out(S.forecast_tail(fc, 12))


@query("lookback_forecast")
def lookback_forecast(spark, sf_dir):
    """per-series linear AR(30) on scaled daily created issues."""
    s = staged(S.gap_fill(issues_daily_series(SI.Tables(spark, sf_dir)), "day"))
    fc = LB.lookback_forecast(s)
    return fc.select("repo", "model", "segment", "ds", "y", r4("yhat").alias("yhat"))


from . import pipeline as PL  # noqa: E402
from . import report as R  # noqa: E402


@query("issue_report_flat")
def issue_report_flat(spark, sf_dir):
    """R1 (flattened): issues created in the 12 windows before as_of, with
    their month counts as 'YYYY-MM:n' text, insights and repo facts."""
    t = SI.Tables(spark, sf_dir)
    iss = SW.records_in_windows(SI.issues(t, since=SW.window_bounds(SI.AS_OF)[-1][1]), SI.AS_OF, "created_at")
    return R.issue_report(iss, flat=True)


@query("issue_report_full")
def issue_report_full(spark, sf_dir):
    """R1 with facts and forecasts: stars and forks of the landed repository
    objects of the order keys, and the smoothing slot's forecast of monthly
    created issues as text."""
    t = SI.Tables(spark, sf_dir)
    iss = SW.records_in_windows(SI.issues(t, since=SW.window_bounds(SI.AS_OF)[-1][1]), SI.AS_OF, "created_at")
    monthly = S.monthly_count(iss, "created_at", "issues")
    fc = SM.smoothing_forecast(staged(monthly)).select(
        "repo", F.lit("statsmodels").alias("slot"), F.lit("forecast").alias("segment"), "ds", "yhat")
    stars = t.orders.groupBy(F.concat(F.lit("orders/"), F.col("o_orderpriority")).alias("repo")).agg(
        F.count(F.lit(1)).alias("stars"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("forks"))
    rep = R.issue_report(iss, facts=stars, forecasts=fc, flat=True)
    return rep.drop("lstm_forecast", "prophet_forecast") \
        .withColumn("statsmodels_forecast", R.points_text("statsmodels_forecast"))


@query("metric_reports")
def metric_reports(spark, sf_dir):
    """R2 of all five metrics with forecasts: the index trend fills the
    first slot, the smoothing dispatch the third; gates decide who gets one."""
    t = SI.Tables(spark, sf_dir)
    s = report_series(t, MONTHLY)
    st = staged(metric_statuses(t, s, MONTHLY))
    points = s.select("repo", "metric", "ds", "y")
    trend = TR.index_trend_fit(W.split_hashed(EL.eligible_series(points, st, "lstm")))
    smooth = SM.smoothing_forecast(EL.eligible_series(points, st, "statsmodels"))
    fc = trend.select("repo", "metric", F.lit("lstm").alias("slot"), "ds", "yhat").unionByName(
        smooth.select("repo", "metric", F.lit("statsmodels").alias("slot"), "ds", "yhat"))
    rep = R.metric_reports(st, fc.withColumn("segment", F.lit("forecast")))
    return rep.drop("prophet_forecast").withColumn("lstm_forecast", R.points_text("lstm_forecast")) \
        .withColumn("statsmodels_forecast", R.points_text("statsmodels_forecast"))


@query("metric_report_pulls")
def metric_report_pulls(spark, sf_dir):
    """R2: the three slots of the pulls metric side by side."""
    t = SI.Tables(spark, sf_dir)
    s = report_series(t, ("pulls",))
    rep = R.metric_report(metric_statuses(t, s, ("pulls",)), "pulls")
    choice = F.when(F.col("n_points") >= SM.HW_MIN_POINTS, F.lit("holt_winters")) \
        .when(F.col("n_points") >= SM.SES_MIN_POINTS, F.lit("ses"))
    return rep.withColumn("statsmodels_model", choice)


@query("status_report")
def status_report(spark, sf_dir):
    """Gate status of every (repo, metric, slot) plus key validity."""
    t, metrics = SI.Tables(spark, sf_dir), ("issues", *MONTHLY)
    return R.status_report(metric_statuses(t, report_series(t, metrics), metrics))


@query("forecast_report")
def forecast_report(spark, sf_dir):
    """Every metric x slot forecast for every repository, one frame."""
    fc, _ = PL.all_forecasts(SI.Tables(spark, sf_dir))
    return fc.select("repo", "metric", "slot", "model", "segment", "ds", "y", r4("yhat").alias("yhat"),
                     r4("yhat_lower").alias("yhat_lower"), r4("yhat_upper").alias("yhat_upper"), "fit_flag")


@query("pulls_monthly_filled")
def pulls_monthly_filled(spark, sf_dir):
    """A3 + T6: monthly pull counts on a dense month grid (zeros in gaps)."""
    return _series_out(S.gap_fill(pulls_monthly_series(SI.Tables(spark, sf_dir)), "month"))


@query("commits_daily_filled")
def commits_daily_filled(spark, sf_dir):
    """A6 + T5: daily commits on a dense day grid (zeros in gaps)."""
    s = S.daily_series(SI.commits(SI.Tables(spark, sf_dir)), "date", "commits")
    return _series_out(S.gap_fill(s, "day"))


@query("pulls_profile_trend")
def pulls_profile_trend(spark, sf_dir):
    """A4 + F10: the pulls slot's month-of-year profile with its linear fit."""
    prof = S.month_of_year_profile(SI.pulls(SI.Tables(spark, sf_dir)), "created_at")
    return TR.profile_trend(prof).select("repo", "month", "n", r4("yhat").alias("yhat"))


@query("series_bounds")
def series_bounds(spark, sf_dir):
    """A7 + A8: first/last month and number of points of each pull series."""
    b = S.series_bounds(pulls_monthly_series(SI.Tables(spark, sf_dir)))
    return b.select("repo", "first_ds", "last_ds", "n_points")


@query("record_counts")
def record_counts(spark, sf_dir):
    """Records per repository for every entity stand-in."""
    t = SI.Tables(spark, sf_dir)
    parts = [("issues", SI.issues(t)), ("pulls", SI.pulls(t)), ("commits", SI.commits(t)),
             ("branches", SI.branches(t)), ("contributors", SI.contributors(t)), ("releases", SI.releases(t))]
    out = None
    for name, df in parts:
        c = S.record_count(df).select("repo", F.lit(name).alias("entity"), "n_records")
        out = c if out is None else out.unionByName(c)
    return out


@query("pulls_parsed_from_text")
def pulls_parsed_from_text(spark, sf_dir):
    """T1 + T4 + P8 on API-shaped text: order dates rendered as ISO text
    ('...T...Z'), parsed back leniently and by first-ten-characters, then
    counted per day; both parses must agree."""
    from ..functions.timecols import STRICT_FORMAT, parse_time, to_day_text
    p = SI.pulls(SI.Tables(spark, sf_dir)).select(
        "repo", F.date_format("created_at", STRICT_FORMAT).alias("created_text"))
    p = p.select("repo", parse_time("created_text").cast("date").alias("day_ts"),
                 to_day_text("created_text").alias("day_txt"))
    p = C.only_present(p, "day_ts")
    return p.groupBy("repo", F.col("day_txt").alias("ds")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("day_ts") == F.col("day_txt"), 1).otherwise(0))
        .cast("long").alias("n_agree"))


@query("lookback_training_loss")
def lookback_training_loss(spark, sf_dir):
    """objective per iteration of the global look-back model trained
    on the daily created-issue windows of every repository."""
    s = staged(S.gap_fill(issues_daily_series(SI.Tables(spark, sf_dir)), "day"))
    curve, _ = LB.training_loss(s)
    return curve


# ---------------------------------------- landed records, built as JSON text
from ..functions.timecols import STRICT_FORMAT  # noqa: E402
from ..sources import landed as L  # noqa: E402


def _landed(df, entity, record, broken=None):
    """Rows (repo, seq, json): ``record`` as API JSON, cut short where ``broken`` holds."""
    text = F.to_json(record)
    if broken is not None:
        text = F.when(broken, F.substring(text, 1, 12)).otherwise(text)
    return L.parse_records(df.select("repo", "seq", text.alias("json")), entity)


def _iso(c):
    return F.date_format(c, STRICT_FORMAT)


@query("landed_issues")
def landed_issues(spark, sf_dir):
    """S1 + P1 + P8: issues as API JSON, parsed back; some texts are cut
    short (all fields null, dropped), some users are missing."""
    o = SI.Tables(spark, sf_dir).orders.select(F.col("o_orderpriority").alias("repo"), F.col("o_orderkey").alias("seq"),
                                               "o_orderstatus", "o_orderdate", "o_custkey")
    user = F.when(F.col("seq") % 89 != 0, F.struct(F.col("o_custkey").cast("string").alias("login")))
    closed = F.when(F.col("o_orderstatus") == "F", _iso(F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS")))
    rec = F.struct(F.col("seq").alias("number"), _iso("o_orderdate").alias("created_at"), closed.alias("closed_at"),
                   F.lower("o_orderstatus").alias("state"), user.alias("user"))
    out = L.project(_landed(o, "issues", rec, F.col("seq") % 97 == 0), "issues")
    return C.only_present(out, "issue_number")


@query("landed_commits")
def landed_commits(spark, sf_dir):
    """S1 + P2: sha and commit.author.date out of nested JSON; some records have no author."""
    li = SI.Tables(spark, sf_dir).lineitem.select(
        F.col("l_returnflag").alias("repo"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_shipdate")
    author = F.when(F.col("seq") % 83 != 0, F.struct(_iso("l_shipdate").alias("date")))
    rec = F.struct(F.md5(F.col("seq").cast("string")).alias("sha"), F.struct(author.alias("author")).alias("commit"))
    out = L.project(_landed(li, "commits", rec), "commits")
    return out.select("repo", "sha", F.col("date").cast("date").alias("day"))


@query("landed_branches")
def landed_branches(spark, sf_dir):
    """S1 + P3: name and commit.sha with the list position."""
    p = SI.Tables(spark, sf_dir).part.select(F.col("p_brand").alias("repo"), F.col("p_partkey").alias("seq"), "p_name")
    rec = F.struct(F.col("p_name").alias("name"),
                   F.struct(F.md5(F.col("seq").cast("string")).alias("sha")).alias("commit"))
    return L.project(_landed(p, "branches", rec), "branches")


@query("landed_contributors")
def landed_contributors(spark, sf_dir):
    """S1 + P4: a missing login is 'unknown', missing contributions are 0."""
    c = SI.Tables(spark, sf_dir).customer.select(
        F.col("c_mktsegment").alias("repo"), F.col("c_custkey").alias("seq"), "c_name")
    rec = F.struct(F.when(F.col("seq") % 7 != 0, F.col("c_name")).alias("login"),
                   F.when(F.col("seq") % 11 != 0, F.col("seq") % 100).alias("contributions"))
    return L.project(_landed(c, "contributors", rec), "contributors")


@query("landed_releases")
def landed_releases(spark, sf_dir):
    """S1 + P5 + P9 + T2: names default to 'unknown', unpublished releases
    are dropped, times that miss the strict format become null."""
    o = SI.Tables(spark, sf_dir).orders.select(F.col("o_orderpriority").alias("repo"), F.col("o_orderkey").alias("seq"),
                                               "o_orderdate")
    at = F.when(F.col("seq") % 5 == 0, F.lit(None).cast("string")).when(F.col("seq") % 7 == 0, F.lit("")) \
        .when(F.col("seq") % 11 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(_iso("o_orderdate"))
    rec = F.struct(F.when(F.col("seq") % 3 != 0, F.col("seq").cast("string")).alias("name"), at.alias("published_at"))
    out = L.project(_landed(o, "releases", rec), "releases")
    return out.select("repo", "name", F.col("published_at").cast("date").alias("day"))


@query("landed_repositories")
def landed_repositories(spark, sf_dir):
    """Stars and forks from repository objects, missing counts are 0."""
    n = SI.Tables(spark, sf_dir).nation.select(F.col("n_name").alias("repo"), F.col("n_nationkey").cast("long").alias("seq"))
    rec = F.struct(F.col("repo").alias("full_name"),
                   F.when(F.col("seq") % 3 != 0, F.col("seq") * 10).alias("stargazers_count"),
                   F.when(F.col("seq") % 4 != 0, F.col("seq")).alias("forks_count"))
    return L.repository_facts(_landed(n, "repository", rec))


@query("issues_refetched")
def issues_refetched(spark, sf_dir):
    """S3 + P13: a first fetch without closing dates, then a second fetch of
    every record; per record the last fetched copy stays."""
    iss = SI.issues(SI.Tables(spark, sf_dir)).select("repo", "issue_number", "created_at", "closed_at")
    first = iss.withColumn("closed_at", F.lit(None).cast("date")).withColumn("fetch", F.lit(1))
    both = L.concat_pages(first, iss.withColumn("fetch", F.lit(2)))
    return C.dedupe_records(both, ["repo", "issue_number"], "fetch").drop("fetch")


@query("commits_of_selected_repositories")
def commits_of_selected_repositories(spark, sf_dir):
    """S6 + A3: monthly commits of the repositories on a list (those with an
    open line of 1995), by a semi join."""
    t = SI.Tables(spark, sf_dir)
    listed = t.lineitem.where((F.col("l_linestatus") == "O") & (F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz"))) \
        .select(F.col("l_returnflag").alias("repo"))
    return _series_out(S.monthly_count(L.restrict_to(SI.commits(t), listed), "date", "commits"))


@query("order_value_series")
def order_value_series(spark, sf_dir):
    """Any time and value column as a series, here summed per month."""
    o = SI.Tables(spark, sf_dir).orders.withColumn("repo", F.col("o_orderpriority"))
    p = C.project_series(o, "o_orderdate", "o_totalprice", "order_value")
    return p.groupBy("repo", F.trunc(F.col("ds").cast("date"), "MM").alias("ds")).agg(F.round(F.sum("y"), 2).alias("y"))


@query("missing_column_status")
def missing_column_status(spark, sf_dir):
    """A pulls landing without created_at gives 'no_column' for every slot."""
    p = SI.pulls(SI.Tables(spark, sf_dir)).drop("created_at")
    return EL.missing_column_status(p, "pulls", ["created_at"])


def recent_monthly(df, time_col, metric):
    return S.monthly_count(C.since(df, time_col, SI.AS_OF, 730), time_col, metric)


@query("pulls_recent_monthly")
def pulls_recent_monthly(spark, sf_dir):
    """P7 + A3: monthly pulls of the last two years, as the report asks for them."""
    return _series_out(recent_monthly(SI.pulls(SI.Tables(spark, sf_dir)), "created_at", "pulls"))


@query("commits_recent_monthly")
def commits_recent_monthly(spark, sf_dir):
    """P7 + A3: monthly commits of the last two years."""
    return _series_out(recent_monthly(SI.commits(SI.Tables(spark, sf_dir)), "date", "commits"))


@query("recent_releases_smoothing")
def recent_releases_smoothing(spark, sf_dir):
    """P7 + A3 + F3: the smoothing dispatch on series of at most two years,
    where both branches run (24 months or more, 6 to 23 months)."""
    s = recent_monthly(SI.releases(SI.Tables(spark, sf_dir)), "published_at", "releases")
    return _fc_out(SM.smoothing_forecast(staged(s)))


# ------------------------------- the least-squares family at closed-form sizes
@query("ar2_forecast")
def ar2_forecast(spark, sf_dir):
    """F4 + K1: ARIMA(2,1,0) on monthly commits, small enough for a written-out solve."""
    return _fc_out(AR.ar_forecast(staged(commits_monthly_series(SI.Tables(spark, sf_dir))), 2))


@query("arma_short_forecast")
def arma_short_forecast(spark, sf_dir):
    """F5 + K1: ARIMA(1,1,1) with a first stage of two lags, on monthly pulls."""
    s = staged(pulls_monthly_series(SI.Tables(spark, sf_dir)))
    return _fc_out(AR.arma_forecast(s, m=2))


@query("lookback1_forecast")
def lookback1_forecast(spark, sf_dir):
    """F9 + K1: the look-back model with one day, on filled daily pulls."""
    fc = LB.lookback_forecast(staged(pulls_daily_filled(SI.Tables(spark, sf_dir))), k=1)
    return fc.select("repo", "model", "segment", "ds", "y", r4("yhat").alias("yhat"))


@query("forecast_tail")
def forecast_tail(spark, sf_dir):
    """The last three points of each smoothing forecast."""
    fc = SM.smoothing_forecast(staged(releases_monthly_series(SI.Tables(spark, sf_dir))))
    return S.forecast_tail(fc, 3).select("repo", "model", "ds", r4("yhat").alias("yhat"))


@query("supplier_commits_additive")
def supplier_commits_additive(spark, sf_dir):
    """F7 + F8 over many repositories at once: monthly line items of every supplier."""
    li = SI.Tables(spark, sf_dir).lineitem.select(
        F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")).alias("repo"), F.col("l_shipdate").alias("date"))
    return _band_out(AD.additive_forecast(staged(S.monthly_count(li, "date", "commits")), "month"))


# ------------------------------------------------ training, curves, back-tests
from ..operators import backtest as BT  # noqa: E402
from ..operators import smooth as SMO  # noqa: E402
from ..operators import training as TRN  # noqa: E402
from . import publish as PUB  # noqa: E402


def _issues_filled(spark, sf_dir):
    return staged(S.gap_fill(issues_daily_series(SI.Tables(spark, sf_dir)), "day"))


def _curve_out(curve):
    return curve.select("repo", "epoch", r4("train_loss").alias("train_loss"), r4("val_loss").alias("val_loss"), "best", "stopped")


@query("lookback_training_curve")
def lookback_training_curve(spark, sf_dir):
    """train and validation loss by epoch of every repository's look-back
    model on daily issues, with early stop."""
    return _curve_out(TRN.training_curve(_issues_filled(spark, sf_dir)))


@query("lookback1_training_curve")
def lookback1_training_curve(spark, sf_dir):
    """F11 with one day of look-back, on filled daily pulls."""
    return _curve_out(TRN.training_curve(staged(pulls_daily_filled(SI.Tables(spark, sf_dir))), k=1))


def _lookback_out(fc):
    return fc.select("repo", "model", "segment", "ds", "y", r4("yhat").alias("yhat"))


@query("lookback_network_forecast")
def lookback_network_forecast(spark, sf_dir):
    """F9 + F11: a network over the look-back windows of all repositories' daily issues."""
    return _lookback_out(TRN.network_forecast(_issues_filled(spark, sf_dir), epochs=20)[0])


@query("lookback_network_curve")
def lookback_network_curve(spark, sf_dir):
    """the network's losses by epoch (weekly look-back, daily pulls)."""
    return TRN.network_forecast(staged(pulls_daily_filled(SI.Tables(spark, sf_dir))), k=7, epochs=15)[1]


@query("lookback_trees_forecast")
def lookback_trees_forecast(spark, sf_dir):
    """boosted trees over the look-back windows of daily issues."""
    return _lookback_out(TRN.tree_forecast(_issues_filled(spark, sf_dir)))


def _smooth_out(df):
    return df.select("repo", "ds", "idx", "y", r4("yhat").alias("yhat"), "penalty", r4("loo").alias("loo"))


@query("smooth_trend")
def smooth_trend(spark, sf_dir):
    """F10 as a smooth curve of the month index, monthly pulls."""
    return _smooth_out(SMO.smooth_trend(staged(pulls_monthly_series(SI.Tables(spark, sf_dir)))))


@query("smooth_trend_two_knots")
def smooth_trend_two_knots(spark, sf_dir):
    """F10 with two bends and three penalties, small enough for a written-out solve."""
    s = staged(pulls_monthly_series(SI.Tables(spark, sf_dir)))
    return _smooth_out(SMO.smooth_trend(s, knots=2, degree=1, penalties=[1e-4, 1e-2, 1.0]))


@query("smoothing_refined_forecast")
def smoothing_refined_forecast(spark, sf_dir):
    """F1 to F3 with continuous parameters, monthly releases."""
    return _fc_out(SM.smoothing_forecast(staged(releases_monthly_series(SI.Tables(spark, sf_dir))), refine=True))


@query("additive_sparse_forecast")
def additive_sparse_forecast(spark, sf_dir):
    """F7 + F8 with sparse changepoints and a band that widens with the horizon."""
    return _band_out(AD.additive_forecast(staged(pulls_monthly_series(SI.Tables(spark, sf_dir))), "month", sparse=True))


def _comparison_out(fc):
    return BT.rolling_comparison(fc).select("repo", "model", "n", r4("mse").alias("mse"), "rank")


@query("rolling_comparison")
def rolling_comparison(spark, sf_dir):
    """All model families by their error from six origins, monthly pulls."""
    return _comparison_out(BT.rolling_forecasts(pulls_monthly_series(SI.Tables(spark, sf_dir))))


@query("rolling_comparison_plain")
def rolling_comparison_plain(spark, sf_dir):
    """E3 of index trend and SES from six origins, monthly pulls."""
    return _comparison_out(BT.rolling_forecasts(pulls_monthly_series(SI.Tables(spark, sf_dir)), ("index_trend", "ses")))


@query("units_synthetic_months")
def units_synthetic_months(spark, sf_dir):
    """T8 over long undated lists: one entry for every unit sold."""
    return TL.synthetic_months(SI.commit_units(SI.Tables(spark, sf_dir)), SI.AS_OF, "units") \
        .select("repo", "ds", "y", "n", "status")


@query("issue_month_maps")
def issue_month_maps(spark, sf_dir):
    """R1's month -> count maps, entry by entry."""
    return R.month_entries(R.issue_report(_issues_windowed(spark, sf_dir)))


@query("published_forecasts")
def published_forecasts(spark, sf_dir):
    """Monthly pulls' SES forecasts published over an earlier state that
    had half of the repositories and other values, then read back."""
    from uuid import uuid4

    from ..session import checkpoint_dir
    fc = staged(SM.ses_forecast(pulls_monthly_series(SI.Tables(spark, sf_dir)))) \
        .select("repo", "metric", "model", "ds", r4("yhat").alias("yhat"))
    path = f"{checkpoint_dir(spark)}/tidecast-published-{uuid4().hex}"
    PUB.write_forecasts(fc.where("hash(repo) % 2 = 0").withColumn("yhat", F.lit(0.0)), path)
    PUB.write_forecasts(fc, path)
    return PUB.read_forecasts(spark, path).select("repo", "metric", "model", "ds", "yhat")


def _points(li, prefix, y):
    return li.select(F.concat(F.lit(prefix), F.col("l_returnflag")).alias("repo"), F.lit("commits").alias("metric"), "ds",
                     y.cast("double").alias("y"), "n")


@query("status_report_fits")
def status_report_fits(spark, sf_dir):
    """R3 with every status, P11 included: line items as commits under valid and
    invalid keys, young repositories, one release a month (nothing for an
    autoregression to explain), and revenue on a scale that overflows."""
    from pyspark.sql import Window
    t = SI.Tables(spark, sf_dir)
    li = staged(t.lineitem.groupBy("l_returnflag", F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("ds")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("v")))
    first = li.withColumn("t", F.row_number().over(Window.partitionBy("l_returnflag").orderBy("ds"))).where("t <= 5")
    series = _points(li, "lineitem/", F.col("n"))
    for part in (_points(li, "", F.col("n")), _points(li, "train/", F.lit(1)), _points(li, "overflow/", F.exp(F.col("v").cast("double"))),
                 _points(first, "young/", F.col("n"))):
        series = series.unionByName(part)
    series = staged(series)
    status = staged(EL.eligibility(EL.series_counts(series, SI.repositories(t), ["commits"])))
    fc = AR.ar_forecast(EL.eligible_series(series.drop("n"), status, "statsmodels"), 5).withColumn("slot", F.lit("statsmodels"))
    third = status.where(F.col("slot") == "statsmodels")
    out = R.status_report(status, PL.fit_status(fc, third)).drop("key_status")
    return out.unionByName(EL.missing_column_status(SI.pulls(t).drop("created_at"), "pulls", ["created_at"]))


# ------------------------------------------------------ the dashboard's tables
@query("dashboard_bars")
def dashboard_bars(spark, sf_dir):
    """The two bar series of every repository, in the order drawn."""
    return PL.bar_series(_issues_windowed(spark, sf_dir))


@query("dashboard_insights")
def dashboard_insights(spark, sf_dir):
    """The three insights of the issues on the page."""
    return I.issue_insights(_issues_windowed(spark, sf_dir))


@query("dashboard_charts")
def dashboard_charts(spark, sf_dir):
    """Points behind the trend and smoothing charts of five metrics, one staged series for all."""
    t = SI.Tables(spark, sf_dir)
    s = report_series(t, MONTHLY)
    st = staged(metric_statuses(t, s, MONTHLY))
    points = s.select("repo", "metric", "ds", "y")
    trend = TR.index_trend_fit(W.split_hashed(EL.eligible_series(points, st, "lstm")))
    smooth = SM.smoothing_forecast(EL.eligible_series(points, st, "statsmodels"))
    return trend.select("repo", "metric", F.lit("lstm").alias("slot"), F.lit("index_trend").alias("model"), "ds", "y",
                        r4("yhat").alias("yhat")).unionByName(
        smooth.select("repo", "metric", F.lit("statsmodels").alias("slot"), "model", "ds", F.lit(None).cast("double").alias("y"),
                      r4("yhat").alias("yhat")))


@query("dashboard_page")
def dashboard_page(spark, sf_dir):
    """Every table of the page in one frame, from one staged forecast table."""
    return PL.page_rows(PL.dashboard_tables(SI.Tables(spark, sf_dir)))
