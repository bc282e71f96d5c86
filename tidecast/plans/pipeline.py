"""The whole dashboard as one Spark job (R5): every metric's series, its
gates, and the three model slots, for all repositories at once.

All series are derived once and persisted (every model reads them; the
reference re-derived them per model call). Each slot only fits the
series that pass its gate (left semi join against the status table).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import KEYS
from ..operators import additive as AD
from ..operators import ar as AR
from ..operators import clean as C
from ..operators import eligibility as EL
from ..operators import lookback as LB
from ..operators import order_search as OS
from ..operators import series as S
from ..operators import smoothing as SM
from ..operators import timeline as TL
from ..operators import trend as TR
from ..operators import windows as W
from ..session import cut_lineage
from ..sources import standins as SI
from ..sources import windows as SW
from . import report as R

OUT = ["repo", "metric", "slot", "model", "segment", "ds", "y", "yhat", "yhat_lower", "yhat_upper", "fit_flag"]


def _norm(df: DataFrame, slot: str, segment: str | None = None) -> DataFrame:
    cols = set(df.columns)
    sel = []
    for c in OUT:
        if c == "slot":
            sel.append(F.lit(slot).alias("slot"))
        elif c == "segment" and "segment" not in cols:
            sel.append(F.lit(segment or "forecast").alias("segment"))
        elif c in cols:
            sel.append(F.col(c))
        elif c == "fit_flag":
            sel.append(F.lit(None).cast("string").alias(c))
        else:
            sel.append(F.lit(None).cast("double").alias(c))
    return df.select(*sel)


def entity_series(t: SI.Tables, as_of: _dt.date = SI.AS_OF, since_days: int | None = 730) -> dict[str, DataFrame]:
    """Points (repo, metric, ds, y, n) of every metric.

    As the report asks for them: issues of the 12 windows before ``as_of``,
    pulls, commits and releases of the last ``since_days`` days (None: all);
    branches and contributors have no dates and come whole.
    """
    def recent(df, col):
        return df if since_days is None else C.since(df, col, as_of, since_days)

    if since_days is None:
        iss = SI.issues(t)
    else:
        iss = SW.records_in_windows(SI.issues(t, since=SW.window_bounds(as_of)[-1][1]), as_of, "created_at")
    out = {
        "issues": S.gap_fill(S.daily_series(iss, "created_at", "issues"), "day"),
        "issues_closed": S.gap_fill(S.daily_series(iss, "closed_at", "issues_closed"), "day"),
        "pulls": S.monthly_count(recent(SI.pulls(t), "created_at"), "created_at", "pulls"),
        "commits": S.monthly_count(recent(SI.owned_commits(t), "date"), "date", "commits"),
        "branches": TL.synthetic_monthly(SI.branches(t), as_of, "branches"),
        "releases": S.gap_fill(S.monthly_count(recent(SI.releases(t), "published_at"), "published_at", "releases"), "month"),
    }
    out = {m: s.withColumn("n", F.col("y").cast("long")) for m, s in out.items()}
    out["contributors"] = TL.synthetic_monthly(SI.contributors(t), as_of, "contributors", "contributions", with_n=True)
    return out


def status_table(t: SI.Tables, series: DataFrame) -> DataFrame:
    """P12 for every known repository and metric, counted on the staged series."""
    metrics = ["issues", "issues_closed", "pulls", "commits", "branches", "contributors", "releases"]
    counts = EL.series_counts(series, SI.repositories(t), metrics)
    # issues_closed follows the issue gates
    counts = counts.withColumn("_m", F.when(F.col("metric") == "issues_closed", F.lit("issues"))
                               .otherwise(F.col("metric")))
    return EL.eligibility(counts, gate_metric="_m")


def all_forecasts(t: SI.Tables, as_of: _dt.date = SI.AS_OF, since_days: int | None = 730):  # noqa: C901
    """(forecasts, status) for every metric x slot. Forecast rows follow
    ``OUT``; ``status`` is the R3 table."""
    series = None
    for s in entity_series(t, as_of, since_days).values():
        s = s.select("repo", "metric", "ds", "y", "n")
        series = s if series is None else series.unionByName(s)
    series = cut_lineage(series)
    status = cut_lineage(status_table(t, series))
    series = series.drop("n")

    def ok(metrics, slot):
        return EL.eligible_series(series.where(F.col("metric").isin(*metrics)), status, slot)

    daily = ("issues", "issues_closed")
    monthly = ("pulls", "commits", "branches", "contributors", "releases")
    # one fit per model over every metric it serves: operators are keyed by
    # (repo, metric), so the metrics simply add keys to the same job
    out = [_norm(LB.lookback_forecast(ok(daily, "lstm")), "lstm"),
           _norm(AD.additive_forecast(ok(daily, "prophet"), "day"), "prophet")]
    s = W.split_ordered(ok(daily, "statsmodels"))
    train = s.where(F.col("split") == "train").select(*KEYS, "ds", "y")
    h = s.where(F.col("split") == "test").groupBy(*KEYS).agg(F.count(F.lit(1)).cast("int").alias("h"))
    fc = OS.order_search_forecast(train, h).withColumn("segment", F.lit("test"))
    fc = fc.join(s.where(F.col("split") == "test").select(*KEYS, "ds", "y"), [*KEYS, "ds"], "left")
    out.append(_norm(fc, "statsmodels"))
    tr = TR.index_trend_fit(W.split_hashed(ok(monthly, "lstm"))).withColumn("model", F.lit("index_trend")) \
        .withColumn("segment", F.col("split"))
    out.append(_norm(tr, "lstm"))
    out.append(_norm(AD.additive_forecast(ok(monthly[:-1], "prophet"), "month"), "prophet"))
    # releases: month-end continuation, last 12 rows only (the release endpoint's view)
    out.append(_norm(S.forecast_tail(AD.additive_forecast(ok(("releases",), "prophet"), "month",
                                                          month_end=True), 12), "prophet"))
    out.append(_norm(SM.smoothing_forecast(ok(("pulls",), "statsmodels"), refine=True), "statsmodels"))
    out.append(_norm(AR.ar_forecast(ok(("commits", "branches"), "statsmodels"), 5), "statsmodels"))
    out.append(_norm(AR.arma_forecast(ok(("contributors", "releases"), "statsmodels")), "statsmodels"))
    res = out[0]
    for x in out[1:]:
        res = res.unionByName(x)
    return res, status


def fit_status(forecasts: DataFrame, status: DataFrame) -> DataFrame:
    """Per (repo, metric, slot) that passed its gate: 'failed' when a
    forecast value is not finite, 'not_enough_data' when the estimator
    produced no rows (e.g. no 30-day window fits in the test part),
    'degenerate' when the fit was rank deficient."""
    fc = forecasts.groupBy("repo", "metric", "slot").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(F.when(F.col("yhat").isNull() | F.isnan("yhat") | (F.abs("yhat") == float("inf")), 1).otherwise(0)).alias("_bad"),
        F.max(F.col("fit_flag")).alias("_flag"))
    ok = status.where(F.col("status") == "ok").select("repo", "metric", "slot")
    j = ok.join(fc, ["repo", "metric", "slot"], "left")
    st = (F.when(F.col("_rows").isNull(), F.lit("not_enough_data"))
           .when(F.col("_bad") > 0, F.lit("failed"))
           .when(F.col("_flag").isNotNull(), F.col("_flag")))
    return j.select("repo", "metric", "slot", st.alias("fit_status")).where(F.col("fit_status").isNotNull())


def bar_series(issues: DataFrame) -> DataFrame:
    """(repo, event, month, n, position): created and closed issues by month, in the order drawn."""
    from pyspark.sql import Window
    both = None
    for event in ("created", "closed"):
        part = S.count_by_month_text(issues, f"{event}_at").select("repo", F.lit(event).alias("event"), "month", "n")
        both = part if both is None else both.unionByName(part)
    w = Window.partitionBy("repo", "event").orderBy("month")  # months of the page's windows
    return both.withColumn("position", F.row_number().over(w).cast("long"))


def page_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables of ``dashboard_tables`` as (section, repo, metric, slot,
    label, ds, value, text) rows: statuses, bars, insights and charts."""
    def rows(df, section, **cols):
        every = {"repo": "repo", "metric": "CAST(NULL AS STRING)", "slot": "CAST(NULL AS STRING)", "label": "CAST(NULL AS STRING)",
                 "ds": "CAST(NULL AS DATE)", "value": "CAST(NULL AS DOUBLE)", "text": "CAST(NULL AS STRING)"} | cols
        return df.selectExpr(f"'{section}' AS section", *(f"{v} AS {c}" for c, v in every.items()))

    out = rows(tables["status"], "status", metric="metric", slot="slot", label="estimator", text="status")
    out = out.unionByName(rows(tables["bars"], "bars", metric="'issues'", label="event", text="month", value="CAST(n AS DOUBLE)"))
    for name in ("max_created_day_of_week", "max_closed_day_of_week", "max_closed_month_of_year"):
        out = out.unionByName(rows(tables["issue_report"], "insights", metric="'issues'", label=f"'{name}'", text=name))
    return out.unionByName(rows(tables["forecasts"], "charts", metric="metric", slot="slot", label="concat(model, ' ', segment)",
                                ds="ds", value="yhat"))


def dashboard_tables(t: SI.Tables, as_of: _dt.date = SI.AS_OF) -> dict[str, DataFrame]:
    """Everything the page shows, for every repository.

    The forecasts are written once (checkpoint) and every table below
    reads them, so no model is fitted twice.
    """
    fc, status = all_forecasts(t, as_of)
    fc = cut_lineage(fc)
    issues = SW.records_in_windows(SI.issues(t, since=SW.window_bounds(as_of)[-1][1]), as_of, "created_at")
    out = {"forecasts": fc, "status": R.status_report(status, fit_status(fc, status)),
           "bars": bar_series(issues), "issue_report": R.issue_report(issues, forecasts=fc.where(F.col("metric") == "issues"))}
    for m in ("pulls", "commits", "branches", "contributors", "releases"):
        out[f"{m}_report"] = R.metric_report(status, m, fc)
    return out
