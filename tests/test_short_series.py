"""No series is too short to run: every model next to a normal series."""

import datetime as dt

import pytest

from tidecast.operators import additive as AD
from tidecast.operators import ar as AR
from tidecast.operators import lookback as LB
from tidecast.operators import order_search as OS
from tidecast.operators import smoothing as SM
from tidecast.operators import trend as TR
from tidecast.operators import windows as W

from .helpers import daily_frame, monthly_frame

LENGTHS = [1, 2, 3, 5, 6, 11, 12, 23, 24]
MODELS = {
    "ar5": lambda s: AR.ar_forecast(s, 5), "ar1": AR.ar1_forecast, "arma": AR.arma_forecast,
    "additive": lambda s: AD.additive_forecast(s, "month"), "smoothing": SM.smoothing_forecast,
    "trend": lambda s: TR.index_trend_fit(W.split_hashed(s)),
}


def frames(spark, make, normal):
    out = make(spark, [3.0 + (i * 7) % 5 for i in range(normal)], repo="o/normal")
    for n in LENGTHS:
        out = out.unionByName(make(spark, [1.0 + i % 3 for i in range(n)], repo=f"o/r{n}"))
    return out.cache()


@pytest.mark.parametrize("model", list(MODELS))
def test_monthly_models(spark, model):
    rows = MODELS[model](frames(spark, monthly_frame, 36)).collect()
    assert "o/normal" in {r["repo"] for r in rows}


def test_daily_models(spark):
    s = frames(spark, daily_frame, 120)
    assert "o/normal" in {r["repo"] for r in LB.lookback_forecast(s).collect()}
    assert "o/normal" in {r["repo"] for r in AD.additive_forecast(s, "day").collect()}
    split = W.split_ordered(s)
    train = split.where("split = 'train'").select("repo", "metric", "ds", "y")
    h = split.where("split = 'test'").groupBy("repo", "metric").count().selectExpr("repo", "metric", "cast(count as int) h")
    assert "o/normal" in {r["repo"] for r in OS.order_search_forecast(train, h).collect()}


def test_kpss_has_no_lag_ceiling(spark):
    """At 14,000 points the formula asks for 13 lags; all of them count."""
    import numpy as np
    rng = np.random.default_rng(0)
    x = np.zeros(14_000)
    for i in range(1, len(x)):
        x[i] = 0.9 * x[i - 1] + rng.normal()
    rows = [("a/b", "m", dt.date(1980, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)]
    got = AR.kpss_level(spark.createDataFrame(rows, "repo STRING, metric STRING, ds DATE, y DOUBLE")).first().kpss
    e, n = x - x.mean(), len(x)
    lags = int(np.floor(4 * (n / 100) ** 0.25))
    lrv = (e @ e + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / n
    assert lags == 13 and got == pytest.approx((np.cumsum(e) ** 2).sum() / (n * n * lrv), rel=1e-8)
