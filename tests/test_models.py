"""Model operators against independent plain-numpy code, and recovery tests."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import additive as AD
from tidecast.operators import ar as AR
from tidecast.operators import lookback as LB
from tidecast.operators import order_search as OS
from tidecast.operators import smoothing as SM
from tidecast.plans import catalog as CAT
from tidecast.sources import standins as SI

from .conftest import SF0001
from .helpers import daily_frame, monthly_frame


def np_ses(y):
    best = None
    for i in range(1, 100):
        a = i / 100.0
        level, sse = y[0], 0.0
        for v in y[1:]:
            sse += (v - level) * (v - level)
            level = a * v + (1.0 - a) * level
        cand = (sse, a, level)
        if best is None or cand < best:
            best = cand
    return best


def np_hw(y, m=12):
    best = None
    l0 = sum(y[:m]) / m
    s0 = [v - l0 for v in y[:m]]
    for i in range(1, 20):
        for j in range(1, 20):
            a, g = i / 20.0, j / 20.0
            if g > 1.0 - a + 1e-9:
                continue
            level, season, sse = l0, list(s0), 0.0
            for t, v in enumerate(y):
                s = season[t % m]
                sse += (v - level - s) ** 2
                new_level = a * (v - s) + (1 - a) * level
                season[t % m] = g * (v - level) + (1 - g) * s
                level = new_level
            cand = (sse, a, g)
            if best is None or cand[0] < best[0] - 1e-9 or (abs(cand[0] - best[0]) <= 1e-9 and cand[1:] < best[1:]):
                best = cand + (level, list(season))
    sse, a, g, level, season = best
    n = len(y)
    return a, g, [level + season[(n - 1 + h) % m] for h in range(1, 13)]


def np_ar_forecast(y, p=5, h=12):
    dy = np.diff(y)
    X = np.column_stack([dy[p - i - 1:len(dy) - i - 1] for i in range(p)])
    beta = np.linalg.lstsq(X, dy[p:], rcond=None)[0]
    hist, lvl, out = list(dy), y[-1], []
    for _ in range(h):
        d = sum(beta[i] * hist[-1 - i] for i in range(p))
        hist.append(d)
        lvl += d
        out.append(lvl)
    return beta, out


@pytest.fixture(scope="module")
def pulls(spark):
    s = CAT.pulls_monthly_series(SI.Tables(spark, SF0001))
    pdf = s.toPandas().sort_values(["repo", "ds"])
    return s, {r: g.y.tolist() for r, g in pdf.groupby("repo")}


def test_ses_matches_numpy(pulls):
    s, series = pulls
    fit = {r.repo: r for r in SM.ses_fit(s).collect()}
    for repo, y in series.items():
        sse, a, level = np_ses(y)
        assert fit[repo].alpha == pytest.approx(a)
        assert fit[repo].level == pytest.approx(level, abs=1e-8)
        assert fit[repo].sse == pytest.approx(sse, abs=1e-6)


def test_holt_winters_matches_numpy(pulls):
    s, series = pulls
    fc = SM.hw_forecast(s).toPandas()
    for repo, y in series.items():
        a, g, path = np_hw(y)
        got = fc[fc.repo == repo].sort_values("step")
        assert got.alpha.iloc[0] == pytest.approx(a)
        assert got.gamma.iloc[0] == pytest.approx(g)
        assert got.yhat.tolist() == pytest.approx(path, abs=1e-6)


def test_ar5_matches_numpy(spark):
    s = CAT.commits_monthly_series(SI.Tables(spark, SF0001))
    pdf = s.toPandas().sort_values(["repo", "ds"])
    fc = AR.ar_forecast(s, 5).toPandas()
    for repo, g in pdf.groupby("repo"):
        _, path = np_ar_forecast(g.y.to_numpy())
        got = fc[fc.repo == repo].sort_values("step").yhat.tolist()
        assert got == pytest.approx(path, abs=1e-6)


def test_ar1_recovers_phi(spark):
    rng = np.random.default_rng(7)
    phi, d, y = 0.6, [0.0], [100.0]
    for _ in range(600):
        d.append(phi * d[-1] + rng.normal())
        y.append(y[-1] + d[-1])
    s = daily_frame(spark, y)
    got = AR.ar1_forecast(s, unit="day").select("phi").first().phi
    assert got == pytest.approx(phi, abs=0.08)


def test_arma_recovers_parameters(spark):
    rng = np.random.default_rng(11)
    phi, theta = 0.5, 0.3
    e = rng.normal(size=3000)
    d = [0.0]
    for t in range(1, 3000):
        d.append(phi * d[-1] + e[t] + theta * e[t - 1])
    y = np.cumsum(d) + 50
    s = daily_frame(spark, y.tolist())
    f = AR.arma_fit(s).first()
    assert f.phi == pytest.approx(phi, abs=0.1)
    assert f.theta == pytest.approx(theta, abs=0.1)
    assert AR.arma_forecast(s, unit="day").count() == 12


def np_kpss(x):
    e = x - x.mean()
    S = np.cumsum(e)
    n = len(e)
    lag = int(4 * (n / 100) ** 0.25)
    lrv = (e @ e + 2 * sum((1 - k / (lag + 1)) * (e[k:] @ e[:-k]) for k in range(1, lag + 1))) / n
    return (S @ S) / (n * n * lrv)


def test_kpss_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300).cumsum() * 0.3 + rng.normal(size=300)
    got = AR.kpss_level(daily_frame(spark, x.tolist())).first().kpss
    assert got == pytest.approx(np_kpss(x), rel=1e-9)


def test_auto_order_picks_differencing(spark):
    # seed 0: the walk's KPSS statistic is far above 0.463, the noise's far below
    rng = np.random.default_rng(0)
    walk = np.cumsum(rng.normal(size=400)) + 10
    noise = rng.normal(size=400) + 10
    s = daily_frame(spark, walk.tolist(), repo="w/alk").unionByName(daily_frame(spark, noise.tolist(), repo="n/oise"))
    d = {r.repo: r.d for r in OS.order_search(s).collect()}
    assert d == {"w/alk": 1, "n/oise": 0}


def test_additive_recovers_line_plus_season(spark):
    vals = [10 + 0.5 * i + 3 * math.sin(2 * math.pi * i / 12) for i in range(60)]
    s = monthly_frame(spark, vals)
    fc = AD.additive_forecast(s, "month").toPandas()
    h = fc[fc.segment == "train"]
    r2 = 1 - ((h.y - h.yhat) ** 2).sum() / ((h.y - h.y.mean()) ** 2).sum()
    assert r2 > 0.99
    fut = fc[fc.segment == "forecast"].sort_values("ds")
    assert len(fut) == 12
    assert str(fut.ds.iloc[0]) == "2025-01-01"


def test_constant_series_every_model_forecasts_constant(spark):
    s = monthly_frame(spark, [7.0] * 24)
    for fc in (SM.ses_forecast(s), SM.hw_forecast(s), AR.ar_forecast(s, 5), AR.arma_forecast(s)):
        vals = [r.yhat for r in fc.collect()]
        assert len(vals) == 12 and vals == pytest.approx([7.0] * 12, abs=1e-6)
    add = AD.additive_forecast(s, "month").where(F.col("segment") == "forecast").collect()
    assert [r.yhat for r in add] == pytest.approx([7.0] * 12, abs=1e-3)


def test_lookback_window_counts(spark):
    n = 200
    vals = [float(i % 7) for i in range(n)]
    s = daily_frame(spark, vals)
    fc = LB.lookback_forecast(s).toPandas()
    n_train = int(n * 0.8)
    assert (fc.segment == "train").sum() == max(0, n_train - 30)
    assert (fc.segment == "test").sum() == max(0, n - n_train - 30)
    # a weekly pattern is learnt exactly by a 30-day linear look-back
    assert np.allclose(fc.y, fc.yhat, atol=0.05)


def test_training_loss_curve(spark):
    s = daily_frame(spark, [float(i % 5) for i in range(200)])  # test part: 40 days -> 10 windows
    curve, ev = LB.training_loss(s, max_iter=10)
    losses = [r.loss for r in curve.orderBy("iteration").collect()]
    assert 1 <= len(losses) <= 11 and losses[-1] <= losses[0]
    assert {r.split for r in ev.collect()} == {"train", "test"}


def test_rank_deficient_fit_is_flagged(spark):
    # a linear ramp has constant differences: the AR(5) lag matrix has rank 1
    s = monthly_frame(spark, [float(i) for i in range(30)])
    flags = {r.fit_flag for r in AR.ar_forecast(s, 5).collect()}
    assert flags == {"degenerate"}
    ok = AR.ar_forecast(CAT.commits_monthly_series(SI.Tables(spark, SF0001)), 5)
    assert {r.fit_flag for r in ok.collect()} == {None}


def test_solve_matches_lstsq(spark):
    """K1 over stacked series: coefficients, residuals and rank as numpy's, also when rank is missing."""
    import numpy as np

    from tidecast.operators import linalg as LA
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for k in range(6):
        x = rng.normal(size=(40, 3))
        if k == 4:
            x[:, 2] = x[:, 1]  # rank 2
        y = x @ np.array([1.0, -2.0, 0.5]) + (0.0 if k == 5 else 0.1) * rng.normal(size=40)
        beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
        want[f"o/{k}"] = (beta, float(((y - x @ beta) ** 2).sum()), rank, float(y @ y))
        rows += [(f"o/{k}", "m", [float(v) for v in a], float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "repo STRING, metric STRING, x ARRAY<DOUBLE>, y DOUBLE").repartition(3)
    got = LA.solve(LA.gram(df, ["repo", "metric"], "x", "y", 3), 3).collect()
    assert len(got) == 6
    for r in got:
        beta, sse, rank, yy = want[r["repo"]]
        assert r["n"] == 40 and r["fit"]["rank"] == rank
        assert np.allclose(r["fit"]["beta"], beta, atol=1e-8)
        assert abs(r["fit"]["sse"] - sse) <= 1e-10 * yy  # an exact fit is 0 up to the rounding of y'y
