"""Prefix sums and kept states give what refits from scratch give."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import ar as AR
from tidecast.operators import backtest as BT
from tidecast.operators import smoothing as SM
from tidecast.operators import trend as TR

from .helpers import monthly_frame

RNG = np.random.default_rng(9)
Y = {"a/season": [30 + 0.2 * i + 8 * math.sin(i * math.pi / 6) + RNG.normal() for i in range(64)],
     "a/walk": (40 + np.cumsum(RNG.normal(size=50))).tolist(),
     "a/just": [5.0 + i % 4 for i in range(27)], "a/short": [1.0, 2.0, 3.0]}


@pytest.fixture(scope="module")
def series(spark):
    df = None
    for repo, y in Y.items():
        s = monthly_frame(spark, y, repo=repo)
        df = s if df is None else df.unionByName(s)
    return df.cache()


@pytest.fixture(scope="module")
def found(series):
    rows = BT.rolling_forecasts(series, folds=4, h=3, least=24).collect()
    return {(r["repo"], r["model"], r["origin"], r["step"]): r for r in rows}


def origins(repo):
    n = len(Y[repo])
    return [o for o in (n - 3 * (4 - j) for j in range(4)) if o >= 24]


def test_which_forecasts(found):
    assert {(r, o) for r, _, o, _ in found} == {(r, o) for r in Y for o in origins(r)}
    assert ("a/just", "ses", 24, 3) in found and not any(r == "a/short" for r, *_ in found)
    for repo in ("a/season", "a/walk"):
        for o in origins(repo):
            assert {m for r, m, p, _ in found if (r, p) == (repo, o)} == set(BT.MODELS)
            assert [found[repo, "ses", o, k]["y"] for k in (1, 2, 3)] == Y[repo][o:o + 3]


@pytest.mark.parametrize("model", ["ses", "holt_winters", "ar5", "index_trend"])
def test_same_as_the_library_refitted(spark, series, found, model):
    for repo in ("a/season", "a/walk"):
        for o in origins(repo):
            prefix = monthly_frame(spark, Y[repo][:o], repo=repo)
            if model == "index_trend":
                idx = prefix.withColumn("idx", F.months_between("ds", F.lit("2020-01-01")).cast("long"))
                c = TR.index_trend_coef(idx).first()
                want = [c["intercept"] + c["slope"] * (o + k) for k in range(3)]
            else:
                run = {"ses": SM.ses_forecast, "holt_winters": SM.hw_forecast, "ar5": AR.ar_forecast}[model]
                want = [r["yhat"] for r in run(prefix, h=3).orderBy("step").collect()]
            assert [found[repo, model, o, k]["yhat"] for k in (1, 2, 3)] == pytest.approx(want, rel=1e-7)


def calendar(ds, first):
    t = (ds - first).days / 365.25
    d = (ds - np.datetime64("1970-01-01").astype(object)).days * 2 * math.pi / 365.25
    return [1, t] + [max(t - k, 0) for k in range(1, 13)] + [f(k * d) for k in range(1, 5) for f in (math.sin, math.cos)]


def test_same_as_numpy_refitted(series, found):
    dates = {(r["repo"], r["ds"]): r["y"] for r in series.collect()}
    for repo in ("a/season", "a/walk"):
        y = np.array(Y[repo])
        dss = sorted(d for r, d in dates if r == repo)
        for o in origins(repo):
            x = np.column_stack([np.ones(o - 6)] + [y[6 - i:o - i] for i in range(1, 7)])
            b = np.linalg.solve(x.T @ x + 1e-6 * np.eye(7), x.T @ y[6:o])
            hist = y[:o].tolist()
            for _ in range(3):
                hist.append(b[0] + sum(b[i] * hist[-i] for i in range(1, 7)))
            assert [found[repo, "lookback", o, k]["yhat"] for k in (1, 2, 3)] == pytest.approx(hist[o:], rel=1e-6)
            x = np.array([calendar(d, dss[0]) for d in dss])
            w = np.diag([1e-6, 1e-6] + [1.0] * 12 + [1e-2] * 8)
            b = np.linalg.solve(x[:o].T @ x[:o] + w, x[:o].T @ y[:o])
            assert [found[repo, "additive", o, k]["yhat"] for k in (1, 2, 3)] == pytest.approx((x[o:o + 3] @ b).tolist(), rel=1e-5)


def test_comparison(series):
    fc = BT.rolling_forecasts(series, folds=4, h=3).cache()
    rows = BT.rolling_comparison(fc).collect()
    by = {(r["repo"], r["model"]): r for r in rows}
    for repo in ("a/season", "a/walk"):
        mine = sorted((r for r in rows if r["repo"] == repo), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 7)) and [r["mse"] for r in mine] == sorted(r["mse"] for r in mine)
        assert all(r["n"] == 12 for r in mine)
    assert min(by["a/season", "additive"]["mse"], by["a/season", "holt_winters"]["mse"]) < by["a/season", "index_trend"]["mse"]
