"""Continuous smoothing parameters (F1, F2) and the smooth index curve (F10) against numpy."""

import math

import numpy as np
import pytest

from tidecast.operators import smooth as SMO
from tidecast.operators import smoothing as SM

from .helpers import monthly_frame

RNG = np.random.default_rng(4)
SEASONAL = [50 + 0.3 * i + 12 * math.sin(i * math.pi / 6) + RNG.normal() * 4 for i in range(72)]
LEVELS = np.cumsum(RNG.normal(size=60)).tolist()
NOISE = (10 + RNG.normal(size=40)).tolist()


def ses(y, a):
    level, sse = y[0], 0.0
    for v in y[1:]:
        sse += (v - level) ** 2
        level = a * v + (1 - a) * level
    return sse, level


def holt_winters(y, a, g, m=12):
    level = sum(y[:m]) / m
    season, sse = [v - level for v in y[:m]], 0.0
    for t, v in enumerate(y):
        s = season[t % m]
        sse += (v - level - s) ** 2
        season[t % m] = g * (v - level) + (1 - g) * s
        level = a * (v - s) + (1 - a) * level
    return sse, level


def test_ses_is_the_minimum(spark):
    df = monthly_frame(spark, LEVELS, repo="a/walk").unionByName(monthly_frame(spark, NOISE, repo="a/noise"))
    grid = {r["repo"]: r for r in SM.ses_fit(df).collect()}
    fine = {r["repo"]: r for r in SM.ses_fit(df, refine=True).collect()}
    for repo, y in (("a/walk", LEVELS), ("a/noise", NOISE)):
        r = fine[repo]
        sse, level = ses(y, r["alpha"])
        assert r["sse"] == pytest.approx(sse, rel=1e-8) and r["level"] == pytest.approx(level, rel=1e-8)
        assert r["sse"] <= grid[repo]["sse"]
        near = [ses(y, a)[0] for a in np.linspace(max(1e-4, grid[repo]["alpha"] - 0.01), min(1, grid[repo]["alpha"] + 0.01), 4001)]
        assert r["sse"] <= min(near) * (1 + 1e-8)


def test_holt_winters_is_no_worse_and_locally_best(spark):
    df = monthly_frame(spark, SEASONAL)
    grid, fine = SM.hw_fit(df).first(), SM.hw_fit(df, refine=True).first()
    assert fine["sse"] < grid["sse"] and fine["gamma"] <= 1 - fine["alpha"] + 1e-9
    sse, level = holt_winters(SEASONAL, fine["alpha"], fine["gamma"])
    assert fine["sse"] == pytest.approx(sse, rel=1e-8) and fine["level"] == pytest.approx(level, rel=1e-8)
    for da in (-0.01, 0, 0.01):
        for dg in (-0.01, 0, 0.01):
            a, g = fine["alpha"] + da, fine["gamma"] + dg
            if 1e-4 <= a and 1e-4 <= g <= 1 - a:
                assert holt_winters(SEASONAL, a, g)[0] >= fine["sse"] * (1 - 1e-6)


def test_refined_dispatch_and_short_series(spark):
    df = monthly_frame(spark, SEASONAL, repo="a/long").unionByName(monthly_frame(spark, LEVELS[:9], repo="a/mid")) \
        .unionByName(monthly_frame(spark, [5.0] * 8, repo="a/const")).unionByName(monthly_frame(spark, [1.0, 2.0], repo="a/two"))
    rows = SM.smoothing_forecast(df, refine=True).collect()
    assert {(r["repo"], r["model"]) for r in rows} == {("a/long", "holt_winters"), ("a/mid", "ses"), ("a/const", "ses")}
    assert [r["yhat"] for r in rows if r["repo"] == "a/const"] == [5.0] * 12


def design(n, knots, degree):
    t = np.arange(n) / max(n - 1, 1)
    return np.column_stack([t ** d for d in range(degree + 1)]
                           + [np.maximum(t - k / (knots + 1), 0) ** degree for k in range(1, knots + 1)])


def plain_smooth(y, knots, degree, penalties):
    y, x = np.asarray(y, float), design(len(y), knots, degree)
    best = None
    for c in sorted(penalties, reverse=True):
        w = np.diag([1e-9] * (degree + 1) + [1e-9 + c] * knots) * len(y)
        loo = 0.0
        for i in range(len(y)):  # really leaving the point out
            keep = np.arange(len(y)) != i
            b = np.linalg.solve(x[keep].T @ x[keep] + w, x[keep].T @ y[keep])
            loo += (y[i] - x[i] @ b) ** 2
        if best is None or loo / len(y) < best[0]:
            best = (loo / len(y), c, x @ np.linalg.solve(x.T @ x + w, x.T @ y))
    return best


@pytest.mark.parametrize("knots, degree", [(8, 2), (2, 1), (5, 3)])
def test_smooth_by_leaving_points_out(spark, knots, degree):
    y = {"a/wave": [10 * math.sin(i / 8) + RNG.normal() for i in range(60)], "a/line": [3.0 * i + RNG.normal() for i in range(30)]}
    df = monthly_frame(spark, y["a/wave"], repo="a/wave").unionByName(monthly_frame(spark, y["a/line"], repo="a/line"))
    got = SMO.smooth_trend(df, knots=knots, degree=degree, penalties=SMO.PENALTIES[2:]).orderBy("idx").collect()
    for repo, v in y.items():
        loo, c, fitted = plain_smooth(v, knots, degree, SMO.PENALTIES[2:])
        mine = [r for r in got if r["repo"] == repo]
        assert [r["penalty"] for r in mine] == pytest.approx([c] * len(v))
        assert mine[0]["loo"] == pytest.approx(loo, rel=1e-5)
        assert [r["yhat"] for r in mine] == pytest.approx(fitted.tolist(), abs=1e-4)


def test_smooth_follows_a_curve_that_no_line_does(spark):
    y = [20 + 10 * math.cos(i / 9) for i in range(80)]
    rows = SMO.smooth_trend(monthly_frame(spark, y)).collect()
    line = np.polyval(np.polyfit(range(80), y, 1), range(80))
    assert sum((r["y"] - r["yhat"]) ** 2 for r in rows) < 0.02 * ((np.array(y) - line) ** 2).sum()


def test_smooth_short_series(spark):
    df = monthly_frame(spark, [4.0], repo="a/one")
    for n in (2, 3, 5):
        df = df.unionByName(monthly_frame(spark, [4.0] * n, repo=f"a/c{n}"))
    rows = SMO.smooth_trend(df).collect()
    assert len(rows) == 11 and all(r["yhat"] == pytest.approx(4.0, abs=1e-4) for r in rows)
