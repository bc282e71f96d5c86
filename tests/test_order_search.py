"""F6 against an independent numpy version, and on simulated processes."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import order_search as OS

from .helpers import daily_frame

R = 5


def simulate(n, phi, theta, d, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + 200) * scale
    z = np.zeros(n + 200)
    for t in range(n + 200):
        z[t] = e[t] + sum(a * z[t - i - 1] for i, a in enumerate(phi) if t > i) \
            + sum(b * e[t - j - 1] for j, b in enumerate(theta) if t > j)
    z = z[200:]
    for _ in range(d):
        z = np.cumsum(z)
    return z


def kpss(x):
    e = x - x.mean()
    n = len(e)
    lags = int(4 * (n / 100) ** 0.25)
    lrv = (e @ e + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, min(lags, n - 1) + 1))) / n
    return (np.cumsum(e) ** 2).sum() / (n * n * lrv) if lrv > 1e-18 else 0.0


def inside(coef):
    """Roots of 1 - a1 B - ... outside the unit circle."""
    poly = np.concatenate([[1.0], -np.asarray(coef)])
    roots = np.roots(poly)  # of the reversed polynomial: inverse roots
    return bool((np.abs(roots) < 1).all())


def innovations(z, phi, theta):
    e = np.zeros(len(z))
    for t in range(R, len(z)):
        e[t] = z[t] - sum(a * z[t - i - 1] for i, a in enumerate(phi)) - sum(b * e[t - j - 1] for j, b in enumerate(theta))
    e[:R] = 0
    return e


def regress(y, cols):
    return np.linalg.lstsq(np.column_stack(cols), y, rcond=None)[0] if cols else np.zeros(0)


def search(y, refine=2):
    """(d, p, q, phi, theta, sse, aic) by plain loops."""
    d = 0
    z = np.asarray(y, float)
    while d < 2 and kpss(z) > 0.463:
        z, d = np.diff(z), d + 1
    z = z - z.mean() if d == 0 else z
    lag = lambda x, t0, i: x[t0 - i:len(x) - i]
    a = regress(z[10:], [lag(z, 10, i) for i in range(1, 11)])
    e = np.zeros(len(z))
    e[10:] = z[10:] - np.column_stack([lag(z, 10, i) for i in range(1, 11)]) @ a
    n = len(z) - R
    best = None
    for p in range(6):
        for q in range(6):
            t0 = 5 if q == 0 else 15
            b = regress(z[t0:], [lag(z, t0, i) for i in range(1, p + 1)] + [lag(e, t0, j) for j in range(1, q + 1)])
            phi, theta = b[:p], b[p:]
            if not inside(phi) or not inside(-theta):
                continue
            sse = (innovations(z, phi, theta) ** 2).sum()
            k = p + q + 1 + (d == 0)
            aic = n * np.log(sse / n) + 2 * k
            if best is None or aic < best[0]:
                best = (aic, p, q, phi, theta, sse)
    _, p, q, phi, theta, sse = best
    for _ in range(refine if p + q else 0):
        e = innovations(z, phi, theta)
        u, v = np.zeros(len(z)), np.zeros(len(z))
        for t in range(R, len(z)):
            u[t] = z[t] - sum(b * u[t - j - 1] for j, b in enumerate(theta) if t - j - 1 >= R)
            v[t] = e[t] - sum(b * v[t - j - 1] for j, b in enumerate(theta) if t - j - 1 >= R)
        step = regress(e[10:], [lag(u, 10, i) for i in range(1, p + 1)] + [lag(v, 10, j) for j in range(1, q + 1)])
        tried = []
        for s in (1, 0.5, 0.25):
            f, g = phi + s * step[:p], theta + s * step[p:]
            new = (innovations(z, f, g) ** 2).sum()
            if new < sse and inside(f) and inside(-g):
                tried.append((new, f, g))
        if tried:
            sse, phi, theta = min(tried, key=lambda c: c[0])
    return d, p, q, phi, theta, sse, n * np.log(sse / n) + 2 * (p + q + 1 + (d == 0))


SERIES = {
    "a/arma211": simulate(700, [0.5, 0.25], [0.6], 1, 1),
    "a/ma2": simulate(500, [], [0.7, 0.4], 0, 2) + 20,
    "a/ar3": simulate(400, [0.4, -0.3, 0.3], [], 0, 3),
    "a/i2": simulate(300, [0.3], [], 2, 4),
    "a/noise": simulate(200, [], [], 0, 5) + 3,
    "a/walk": simulate(250, [], [], 1, 6),
}


@pytest.fixture(scope="module")
def fits(spark):
    df = None
    for repo, y in SERIES.items():
        s = daily_frame(spark, y.tolist(), repo=repo)
        df = s if df is None else df.unionByName(s)
    return {r["repo"]: r for r in OS.order_search(df).collect()}


@pytest.mark.parametrize("repo", sorted(SERIES))
def test_same_as_plain_loops(fits, repo):
    d, p, q, phi, theta, sse, aic = search(SERIES[repo])
    r = fits[repo]
    assert (r["d"], r["p"], r["q"]) == (d, p, q)
    assert r["phi"][:p] == pytest.approx(phi.tolist(), abs=1e-5) and r["phi"][p:] == [0.0] * (5 - p)
    assert r["theta"][:q] == pytest.approx(theta.tolist(), abs=1e-5) and r["theta"][q:] == [0.0] * (5 - q)
    assert r["sse"] == pytest.approx(sse, rel=1e-7) and r["aic"] == pytest.approx(aic, rel=1e-7)


def test_differences(fits):
    assert {repo: r["d"] for repo, r in fits.items()} == {
        "a/arma211": 1, "a/ma2": 0, "a/ar3": 0, "a/i2": 2, "a/noise": 0, "a/walk": 1}


def test_recovers_the_process(fits):
    """The impulse responses, which any order that fits must share, are those of the simulated ARMA(2,1,1)."""
    def responses(phi, theta, n=8):
        out = []
        for k in range(n):
            v = 1.0 if k == 0 else (theta[k - 1] if k <= len(theta) else 0.0)
            out.append(v + sum(a * out[k - i - 1] for i, a in enumerate(phi) if k > i))
        return out
    r = fits["a/arma211"]
    assert r["q"] > 0
    assert responses(r["phi"], r["theta"]) == pytest.approx(responses([0.5, 0.25], [0.6]), abs=0.2)
    assert r["sse"] / r["n"] == pytest.approx(1.0, abs=0.15)
    assert responses(fits["a/ma2"]["phi"], fits["a/ma2"]["theta"], 4) == pytest.approx([1, 0.7, 0.4, 0], abs=0.2)


def test_refining_never_raises_the_sse(spark):
    s = daily_frame(spark, SERIES["a/arma211"].tolist())
    plain, refined = (OS.order_search(s, refine=k).first() for k in (0, 2))
    assert (plain["p"], plain["q"]) == (refined["p"], refined["q"]) and refined["sse"] < plain["sse"]


def forecast(y, h):
    d, p, q, phi, theta, sse, _ = search(y)
    z = np.diff(y, d) if d else y - y.mean()
    e = innovations(z, phi, theta)
    zs, es, psi = list(z), list(e), []
    for k in range(h):
        zs.append(sum(a * zs[-i - 1] for i, a in enumerate(phi)) + sum(b * es[-j - 1] for j, b in enumerate(theta)))
        es.append(0.0)
        psi.append((1.0 if k == 0 else theta[k - 1] if k <= q else 0.0)
                   + sum(a * psi[k - i - 1] for i, a in enumerate(phi) if k > i))
    path = np.array(zs[len(z):])
    if d == 0:
        path = path + y.mean()
    if d == 1:
        path, psi = y[-1] + np.cumsum(path), np.cumsum(psi)
    if d == 2:
        path = y[-1] + np.cumsum(y[-1] - y[-2] + np.cumsum(path))
        psi = np.cumsum(np.cumsum(psi))
    sigma = np.sqrt(sse / max(len(z) - R - p - q, 1))
    return path, 1.2815515655446004 * sigma * np.sqrt(np.cumsum(np.square(psi)))


@pytest.mark.parametrize("repo", ["a/arma211", "a/ma2", "a/i2"])
def test_forecast_and_band(spark, repo):
    s = daily_frame(spark, SERIES[repo].tolist(), repo=repo)
    h = s.select("repo", "metric").distinct().withColumn("h", F.lit(15))
    rows = OS.order_search_forecast(s, h).orderBy("step").collect()
    path, band = forecast(SERIES[repo], 15)
    assert [r["yhat"] for r in rows] == pytest.approx(path.tolist(), rel=1e-4, abs=1e-3)
    assert [r["yhat_upper"] - r["yhat"] for r in rows] == pytest.approx(band.tolist(), rel=1e-3)
    assert rows[0]["ds"] == dt.date(2020, 1, 1) + dt.timedelta(days=len(SERIES[repo]))


def test_short_and_constant_series(spark):
    df = daily_frame(spark, SERIES["a/noise"].tolist(), repo="o/normal")
    for n in (1, 2, 3, 4, 5, 6, 8, 11, 12, 13, 16, 20, 24):
        df = df.unionByName(daily_frame(spark, [1.0 + (i * 5) % 3 for i in range(n)], repo=f"o/r{n}")) \
            .unionByName(daily_frame(spark, [7.0] * n, repo=f"o/c{n}"))
    h = df.select("repo", "metric").distinct().withColumn("h", F.lit(3))
    rows = OS.order_search_forecast(df, h).collect()
    assert len(rows) == 3 * 27 and all(r["yhat"] is not None and np.isfinite(r["yhat"]) for r in rows)
    assert all(r["yhat"] == 7.0 and r["yhat_lower"] == 7.0 for r in rows if r["repo"].startswith("o/c"))
    nothing = df.select("repo", "metric").distinct().withColumn("h", F.lit(0))
    assert OS.order_search_forecast(df.where("repo = 'o/r24'"), nothing).collect() == []
