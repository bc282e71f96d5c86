"""F7 with sparse changepoints and F8's widening band; T8 beyond the calendar."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import additive as AD
from tidecast.operators import linalg as LA
from tidecast.operators import timeline as TL

from .helpers import monthly_frame

RNG = np.random.default_rng(6)
BENT = [10 + 0.5 * i + (2.0 * (i - 40) if i > 40 else 0) + RNG.normal() * 0.5 for i in range(80)]


def features(spark, series):
    st = AD._stats(series, "month", ["repo", "metric"])
    rows = series.join(st, ["repo", "metric"]).select("ds", (F.col("y") / F.col("scale")).alias("ys"), AD._features().alias("x"))
    pdf = rows.orderBy("ds").toPandas()
    return np.stack(pdf["x"].to_numpy()), pdf["ys"].to_numpy()


def test_sparse_fit_is_the_optimum(spark):
    """The subgradient conditions of the penalised problem, checked on the rows themselves."""
    s = monthly_frame(spark, BENT)
    x, y = features(spark, s)
    beta = np.array(AD.additive_fit(s, sparse=True).first()["beta"])
    d = slice(2, 2 + AD.N_CHANGEPOINTS)
    slope = x.T @ (x @ beta - y)
    ridge = np.asarray(AD.RIDGE) * beta
    others = np.r_[0:2, 2 + AD.N_CHANGEPOINTS:AD.P]
    assert np.abs((slope + ridge)[others]).max() < 1e-5
    at, g = beta[d], slope[d]
    assert np.abs(g[at != 0] + AD.SPARSE * np.sign(at[at != 0])).max() < 1e-5
    assert np.abs(g[at == 0]).max() <= AD.SPARSE + 1e-5


def test_sparse_fit_bends_where_the_series_does(spark):
    s = monthly_frame(spark, BENT)
    row = AD.additive_fit(s, sparse=True).first()
    deltas = np.array(row["beta"][2:2 + AD.N_CHANGEPOINTS])
    assert (deltas == 0).sum() >= 15                      # most changepoints are off
    cps = np.array(row["cps"], float)
    on = np.abs(deltas) > 0.1
    assert on.any() and np.abs(cps[on] - 40 / 79).max() < 0.15
    dense = np.array(AD.additive_fit(s).first()["beta"][2:2 + AD.N_CHANGEPOINTS])
    assert (dense == 0).sum() < 5


def test_band_from_a_staged_fit_in_sql(spark):
    """F8 by SQL over the rows of F7: residual variance plus the variance of slopes to come."""
    s = monthly_frame(spark, BENT, repo="a/bent").unionByName(monthly_frame(spark, BENT[:30], repo="a/line"))
    fit = AD.additive_fit(s, sparse=True).select("repo", "sigma", "step", "scale", "ncp", "span", "last_ds").toPandas()
    fc = AD.additive_forecast(s, sparse=True).toPandas()
    con = duckdb.connect()
    con.register("fit", fit)
    con.register("fc", fc)
    worst, rows = con.execute("""
        SELECT max(abs(yhat_upper - yhat - w)), count(*) FROM (
          SELECT fc.*, 1.2815515655446004 * sqrt(sigma * sigma + scale * scale * ncp * 2 * step * step * pow(u, 3) / 3) AS w
          FROM (SELECT fc.*, fit.* EXCLUDE (repo), greatest(datediff('day', CAST(last_ds AS DATE), CAST(ds AS DATE)), 0)
                       / CAST(span AS DOUBLE) AS u FROM fc JOIN fit USING (repo)) fc)""").fetchone()
    assert rows == 110 + 24 and worst < 1e-9
    ahead = fc[(fc.repo == "a/bent") & (fc.segment == "forecast")].sort_values("ds")
    width = (ahead.yhat_upper - ahead.yhat_lower).to_numpy()
    assert (np.diff(width) > 0).all()
    # residual spread is what the rows say
    h = fc[(fc.repo == "a/bent") & (fc.segment == "train")]
    assert fit[fit.repo == "a/bent"].sigma.iloc[0] == pytest.approx(np.sqrt(((h.y - h.yhat) ** 2).mean()), rel=1e-6)


def test_sparse_short_constant_and_not_finite_series(spark):
    df = monthly_frame(spark, BENT, repo="a/bent")
    for n in (1, 2, 3, 8):
        df = df.unionByName(monthly_frame(spark, [3.0] * n, repo=f"a/c{n}"))
    df = df.unionByName(monthly_frame(spark, [1.0, float("inf"), 2.0], repo="a/inf"))
    rows = AD.additive_forecast(df, sparse=True).where("segment = 'forecast'").collect()
    flat = [r["yhat"] for r in rows if r["repo"].startswith("a/c")]
    assert len(flat) == 48 and flat == pytest.approx([3.0] * 48, abs=1e-3)
    assert all(r["yhat"] is None for r in rows if r["repo"] == "a/inf")
    assert all(r["yhat"] is not None and np.isfinite(r["yhat"]) for r in rows if r["repo"] == "a/bent")


def test_one_bad_series_leaves_its_batch_alone(spark):
    rng = np.random.default_rng(1)
    rows = [(f"o/{k}", [float(v) for v in rng.normal(size=2)], float("nan") if k == 3 and i == 5 else float(i))
            for k in range(6) for i in range(20)]
    df = spark.createDataFrame(rows, "repo STRING, x ARRAY<DOUBLE>, y DOUBLE").coalesce(1)
    got = {r["repo"]: r["fit"] for r in LA.solve(LA.gram(df, ["repo"], "x", "y", 2), 2).collect()}
    assert got["o/3"]["error"] == "sums are not finite" and got["o/3"]["beta"] == [None, None]
    for k in (0, 1, 2, 4, 5):
        x = np.array([r[1] for r in rows if r[0] == f"o/{k}"])
        want = np.linalg.lstsq(x, np.arange(20.0), rcond=None)[0]
        assert got[f"o/{k}"]["error"] is None and got[f"o/{k}"]["beta"] == pytest.approx(want.tolist())
    spread = LA.gram(df.repartition(7), ["repo"], "x", "y", 2, clustered=False)
    again = {r["repo"]: r["fit"]["beta"] for r in LA.solve(spread, 2).collect()}
    assert again["o/1"] == pytest.approx(got["o/1"]["beta"])


AS_OF = dt.date(2001, 9, 1)


def test_ten_million_branches(spark):
    df = spark.range(10_000_000).select(F.when(F.col("id") % 100 == 0, "a/small").otherwise("a/large").alias("repo"))
    rows = TL.synthetic_months(df, AS_OF, "branches").collect()
    large = [r for r in rows if r["repo"] == "a/large"]
    early = [r for r in large if r["status"] == TL.BEFORE]
    days = (AS_OF - dt.date(1, 1, 1)).days
    assert len(early) == 1 and early[0]["ds"] is None and early[0]["n"] == 9_900_000 - days
    assert sum(r["n"] for r in large) == 9_900_000
    months = sorted(r["ds"] for r in large if r["status"] == "ok")
    assert months[0] == dt.date(1, 1, 1) and months[-1] == dt.date(2001, 8, 1) and len(months) == 2000 * 12 + 8
    assert {r["status"] for r in rows if r["repo"] == "a/small"} == {"ok"}
    assert TL.synthetic_monthly(df, AS_OF, "branches").where("ds IS NULL OR year(ds) < 1").count() == 0


def test_long_list_of_values_and_positions(spark):
    """Contributions in order: the largest lie before the calendar, and their sum is told."""
    df = spark.range(800_000).select(F.lit("a/x").alias("repo"), (F.col("id") % 4 + 1).alias("contributions"), "id")
    rows = TL.synthetic_months(df, AS_OF, "contributors", "contributions").collect()
    days = (AS_OF - dt.date(1, 1, 1)).days
    early = [r for r in rows if r["status"] == TL.BEFORE]
    assert early[0]["n"] == 800_000 - days and early[0]["y"] == 4.0 * (800_000 - days)
    assert sum(r["y"] for r in rows) == 2_000_000 and sum(r["n"] for r in rows) == 800_000
    line = TL.rank_spaced_timeline(df, AS_OF, [("id", False)])
    got = line.agg(F.sum(F.col("synthetic_day").isNull().cast("int")), F.min("synthetic_day").cast("string"),
                   F.max("synthetic_day").cast("string")).first()
    assert tuple(got) == (800_000 - days, "0001-01-01", "2001-08-31")
