"""Decomposable additive model (trend + changepoints + Fourier
seasonality), the re-aimed Prophet slot.

Model (after the published decomposable-model formulation), per series:

    y(t) / s = a + b*t + sum_k d_k * max(t - c_k, 0)
               + sum_{k<=10} yearly Fourier terms + sum_{k<=3} weekly terms

* t is time scaled to [0, 1] over the history; s = max |y| (1 if zero).
* Changepoints c_k: up to 25, at evenly spaced rows (half-even rounding)
  of the first 80 % of the history; fewer when the history is short.
* Yearly terms (period 365.25 days) only when the history spans >= 2
  years; weekly terms (period 7) only for daily series spanning >= 2
  weeks. Absent terms are zero columns, so every series has the same
  53-wide feature array and one Gram aggregate serves all of them.
* Fit: ridge least squares through K1 (closed form, in place of MAP
  sampling) with fixed penalties: 1e-6 on level and slope, 1.0 on
  changepoint deltas (the sparsity prior), 0.01 on seasonal terms.
* ``sparse``: the deltas carry an absolute-value penalty instead of the
  ridge, so that most of them are exactly 0 (coordinate descent on the
  Gram matrix after the other terms are eliminated from it).
* Band (F8): yhat +- z_0.8 * sigma, sigma = residual RMS of the fit.
  ``sparse``: beyond the history the slope may change again, at the
  history's rate (changepoints per unit of t) by Laplace steps of the mean
  size |d|; at distance u that adds rate * 2 |d|^2 * u^3 / 3 to the variance.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import KEYS
from .linalg import SOLUTION, dot_fixed, gram, pieces, solve, unpacked
from .smoothing import Z80

# Fixed values (defaults of the decomposable model the reference calls).
N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
YEARLY_ORDER = 10
WEEKLY_ORDER = 3
YEAR_DAYS = 365.25
P = 2 + N_CHANGEPOINTS + 2 * YEARLY_ORDER + 2 * WEEKLY_ORDER
#: Absolute-value penalty of a delta: noise variance 0.05^2 over prior scale 0.05.
SPARSE = 0.05
SWEEPS, TOLERANCE = 20_000, 1e-10
RIDGE = [1e-6, 1e-6] + [1.0] * N_CHANGEPOINTS + [1e-2] * (2 * (YEARLY_ORDER + WEEKLY_ORDER))


def _stats(series: DataFrame, grain: str, keys) -> DataFrame:
    g = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"),
        F.max(F.abs("y")).alias("_ymax"), F.array_sort(F.collect_list("ds")).alias("_dss"))
    g = g.withColumn("span", F.datediff("last_ds", "first_ds")) \
         .withColumn("scale", F.when(F.col("_ymax") > 0, F.col("_ymax")).otherwise(F.lit(1.0))) \
         .withColumn("hist_size", F.floor(F.col("n") * F.lit(CHANGEPOINT_RANGE)).cast("int")) \
         .withColumn("ncp", F.least(F.lit(N_CHANGEPOINTS), F.greatest(F.col("hist_size") - 1, F.lit(0))))
    cps = F.expr(f"""transform(sequence(1, {N_CHANGEPOINTS}), k -> IF(k <= ncp AND span > 0,
        datediff(_dss[CAST(bround(k * (hist_size - 1) / CAST(ncp AS DOUBLE), 0) AS INT)], first_ds) / CAST(span AS DOUBLE),
        CAST(NULL AS DOUBLE)))""")
    weekly = (F.lit(grain == "day") & (F.col("span") >= 14))
    return g.withColumn("cps", cps).withColumn("yearly_on", F.col("span") >= 730) \
            .withColumn("weekly_on", weekly).drop("_ymax", "_dss")


def _features_sql(ds: str = "ds") -> str:
    """SQL for the ARRAY<DOUBLE> of length P of the row's date, given the
    stats columns: P explicit element expressions (no lambdas, so the array
    is produced inside whole-stage codegen), sent to Spark as one string."""
    t = f"(CASE WHEN span > 0 THEN datediff(`{ds}`, first_ds) / CAST(span AS DOUBLE) ELSE 0D END)"
    days = f"CAST(datediff(`{ds}`, DATE'1970-01-01') AS DOUBLE)"
    cols = ["1D", t]
    cols += [f"coalesce(greatest({t} - cps[{k}], 0D), 0D)" for k in range(N_CHANGEPOINTS)]
    for on, order, period in (("yearly_on", YEARLY_ORDER, YEAR_DAYS), ("weekly_on", WEEKLY_ORDER, 7.0)):
        for k in range(1, order + 1):
            w = repr(2.0 * math.pi * k / period)
            cols += [f"IF({on}, sin({days} * {w}), 0D)", f"IF({on}, cos({days} * {w}), 0D)"]
    return "array(" + ", ".join(cols) + ")"


def _features(ds: str = "ds"):
    return F.expr(_features_sql(ds))


def sparse_coefficients(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and squared error of stacked Z'Z = [X | y]'[X | y]:
    least |y - X b|^2 / 2 + ridge b^2 / 2 for all but the deltas + SPARSE |deltas|."""
    p = z.shape[1] - 1
    d = np.arange(2, 2 + N_CHANGEPOINTS)
    rest = np.setdiff1d(np.arange(p), d)
    a, b = z[:, :p, :p], z[:, :p, p]
    # the other terms follow from the deltas; what is left is a small problem in the deltas alone
    inverse = np.linalg.inv(a[:, rest[:, None], rest] + np.diag(np.asarray(RIDGE)[rest]))
    cross = a[:, d[:, None], rest] @ inverse
    g = a[:, d[:, None], d] - cross @ a[:, rest[:, None], d]
    c = b[:, d] - np.einsum("sij,sj->si", cross, b[:, rest])
    x = np.zeros_like(c)
    gx = np.zeros_like(c)
    for _ in range(SWEEPS):
        moved = np.zeros(len(x))
        for j in range(N_CHANGEPOINTS):
            own = g[:, j, j]
            pull = c[:, j] - gx[:, j] + own * x[:, j]
            new = np.where(own > 1e-12, np.sign(pull) * np.maximum(np.abs(pull) - SPARSE, 0) / np.where(own > 1e-12, own, 1), 0.0)
            step = new - x[:, j]
            gx += step[:, None] * g[:, :, j]
            x[:, j] = new
            moved = np.maximum(moved, np.abs(step))
        if not (moved > TOLERANCE).any():
            break
    beta = np.zeros((len(z), p))
    beta[:, d] = x
    beta[:, rest] = np.einsum("sij,sj->si", inverse, b[:, rest] - np.einsum("sij,sj->si", a[:, rest[:, None], d], x))
    sse = z[:, p, p] - 2 * np.einsum("si,si->s", beta, b) + np.einsum("si,sij,sj->s", beta, a, beta)
    return beta, np.maximum(sse, 0.0)


def solve_sparse(g: DataFrame) -> DataFrame:
    """``linalg.solve`` with the sparse penalty; a series with sums that are not finite gets nulls and an ``error``."""
    q = P + 1

    @F.pandas_udf(SOLUTION)
    def fit(tri: pd.Series) -> pd.DataFrame:
        beta, sse, finite = np.full((len(tri), P), np.nan), np.full(len(tri), np.nan), np.zeros(len(tri), bool)
        for s in pieces(len(tri), q):
            z = unpacked(tri.iloc[s], q)
            ok = np.isfinite(z).all(axis=(1, 2))
            finite[s] = ok
            if ok.any():
                at = np.arange(s.start, s.stop)[ok]
                beta[at], sse[at] = sparse_coefficients(z[ok])
        return pd.DataFrame({"beta": list(beta), "sse": sse, "rank": P,
                             "error": [None if ok else "sums are not finite" for ok in finite]})

    return g.withColumn("fit", fit("tri"))


def additive_fit(series: DataFrame, grain: str = "month", keys=KEYS, stats: DataFrame | None = None,
                 sparse: bool = False) -> DataFrame:
    """(keys, stats..., beta, sigma, step) per series; ``step`` is the mean size of a delta."""
    st = stats if stats is not None else _stats(series, grain, keys)
    # cluster each series' (narrow) rows by key before the 53-wide features
    # exist and put them one after the other (a broadcast join would leave
    # them mixed), so the per-batch partial Gram is one matrix per series
    # (series length is bounded by the calendar, so no key is unbounded)
    rows = series.repartition(*keys).join(st, keys).sortWithinPartitions(*keys).select(
        *keys, (F.col("y") / F.col("scale")).alias("ys"), _features().alias("x"))
    g = gram(rows, keys, "x", "ys", P)
    sol = solve_sparse(g) if sparse else solve(g, P, ridge=RIDGE)
    size = f"aggregate(slice(fit.beta, 3, {N_CHANGEPOINTS}), 0D, (a, v) -> a + abs(v))"
    sol = sol.select(*keys, F.col("fit.beta").alias("beta"), F.expr(size).alias("_sum"),
                     F.sqrt(F.col("fit.sse") / F.col("n")).alias("_sig"))
    return st.join(sol, keys).withColumn("step", F.col("_sum") / F.greatest(F.col("ncp"), F.lit(1))).drop("_sum").withColumn("sigma", F.col("_sig") * F.col("scale")).drop("_sig")


def _future(fit: DataFrame, grain: str, h: int, month_end: bool, keys) -> DataFrame:
    k = F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step")
    f = fit.select(*keys, "last_ds", k)
    if grain == "day":
        ds = F.date_add("last_ds", F.col("step"))
    elif month_end:
        ds = F.last_day(F.add_months("last_ds", F.col("step") - 1))
    else:
        ds = F.add_months(F.trunc("last_ds", "MM"), F.col("step"))
    return f.select(*keys, ds.alias("ds"))


def future_variance_sql() -> str:
    """Variance of the trend beyond the history from slope changes to come."""
    u = "(CASE WHEN span > 0 THEN greatest(datediff(ds, last_ds), 0) / CAST(span AS DOUBLE) ELSE 0D END)"
    return f"scale * scale * ncp * 2D * step * step * {u} * {u} * {u} / 3D"


def additive_forecast(series: DataFrame, grain: str = "month", h: int | None = None,
                      month_end: bool = False, keys=KEYS, sparse: bool = False) -> DataFrame:
    """F7 + F8: history (segment 'train', in-sample) plus ``h`` future
    points (segment 'forecast'): 30 days for daily series, 12 months for
    monthly ones (month-starts; ``month_end=True`` for the month-end grid)."""
    h = h if h is not None else (30 if grain == "day" else 12)
    st = _stats(series, grain, keys)
    fit = additive_fit(series, grain, keys, stats=st, sparse=sparse).select(*keys, "beta", "sigma", "step")
    hist = series.select(*keys, "ds", "y", F.lit("train").alias("segment"))
    fut = _future(st, grain, h, month_end, keys).select(
        *keys, "ds", F.lit(None).cast("double").alias("y"), F.lit("forecast").alias("segment"))
    grid = hist.unionByName(fut).join(st, keys).join(fit, keys)
    out = grid.withColumn("_x", _features())
    out = out.withColumn("yhat", dot_fixed("_x", "beta", P) * F.col("scale"))
    sd = F.col("sigma")
    if sparse:
        sd = F.sqrt(sd * sd + F.expr(future_variance_sql()))
    band = F.lit(Z80) * sd
    return out.select(*keys, F.lit("additive").alias("model"), "segment", "ds", "y", "yhat",
                      (F.col("yhat") - band).alias("yhat_lower"), (F.col("yhat") + band).alias("yhat_upper"))

