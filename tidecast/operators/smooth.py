"""F10 as a smooth function of the index: a piecewise polynomial per series.

Basis over t in [0, 1] (index scaled by the last one): 1, t .. t^degree and
(t - c)^degree above each of ``knots`` evenly spaced points c. The knot terms
carry a penalty; of a fixed grid the one with the least leave-one-out error
is taken per series. Leaving a point out needs no refit: its error is
e_i / (1 - h_i) with the leverage h_i = x_i' A^-1 x_i of the full fit, so all
penalties come from one Gram matrix (K1) and one inverse each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import KEYS
from .linalg import gram
from .series import sorted_points

# Default basis and penalties (per point of the series).
KNOTS = 8
DEGREE = 2
PENALTIES = [10.0 ** e for e in range(-6, 2)]
#: Penalty on all other terms, so that short series stay solvable.
LEAST = 1e-9


def basis_sql(t: str, knots: int, degree: int) -> str:
    """SQL of the basis at ``t``: ``degree`` + ``knots`` + 1 numbers."""
    power = lambda v: " * ".join([v] * degree)
    terms = ["1D"] + [" * ".join([t] * d) for d in range(1, degree + 1)]
    terms += [power(f"greatest({t} - {k / (knots + 1)!r}D, 0D)") for k in range(1, knots + 1)]
    return "array(" + ", ".join(terms) + ")"


def _fits(g: DataFrame, p: int, free: int, penalties: list[float]) -> DataFrame:
    """Adds ``fits``: (penalty, beta, inverse row by row) for each penalty."""
    q, iu = p + 1, np.triu_indices(p + 1)

    @F.pandas_udf("array<struct<penalty: double, beta: array<double>, inverse: array<double>>>")
    def fit(tri: pd.Series, n: pd.Series) -> pd.Series:
        z = np.zeros((len(tri), q, q))
        if len(tri):
            z[:, iu[0], iu[1]] = np.stack(tri.to_numpy())
            z[:, iu[1], iu[0]] = z[:, iu[0], iu[1]]
        out = [[] for _ in range(len(tri))]
        for c in penalties:
            weight = np.full(p, LEAST)
            weight[free:] += c
            inverse = np.linalg.inv(z[:, :p, :p] + n.to_numpy(float)[:, None, None] * np.diag(weight))
            beta = np.einsum("sij,sj->si", inverse, z[:, :p, p])
            for o, b, v in zip(out, beta, inverse, strict=True):
                o.append({"penalty": c, "beta": b.tolist(), "inverse": v.ravel().tolist()})
        return pd.Series(out, dtype=object)

    return g.withColumn("fits", fit("tri", "n"))


def smooth_trend(series: DataFrame, keys=KEYS, knots: int = KNOTS, degree: int = DEGREE,
                 penalties: list[float] | None = None) -> DataFrame:
    """(keys, ds, idx, y, yhat, penalty, loo): the fitted curve at every point,
    the chosen penalty of the series and its mean squared leave-one-out
    error. Ties go to the larger penalty. A series of one point is its value."""
    penalties = sorted(PENALTIES if penalties is None else penalties)
    p = 1 + degree + knots
    rows = sorted_points(series, keys).withColumn("x", F.expr(f"""transform(sequence(0, size(pts) - 1),
        i -> transform(array(i / greatest(size(pts) - 1, 1)), t -> {basis_sql('t', knots, degree)})[0])"""))
    long = rows.select(*keys, F.explode(F.arrays_zip("pts", "x")).alias("r")).select(
        *keys, F.col("r.x").alias("x"), F.col("r.pts.y").alias("y"))
    fits = _fits(gram(long, keys, "x", "y", p), p, degree + 1, penalties).select(*keys, "fits")
    dot = lambda a, b, off="": " + ".join(f"{a}[{i}] * {b}[{off}{i}]" for i in range(p))
    leverage = " + ".join(f"x[k][{i}] * ({dot('x[k]', 'f.inverse', f'{i * p} + ')})" for i in range(p))
    loo = f"""aggregate(sequence(0, size(pts) - 1), 0D, (s, k) -> s + transform(array(
        (pts[k].y - ({dot('x[k]', 'f.beta')})) / greatest(1D - ({leverage}), 1E-9)), v -> v * v)[0]) / size(pts)"""
    # least error first; of equal ones the larger penalty
    best = f"""array_min(transform(fits, f -> named_struct('loo', {loo}, 'less', -f.penalty, 'beta', f.beta)))"""
    out = rows.join(fits, list(keys)).withColumn("b", F.expr(best))
    yhat = f"transform(x, v -> {dot('v', 'b.beta')})"
    out = out.select(*keys, F.col("b.loo").alias("loo"), (-F.col("b.less")).alias("penalty"),
                     F.posexplode(F.arrays_zip(F.col("pts"), F.expr(yhat).alias("f"))).alias("idx", "r"))
    return out.select(*keys, F.col("r.pts.ds").alias("ds"), F.col("idx").cast("long").alias("idx"),
                      F.col("r.pts.y").alias("y"), F.col("r.f").alias("yhat"), "penalty", "loo")
