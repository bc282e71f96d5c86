"""Autoregressive family (F4, F5) and the KPSS statistic, fitted with the K1 kernel.

* AR(p) on first differences (ARIMA(p,1,0)) by conditional least squares
  without a constant (differenced models carry none by default).
* ARMA(1,1) on first differences by the two-stage Hannan-Rissanen
  regression: a long AR(m) gives residual estimates, then dy_t is
  regressed on dy_{t-1} and e_{t-1}.
* Automatic order (F6) is in ``order_search``.

All series-level steps run on series rows (bounded by the calendar per
key); the only aggregate over many rows is the Gram sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import KEYS
from .linalg import dot, gram, solve
from .series import sorted_points
from .smoothing import Z80
from .windows import difference, lag_matrix

# Fixed value: long-AR order of the Hannan-Rissanen first stage.
HR_LONG_ORDER = 4


def _step_date(unit: str, base: str, step: str):
    if unit == "month":
        return F.add_months(F.col(base), F.col(step))
    return F.date_add(F.col(base), F.col(step))


def ar_design(series: DataFrame, p: int, keys=KEYS, col: str = "y") -> DataFrame:
    """Rows (keys, ds, dy, x = [dy_{t-1} .. dy_{t-p}]) with all lags present."""
    d = lag_matrix(difference(series, keys, col), p, "dy", keys)
    lags = [F.col(f"lag{i}") for i in range(1, p + 1)]
    cond = F.col("dy").isNotNull()
    for c in lags:
        cond = cond & c.isNotNull()
    return d.where(cond).select(*keys, "ds", "dy", F.array(*lags).alias("x"))


def _state(series: DataFrame, p: int, keys) -> DataFrame:
    """Per series: last ds, last y, and the last ``p`` differences (oldest first)."""
    pts = sorted_points(series, keys)
    ys = F.transform("pts", lambda q: q["y"])
    return pts.select(*keys, F.element_at("pts", -1)["ds"].alias("last_ds"),
                      F.element_at("pts", -1)["y"].alias("last_y"), F.size("pts").alias("n_points"),
                      ys.alias("ys")) \
        .withColumn("dys", F.expr("IF(size(ys) > 1, transform(sequence(1, size(ys) - 1), i -> ys[i] - ys[i - 1]), "
                              "CAST(array() AS ARRAY<DOUBLE>))")) \
        .withColumn("hist", F.expr(f"slice(dys, greatest(size(dys) - {p} + 1, 1), {p})"))


def _recursion(p: int, h_col: str) -> str:
    """SQL fold producing the level forecasts for steps 1..h from ``hist``
    (oldest first), ``beta`` (lag 1 first), ``c`` and ``last_y``."""
    nxt = (f"(c + aggregate(sequence(1, {p}), 0D, (s, i) -> s + beta[i - 1] * "
           f"coalesce(element_at(acc.hist, size(acc.hist) - i + 1), 0D)))") if p > 0 else "c"
    return f"""aggregate(sequence(1, {h_col}),
      named_struct('hist', hist, 'level', last_y, 'out', CAST(array() AS ARRAY<DOUBLE>)),
      (acc, k) -> named_struct(
          'hist', concat(acc.hist, array({nxt})),
          'level', acc.level + {nxt},
          'out', concat(acc.out, array(acc.level + {nxt})))).out"""


def _design_from_state(st: DataFrame, p: int, keys) -> DataFrame:
    """AR design rows exploded from each series' sorted differences: for
    t >= p, y = dys[t] and x = [dys[t-1] .. dys[t-p]]. Built from the same
    per-series row as the forecast state, so the series is read once."""
    rows = F.expr(f"""IF(size(dys) > {p}, transform(sequence({p}, size(dys) - 1),
        t -> named_struct('dy', dys[t], 'x', transform(sequence(1, {p}), i -> dys[t - i]))), NULL)""")
    return st.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.dy", "r.x")


def ar_fit(series: DataFrame, p: int = 5, keys=KEYS, state: DataFrame | None = None) -> DataFrame:
    """F4 fit: (keys, beta, sse, n_obs, rank) of ARIMA(p,1,0) without constant."""
    st = state if state is not None else _state(series, p, keys)
    g = gram(_design_from_state(st, p, keys), keys, "x", "dy", p)
    f = solve(g, p)
    return f.select(*keys, F.col("fit.beta").alias("beta"), F.col("fit.sse").alias("sse"),
                    F.col("n").alias("n_obs"), F.col("fit.rank").alias("rank"))


def _explode_path(df: DataFrame, keys, model: str, unit: str, sigma, flag=None) -> DataFrame:
    """Forecast rows from the ``path`` array; ``fit_flag`` is 'degenerate'
    when the fit was rank deficient (minimum-norm solution), else null."""
    flag = F.lit(None).cast("string") if flag is None else flag
    out = df.select(*keys, "last_ds", F.posexplode("path").alias("pos", "yhat"), sigma.alias("_sigma"),
                    flag.alias("fit_flag"))
    out = out.withColumn("step", F.col("pos") + 1).withColumn("ds", _step_date(unit, "last_ds", "step"))
    band = F.lit(Z80) * F.col("_sigma") * F.sqrt(F.col("step").cast("double"))
    return out.select(*keys, F.lit(model).alias("model"), "step", "ds", "yhat",
                      (F.col("yhat") - band).alias("yhat_lower"), (F.col("yhat") + band).alias("yhat_upper"),
                      "fit_flag")


def ar_forecast(series: DataFrame, p: int = 5, h: int = 12, keys=KEYS, unit: str = "month") -> DataFrame:
    """ARIMA(p,1,0) fitted by K1, ``h``-step recursion in SQL."""
    st = _state(series, p, keys)
    st = st.join(ar_fit(series, p, keys, state=st), keys)
    st = st.withColumn("c", F.lit(0.0)).withColumn("path", F.expr(_recursion(p, str(h))))
    sigma = F.sqrt(F.col("sse") / F.greatest(F.col("n_obs") - F.lit(p), F.lit(1)))
    flag = F.when(F.col("rank") < p, F.lit("degenerate"))
    return _explode_path(st, keys, f"ar{p}", unit, sigma, flag)


def ar1_forecast(series: DataFrame, h: int = 12, keys=KEYS, unit: str = "month") -> DataFrame:
    """F4 with p = 1 in closed form: phi = sum(dy*dy_1) / sum(dy_1^2)."""
    d = ar_design(series, 1, keys)
    phi = d.groupBy(*keys).agg((F.sum(F.col("dy") * F.col("x")[0]) /
                                F.sum(F.col("x")[0] * F.col("x")[0])).alias("phi"))
    st = _state(series, 1, keys).join(phi, keys)
    path = F.expr(f"""aggregate(sequence(1, {h}),
        named_struct('d', element_at(dys, -1), 'level', last_y, 'out', CAST(array() AS ARRAY<DOUBLE>)),
        (acc, k) -> named_struct('d', phi * acc.d, 'level', acc.level + phi * acc.d,
                                 'out', concat(acc.out, array(acc.level + phi * acc.d)))).out""")
    st = st.withColumn("path", path)
    out = st.select(*keys, "phi", "last_ds", F.posexplode("path").alias("pos", "yhat"))
    out = out.withColumn("step", F.col("pos") + 1)
    return out.select(*keys, "phi", "step", _step_date(unit, "last_ds", "step").alias("ds"), "yhat")


# ------------------------------------------------------------- ARMA(1,1,1)
def arma_fit(series: DataFrame, keys=KEYS, m: int = HR_LONG_ORDER) -> DataFrame:
    """F5 fit by Hannan-Rissanen: (keys, phi, theta, sse, n_obs, degenerate)."""
    design = ar_design(series, m, keys)
    long_ = solve(gram(design, keys, "x", "dy", m), m).select(*keys, F.col("fit.beta").alias("a"))
    res = design.join(long_, keys).withColumn("e", F.col("dy") - dot(F.col("x"), F.col("a")))
    # all differences, with the stage-1 residual where it exists (null before lag m)
    d = difference(series, keys).where(F.col("dy").isNotNull()).select(*keys, "ds", "dy")
    d = d.join(res.select(*keys, "ds", "e"), [*keys, "ds"], "left")
    w = Window.partitionBy(*keys).orderBy("ds")
    d = d.withColumn("dy1", F.lag("dy", 1).over(w)).withColumn("e1", F.lag("e", 1).over(w))
    d2 = d.where(F.col("dy1").isNotNull() & F.col("e1").isNotNull()) \
        .select(*keys, "dy", F.array("dy1", "e1").alias("x"))
    f2 = solve(gram(d2, keys, "x", "dy", 2), 2, ridge=1e-9)
    # stationary and invertible: an MA root inside the circle is replaced by its
    # reciprocal (same autocovariances), else the residual filter diverges
    phi, theta = F.col("fit.beta")[0], F.col("fit.beta")[1]
    theta = F.when(F.abs(theta) > 1, 1 / theta).otherwise(theta)
    inside = lambda c: F.greatest(F.lit(-0.99), F.least(F.lit(0.99), c))
    return f2.select(*keys, inside(phi).alias("phi"), inside(theta).alias("theta"),
                     F.col("fit.sse").alias("sse"), F.col("n").alias("n_obs"),
                     (F.col("fit.rank") < 2).alias("degenerate"))


def arma_forecast(series: DataFrame, h: int = 12, keys=KEYS, unit: str = "month",
                  m: int = HR_LONG_ORDER) -> DataFrame:
    """ARIMA(1,1,1); residuals re-run over the whole series by a fold,
    then dy_{n+1} = phi*dy_n + theta*e_n and dy_{n+k} = phi*dy_{n+k-1}."""
    fit = arma_fit(series, keys, m)
    st = _state(series, 1, keys).join(fit, keys)
    st = st.withColumn("e_last", F.expr("""aggregate(dys, named_struct('e', 0D, 'd', CAST(NULL AS DOUBLE)),
        (acc, v) -> named_struct('e', v - phi * coalesce(acc.d, 0D) - theta * acc.e, 'd', v)).e"""))
    st = st.withColumn("path", F.expr(f"""aggregate(sequence(1, {h}),
        named_struct('d', element_at(dys, -1), 'level', last_y, 'out', CAST(array() AS ARRAY<DOUBLE>)),
        (acc, k) -> named_struct(
            'd', phi * acc.d + IF(k = 1, theta * e_last, 0D),
            'level', acc.level + phi * acc.d + IF(k = 1, theta * e_last, 0D),
            'out', concat(acc.out, array(acc.level + phi * acc.d + IF(k = 1, theta * e_last, 0D))))).out"""))
    sigma = F.sqrt(F.col("sse") / F.greatest(F.col("n_obs") - F.lit(2), F.lit(1)))
    return _explode_path(st, keys, "arma", unit, sigma, F.when(F.col("degenerate"), F.lit("degenerate")))


def kpss_level(series: DataFrame, keys=KEYS) -> DataFrame:
    """KPSS level-stationarity statistic per series: Bartlett long-run
    variance with floor(4 * (n/100)^(1/4)) lags, whatever the length.

    Folds over each series' own sorted values: the cumulative sums, and one
    autocovariance for each lag the formula asks for.
    """
    pts = sorted_points(series, keys)
    g = pts.select(*keys, F.transform("pts", lambda q: q["y"]).alias("ys"))
    g = g.withColumn("mean", F.expr("aggregate(ys, 0D, (s, v) -> s + v, s -> s / size(ys))"))
    g = g.select(*keys, F.size("ys").cast("long").alias("n"), F.expr("transform(ys, y -> y - mean)").alias("e"))
    g = g.withColumn("lag", F.expr("CAST(floor(4D * pow(n / 100D, 0.25D)) AS INT)"))
    g = g.withColumn("ss", F.expr("""aggregate(e, named_struct('c', 0D, 'ss', 0D),
        (a, v) -> named_struct('c', a.c + v, 'ss', a.ss + (a.c + v) * (a.c + v)), a -> a.ss)"""))
    g = g.withColumn("g0", F.expr("aggregate(e, 0D, (s, v) -> s + v * v)"))
    # lags of n or more have no pair of points
    g = g.withColumn("gk", F.expr("""IF(least(lag, n - 1) < 1, 0D, aggregate(sequence(1, CAST(least(lag, n - 1) AS INT)), 0D,
        (s, k) -> s + 2D * (1D - k / (lag + 1D)) * aggregate(sequence(k, CAST(n - 1 AS INT)), 0D,
            (u, i) -> u + e[i] * e[i - k])))"""))
    lrv = "((g0 + gk) / n)"
    return g.select(*keys, "n", F.expr(f"IF({lrv} > 0, ss / (n * n * {lrv}), 0D)").alias("kpss"))
