"""Exponential smoothing (F1-F3) as SQL folds over each series' sorted array.

One row per series holds its values as an array (bounded by the months
spanned). Every candidate smoothing parameter is evaluated inside that
row by ``transform(grid, a -> aggregate(values, ...))`` -- a higher-order
function, so there is no join against the parameter grid and nothing
leaves the JVM. The best candidate is the one with the smallest one-step
squared error (ties: the smaller parameter).

Estimators (documented, deterministic):
* SES (F1): level_0 = y_0; for t >= 1: e_t = y_t - level_{t-1},
  level_t = a*y_t + (1-a)*level_{t-1}. Grid a = 0.01 .. 0.99 step 0.01.
  Forecast: flat at the final level.
* Holt-Winters, additive season m = 12, no trend (F2): level_0 = mean of
  the first season, season_j = y_j - level_0 (j < 12); for every t:
  e_t = y_t - (level + s[t mod 12]); level' = a*(y_t - s) + (1-a)*level;
  s' = g*(y_t - level) + (1-g)*s. Grid a, g = 0.05 .. 0.95 step 0.05 with
  g <= 1 - a. Forecast h: level_n + s[(n - 1 + h) mod 12].

With ``refine`` the parameters are continuous: golden sections beside the
grid's best ones, folded inside the same row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import KEYS
from .series import sorted_points

# Gates on the number of monthly points.
SES_MIN_POINTS = 6
HW_MIN_POINTS = 24
SEASON = 12
Z80 = 1.2815515655446004  # two-sided 80 % normal quantile



SES_STEP = """(acc, y) -> named_struct(
                'sse', acc.sse + (y - acc.level) * (y - acc.level),
                'alpha', acc.alpha,
                'level', acc.alpha * y + (1D - acc.alpha) * acc.level)"""

HW_STEP = """(acc, y) -> named_struct(
            'sse', acc.sse + (y - acc.level - acc.season[acc.t % 12]) * (y - acc.level - acc.season[acc.t % 12]),
            'alpha', acc.alpha, 'gamma', acc.gamma, 't', acc.t + 1,
            'level', acc.alpha * (y - acc.season[acc.t % 12]) + (1D - acc.alpha) * acc.level,
            'season', transform(acc.season, (s, k) -> IF(k = acc.t % 12,
                       acc.gamma * (y - acc.level) + (1D - acc.gamma) * s, s)))"""


def ses_start(alpha: str) -> str:
    return f"named_struct('sse', 0D, 'alpha', {alpha}, 'level', ys[0])"


def hw_start(alpha: str, gamma: str) -> str:
    return f"""named_struct('sse', 0D, 'alpha', {alpha}, 'gamma', {gamma}, 't', 0,
                     'level', aggregate(slice(ys, 1, 12), 0D, (s, v) -> s + v) / 12D,
                     'season', transform(array(aggregate(slice(ys, 1, 12), 0D, (s, w) -> s + w) / 12D),
                                         m -> transform(slice(ys, 1, 12), v -> v - m))[0])"""


def _ses_run(alpha: str) -> str:
    """Fold of a series with one smoothing parameter: (sse, alpha, level)."""
    return f"aggregate(slice(ys, 2, greatest(size(ys) - 1, 0)), {ses_start(alpha)}, {SES_STEP})"


def _hw_run(alpha: str, gamma: str) -> str:
    """Fold of a series with one pair of parameters: (sse, alpha, gamma, t, level, season)."""
    return f"aggregate(ys, {hw_start(alpha, gamma)}, {HW_STEP})"


_SES_FOLD = f"array_min(transform(sequence(1, 99), i -> {_ses_run('i / 100D')}))"

_HW_FOLD = f"""
array_min(transform(
  filter(flatten(transform(sequence(1, 19), i -> transform(sequence(1, 19), j ->
          named_struct('a', i / 20D, 'g', j / 20D)))), p -> p.g <= 1D - p.a + 1E-9),
  p -> {_hw_run('p.a', 'p.g')}))
"""

#: Golden section: what each step leaves of the interval.
GOLDEN = (5 ** 0.5 - 1) / 2
#: Smallest smoothing parameter.
SMALLEST = 1e-4


def _golden(lo: str, hi: str, value, steps: int) -> str:
    """SQL of the point where ``value(point)`` (SQL) is least between ``lo`` and ``hi``."""
    return f"""aggregate(sequence(1, {steps}), named_struct('lo', {lo}, 'hi', {hi}),
        (s, i) -> transform(array(named_struct('l', s.hi - {GOLDEN!r}D * (s.hi - s.lo), 'r', s.lo + {GOLDEN!r}D * (s.hi - s.lo))),
            m -> IF({value('m.l')} <= {value('m.r')}, named_struct('lo', s.lo, 'hi', m.r), named_struct('lo', m.l, 'hi', s.hi)))[0],
        s -> (s.lo + s.hi) / 2D)"""


def _refined_ses() -> str:
    """The grid's best fit ``b``, or the better one that a golden section finds beside it."""
    at = _golden(f"greatest(b.alpha - 0.01D, {SMALLEST}D)", "least(b.alpha + 0.01D, 1D)",
                 lambda a: _ses_run(a) + ".sse", 40)
    return f"array_min(array(b, transform(array({at}), a -> {_ses_run('a')})[0]))"


def _refined_hw(width: float) -> list[str]:
    """Two expressions to apply to ``b`` in turn: the best alpha within
    ``width`` of its own, then the best gamma (gamma stays at 1 - alpha or less)."""
    alpha = _golden(f"greatest(b.alpha - {width}D, {SMALLEST}D)", f"greatest(least(b.alpha + {width}D, 1D - b.gamma), {SMALLEST}D)",
                    lambda a: _hw_run(a, "b.gamma") + ".sse", 16)
    gamma = _golden(f"greatest(b.gamma - {width}D, {SMALLEST}D)", f"greatest(least(b.gamma + {width}D, 1D - b.alpha), {SMALLEST}D)",
                    lambda g: _hw_run("b.alpha", g) + ".sse", 16)
    return [f"array_min(array(b, transform(array({alpha}), a -> {_hw_run('a', 'b.gamma')})[0]))",
            f"array_min(array(b, transform(array({gamma}), g -> {_hw_run('b.alpha', 'g')})[0]))"]


def _values(series: DataFrame, keys) -> DataFrame:
    pts = sorted_points(series, keys)
    return pts.select(*keys, F.transform("pts", lambda p: p["y"]).alias("ys"),
                      F.element_at("pts", -1)["ds"].alias("last_ds"),
                      F.size("pts").alias("n_points"))


def ses_fit(series: DataFrame, keys=KEYS, min_points: int = SES_MIN_POINTS, refine: bool = False) -> DataFrame:
    """F1 fit: (keys, alpha, level, sse, n_points, last_ds) per eligible series.

    ``refine``: alpha is no grid point but found between its neighbours, so
    sse is never above the grid's."""
    v = _values(series, keys).where(F.col("n_points") >= min_points).withColumn("b", F.expr(_SES_FOLD))
    if refine:
        v = v.withColumn("b", F.expr(_refined_ses()))
    return v.select(
        *keys, F.col("b.alpha").alias("alpha"), F.col("b.level").alias("level"),
        F.col("b.sse").alias("sse"), "n_points", "last_ds")


def hw_fit(series: DataFrame, keys=KEYS, min_points: int = HW_MIN_POINTS, refine: bool = False) -> DataFrame:
    """F2 fit: (keys, alpha, gamma, level, season[12], sse, n_points, last_ds).

    ``refine``: from the grid's best pair, alpha and gamma are improved in
    turn within shrinking distances; sse never rises."""
    v = _values(series, keys).where(F.col("n_points") >= min_points).withColumn("b", F.expr(_HW_FOLD))
    if refine:
        for width in (0.05, 0.05, 0.02, 0.005):
            for better in _refined_hw(width):
                v = v.withColumn("b", F.expr(better))
    return v.select(
        *keys, F.col("b.alpha").alias("alpha"), F.col("b.gamma").alias("gamma"),
        F.col("b.level").alias("level"), F.col("b.season").alias("season"),
        F.col("b.sse").alias("sse"), "n_points", "last_ds")


def _horizon(fit: DataFrame, h: int, keys) -> DataFrame:
    return fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step")) \
        .withColumn("ds", F.add_months(F.col("last_ds"), F.col("step")))


def _band(df: DataFrame, sigma) -> DataFrame:
    return df.withColumn("yhat_lower", F.col("yhat") - F.lit(Z80) * sigma) \
             .withColumn("yhat_upper", F.col("yhat") + F.lit(Z80) * sigma)


def ses_forecast(series: DataFrame, h: int = 12, keys=KEYS, refine: bool = False) -> DataFrame:
    """F1 + T9: flat 12-month forecast at month starts after the last month."""
    f = _horizon(ses_fit(series, keys, refine=refine), h, keys).withColumn("yhat", F.col("level"))
    f = _band(f, F.sqrt(F.col("sse") / F.greatest(F.col("n_points") - 1, F.lit(1))))
    return f.select(*keys, F.lit("ses").alias("model"), "step", "ds", "alpha",
                    F.lit(None).cast("double").alias("gamma"), "yhat", "yhat_lower", "yhat_upper")


def hw_forecast(series: DataFrame, h: int = 12, keys=KEYS, refine: bool = False) -> DataFrame:
    """F2 + T9: level plus the matching seasonal term for each future month."""
    f = _horizon(hw_fit(series, keys, refine=refine), h, keys)
    f = f.withColumn("yhat", F.col("level") + F.expr(
        f"season[CAST((n_points - 1 + step) % {SEASON} AS INT)]"))
    f = _band(f, F.sqrt(F.col("sse") / F.col("n_points")))
    return f.select(*keys, F.lit("holt_winters").alias("model"), "step", "ds", "alpha", "gamma",
                    "yhat", "yhat_lower", "yhat_upper")


def smoothing_forecast(series: DataFrame, h: int = 12, keys=KEYS, refine: bool = False) -> DataFrame:
    """Holt-Winters for >= 24 points, SES for 6-23; shorter series get none.

    The split is by a per-series count, so each branch only folds the
    series it is responsible for; statuses come from ``plans.report``.
    """
    from pyspark.sql import Window
    s = series.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    long_ = s.where(F.col("_n") >= HW_MIN_POINTS).drop("_n")
    short = s.where((F.col("_n") >= SES_MIN_POINTS) & (F.col("_n") < HW_MIN_POINTS)).drop("_n")
    return hw_forecast(long_, h, keys, refine).unionByName(ses_forecast(short, h, keys, refine))
