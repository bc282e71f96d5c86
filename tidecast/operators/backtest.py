"""E3 over all model families: rolling-origin back-test without refitting.

An origin is a number of leading points that a model may see; it forecasts
the next ``h`` points. Least-squares models are fitted through K1 for all
origins at once: the rows between two origins make one Gram matrix each, and
an origin's matrix is the sum of those before it, so a further origin costs
one small solve and no row is read twice. The smoothing folds run once over
a series and keep their state at each origin for every parameter of the grid.

Least-squares families (features never depend on later points):

* ``index_trend``: 1 and the index.
* ``lookback``: 1 and the last ``LOOK_BACK`` values.
* ``ar5``: the last five differences, without constant, for the difference.
* ``additive``: 1, years since the first point, a bend at every full year,
  and yearly Fourier terms.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import KEYS
from ..session import cut_lineage
from .linalg import gram, solve
from .series import sorted_points
from .smoothing import HW_MIN_POINTS, HW_STEP, SEASON, SES_MIN_POINTS, SES_STEP, hw_start, ses_start

# Look-back of the monthly back-test, yearly bends and Fourier order.
LOOK_BACK = 6
BENDS = 12
ORDER = 4
AR = 5
MODELS = ("index_trend", "lookback", "ar5", "additive", "ses", "holt_winters")
NO_DOUBLES = "CAST(array() AS ARRAY<DOUBLE>)"


def _array(terms) -> str:
    return "array(" + ", ".join(terms) + ")"


def _calendar(ds: str) -> str:
    """Additive features of a date, given ``first_ds``."""
    t = f"(datediff({ds}, first_ds) / 365.25D)"
    day = f"(datediff({ds}, DATE'1970-01-01') * {2 * math.pi / 365.25!r}D)"
    waves = [f"{f}({k} * {day})" for k in range(1, ORDER + 1) for f in ("sin", "cos")]
    return _array(["1D", t] + [f"greatest({t} - {k}, 0D)" for k in range(1, BENDS + 1)] + waves)


#: model -> (first row, target, features, width, penalties)
LEAST_SQUARES = {
    "index_trend": (0, "ys[t]", _array(["1D", "CAST(t AS DOUBLE)"]), 2, 0.0),
    "lookback": (LOOK_BACK, "ys[t]", _array(["1D"] + [f"ys[t - {i}]" for i in range(1, LOOK_BACK + 1)]), LOOK_BACK + 1, 1e-6),
    "ar5": (AR + 1, "ys[t] - ys[t - 1]", _array(f"ys[t - {i}] - ys[t - {i + 1}]" for i in range(1, AR + 1)), AR, 0.0),
    "additive": (0, "ys[t]", _calendar("dss[t]"), 2 + BENDS + 2 * ORDER,
                 [1e-6, 1e-6] + [1.0] * BENDS + [1e-2] * (2 * ORDER)),
}


def _path(model: str, h: int) -> str:
    """SQL of the ``h`` forecasts after the first ``o`` points of ``ys``, given ``beta``."""
    if model == "index_trend":
        return f"transform(sequence(0, {h - 1}), k -> beta[0] + beta[1] * (o + k))"
    if model == "additive":
        width = LEAST_SQUARES[model][3]
        dot = " + ".join(f"x[{i}] * beta[{i}]" for i in range(width))
        return f"transform(sequence(0, {h - 1}), k -> transform(array({_calendar('dss[o + k]')}), x -> {dot})[0])"
    if model == "lookback":
        step = "beta[0] + " + " + ".join(f"beta[{i}] * a.r[{i - 1}]" for i in range(1, LOOK_BACK + 1))
        start = f"named_struct('r', slice(reverse(slice(ys, 1, o)), 1, {LOOK_BACK}), 'out', {NO_DOUBLES})"
        return f"""aggregate(sequence(1, {h}), {start}, (a, k) -> aggregate(array({step}), a, (b, v) -> named_struct(
            'r', concat(array(v), slice(a.r, 1, {LOOK_BACK - 1})), 'out', concat(a.out, array(v)))), a -> a.out)"""
    step = " + ".join(f"beta[{i}] * a.r[{i}]" for i in range(AR))
    last = _array(f"ys[o - {i}] - ys[o - {i + 1}]" for i in range(1, AR + 1))
    start = f"named_struct('r', {last}, 'y', ys[o - 1], 'out', {NO_DOUBLES})"
    return f"""aggregate(sequence(1, {h}), {start}, (a, k) -> aggregate(array({step}), a, (b, v) -> named_struct(
        'r', concat(array(v), slice(a.r, 1, {AR - 1})), 'y', a.y + v, 'out', concat(a.out, array(a.y + v)))), a -> a.out)"""


def origins(series: DataFrame, folds: int, h: int, least: int, keys=KEYS) -> DataFrame:
    """(keys, dss, ys, first_ds, os): one row a series with the origins it is
    long enough for, ascending: ``folds`` blocks of ``h`` points at its end,
    each with ``least`` points or more before it."""
    pts = sorted_points(series, keys).select(*keys, F.transform("pts", lambda q: q["ds"]).alias("dss"),
                                             F.transform("pts", lambda q: q["y"]).alias("ys"))
    os = f"filter(transform(sequence(1, {folds}), j -> size(ys) - ({folds} + 1 - j) * {h}), o -> o >= {least})"
    return pts.withColumn("first_ds", F.col("dss")[0]).withColumn("os", F.expr(os)).where("size(os) > 0")


def prefix_fits(rows: DataFrame, model: str, keys=KEYS) -> DataFrame:
    """(keys, o, beta) for every origin of every series."""
    start, y, x, width, ridge = LEAST_SQUARES[model]
    # a row belongs to the first origin that may see it; rows beyond the last origin to none
    each = f"""IF(element_at(os, -1) > {start}, transform(sequence({start}, greatest(element_at(os, -1) - 1, {start})),
        t -> named_struct('o', filter(os, o -> o > t)[0], 'y', {y}, 'x', {x})), NULL)"""
    points = rows.select(*keys, F.explode(F.expr(each)).alias("r")).select(*keys, "r.o", "r.y", "r.x")
    parts = gram(points, [*keys, "o"], "x", "y", width).groupBy(*keys).agg(
        F.collect_list(F.struct("o", "n", "tri")).alias("parts"))  # one an origin
    zero = f"transform(sequence(1, {(width + 1) * (width + 2) // 2}), i -> 0D)"
    sums = f"""aggregate(filter(parts, p -> p.o <= o), named_struct('n', 0L, 'tri', {zero}),
        (a, p) -> named_struct('n', a.n + p.n, 'tri', zip_with(a.tri, p.tri, (u, v) -> u + v)))"""
    whole = rows.select(*keys, F.explode("os").alias("o")).join(parts, list(keys)).withColumn("s", F.expr(sums))
    return solve(whole.select(*keys, "o", "s.n", "s.tri"), width, ridge=ridge).select(*keys, "o", F.col("fit.beta").alias("beta"))


def _smoothing(model: str, h: int) -> tuple[str, int]:
    """SQL of (origin, path) rows for a smoothing family, and its least number of points.

    Every parameter of the grid is folded once; ``runs`` holds, by parameter,
    the state at each origin. An origin then takes the parameter with the
    least error so far.
    """
    if model == "ses":
        grid = "transform(sequence(1, 99), i -> i / 100D)"
        least, path = SES_MIN_POINTS, f"transform(sequence(1, {h}), k -> b.level)"
        start, step, first = ses_start("p"), SES_STEP, 1  # the first point is the start level
        kind = "STRUCT<sse: DOUBLE, alpha: DOUBLE, level: DOUBLE>"
    else:
        grid = """filter(flatten(transform(sequence(1, 19), i -> transform(sequence(1, 19), j ->
            named_struct('a', i / 20D, 'g', j / 20D)))), p -> p.g <= 1D - p.a + 1E-9)"""
        least, path = HW_MIN_POINTS, f"transform(sequence(1, {h}), k -> b.level + b.season[(o - 1 + k) % {SEASON}])"
        start, step, first = hw_start("p.a", "p.g"), HW_STEP, 0
        kind = "STRUCT<sse: DOUBLE, alpha: DOUBLE, gamma: DOUBLE, t: INT, level: DOUBLE, season: ARRAY<DOUBLE>>"
    # from one origin to the next the fold goes on where it stopped
    states = f"""aggregate(os, named_struct('s', {start}, 'done', {first}, 'out', CAST(array() AS ARRAY<{kind}>)),
        (z, o) -> aggregate(array(aggregate(slice(ys, z.done + 1, o - z.done), z.s, {step})), z, (w, s) -> named_struct(
            's', s, 'done', o, 'out', concat(z.out, array(s)))), z -> z.out)"""
    best = f"transform(array(transform({grid}, p -> {states})), runs -> transform(os, (o, j) -> named_struct('o', o, 'path', " \
           f"transform(array(array_min(transform(runs, r -> r[j]))), b -> {path})[0])))[0]"
    return best, least


def rolling_forecasts(series: DataFrame, models=MODELS, folds: int = 6, h: int = 3, least: int = 24, keys=KEYS) -> DataFrame:
    """(keys, model, origin, step, ds, y, yhat): forecasts of every model from
    every origin. A series too short for an origin, or for a model, has no
    rows for it."""
    rows = cut_lineage(origins(series, folds, h, least, keys))
    out = None
    for model in models:
        if model in LEAST_SQUARES:
            need = LEAST_SQUARES[model][0] + 1
            paths = rows.join(prefix_fits(rows, model, keys), list(keys)).where(f"o >= {need}") \
                .withColumn("path", F.expr(_path(model, h)))
        else:
            best, need = _smoothing(model, h)
            paths = rows.withColumn("os", F.expr(f"filter(os, o -> o >= {need})")).where("size(os) > 0") \
                .withColumn("f", F.explode(F.expr(best))).select(*keys, "dss", "ys", "f.o", "f.path")
        part = paths.select(*keys, F.lit(model).alias("model"), F.col("o").alias("origin"), "dss", "ys",
                            F.posexplode("path").alias("pos", "yhat")).select(
            *keys, "model", "origin", (F.col("pos") + 1).alias("step"), F.expr("dss[origin + pos]").alias("ds"),
            F.expr("ys[origin + pos]").alias("y"), "yhat")
        out = part if out is None else out.unionByName(part)
    return out


def rolling_comparison(forecasts: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, model, n, mse, rank): models ranked by their error over all
    origins and steps; ties by name, values that are not finite last."""
    error = (F.col("y") - F.col("yhat")) * (F.col("y") - F.col("yhat"))
    m = forecasts.groupBy(*keys, "model").agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mse"))
    w = Window.partitionBy(*keys).orderBy(F.col("mse").asc_nulls_last(), "model")
    return m.withColumn("rank", F.row_number().over(w).cast("long"))
