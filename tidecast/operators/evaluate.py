"""Hold-out evaluation.

``holdout_frame`` fits a model on the ordered train part of every series
and produces the segmented frame behind the reference's charts: train
rows with in-sample fitted values, test rows with the forecast over the
held-out span. E1 (mse) and E3 (model ranking) are aggregates over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import KEYS
from .smoothing import _SES_FOLD
from .series import sorted_points
from .trend import index_trend_coef


def _train_test(split_series: DataFrame):
    return (split_series.where(F.col("split") == "train"), split_series.where(F.col("split") == "test"))


def holdout_index_trend(split_series: DataFrame, keys=KEYS) -> DataFrame:
    """Linear trend on the train index; fitted on train, predicted on test."""
    coef = index_trend_coef(split_series, "idx", F.col("split") == "train", keys)
    out = split_series.join(coef, keys).withColumn("yhat", F.col("intercept") + F.col("slope") * F.col("idx"))
    return out.select(*keys, F.lit("index_trend").alias("model"), F.col("split").alias("segment"),
                      "ds", "y", "yhat")


def holdout_ses(split_series: DataFrame, keys=KEYS) -> DataFrame:
    """SES chosen on train; train rows get one-step fitted values
    (null for the first point), test rows the flat final train level."""
    train, _ = _train_test(split_series)
    pts = sorted_points(train.select(*keys, "ds", "y"), keys)
    v = pts.select(*keys, "pts", F.transform("pts", lambda p: p["y"]).alias("ys"))
    v = v.withColumn("b", F.expr(_SES_FOLD))
    path = F.expr("""aggregate(slice(ys, 2, greatest(size(ys) - 1, 0)),
        named_struct('level', ys[0], 'out', array(CAST(NULL AS DOUBLE))),
        (acc, y) -> named_struct('level', b.alpha * y + (1D - b.alpha) * acc.level,
                                 'out', concat(acc.out, array(acc.level))))""")
    v = v.withColumn("f", path)
    fitted = v.select(*keys, F.posexplode(F.arrays_zip(F.col("pts"), F.col("f.out"))).alias("i", "z")) \
        .select(*keys, F.col("z.pts.ds").alias("ds"), F.col("z.out").alias("yhat"))
    level = v.select(*keys, F.col("f.level").alias("level"))
    tr = train.join(fitted, [*keys, "ds"], "left").select(*keys, F.lit("train").alias("segment"), "ds", "y", "yhat")
    te = split_series.where(F.col("split") == "test").join(level, keys) \
        .select(*keys, F.lit("test").alias("segment"), "ds", "y", F.col("level").alias("yhat"))
    return tr.unionByName(te).select(*keys, F.lit("ses").alias("model"), "segment", "ds", "y", "yhat")


def _sq_err():
    return (F.col("y") - F.col("yhat")) * (F.col("y") - F.col("yhat"))


def mse(frame: DataFrame, keys=KEYS, segment: str | None = "test") -> DataFrame:
    """Mean squared error per (keys, model[, segment])."""
    f = frame.where(F.col("yhat").isNotNull())
    if segment is not None:
        f = f.where(F.col("segment") == segment)
        return f.groupBy(*keys, "model").agg(F.avg(_sq_err()).alias("mse"))
    return f.groupBy(*keys, "model", "segment").agg(F.avg(_sq_err()).alias("mse"))


def compare_models(frame: DataFrame, keys=KEYS) -> DataFrame:
    """Rank models per series by hold-out mse (1 = best, ties by name)."""
    m = mse(frame, keys, "test")
    w = Window.partitionBy(*keys).orderBy(F.col("mse").asc(), F.col("model").asc())
    return m.withColumn("rank", F.row_number().over(w).cast("long"))
