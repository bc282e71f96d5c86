"""next-day value from the previous 30 days (the issue "LSTM" slot).

Same inputs and outputs as the reference's look-back network: the daily
series is gap-filled, min-max scaled, split 80/20 in time order, cut into
30-day look-back windows inside each split, a model is trained on the
train windows and predicts the test windows, and predictions are mapped
back to counts. Two model choices:

* ``per_series`` (default): one linear AR(30) per series, fitted with the
  K1 kernel (ridge), so a million repositories cost one aggregate.
* ``global``: one ``pyspark.ml`` LinearRegression over the train windows
  of all series (L-BFGS, so its objective history gives the training-loss
  curve of F11).
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import KEYS
from .linalg import dot_fixed, gram, solve
from .windows import LOOK_BACK, lookback_windows, minmax_scale, minmax_unscale, split_ordered

RIDGE = 1e-3


def lookback_frame(series: DataFrame, k: int = LOOK_BACK, fit_on: str = "train", keys=KEYS) -> DataFrame:
    """W3 + W2 + W1: scaled windows (keys, ds, split, x, y_scaled, y, y_min, y_max)."""
    s = split_ordered(series, keys=keys)
    s = minmax_scale(s, "y", "y_scaled", fit_on=fit_on, keys=keys)
    return lookback_windows(s, k, by_split=True, col="y_scaled", keys=keys)


def lookback_forecast(series: DataFrame, k: int = LOOK_BACK, fit_on: str = "train",
                      model: str = "per_series", keys=KEYS) -> DataFrame:
    """Rows (keys, model, segment, ds, y, yhat) for train and test windows."""
    lb = lookback_frame(series, k, fit_on, keys)
    if model == "per_series":
        xs = F.concat(F.array(F.lit(1.0)), F.col("x"))
        tr = lb.where(F.col("split") == "train").select(*keys, xs.alias("xs"), "y_scaled")
        beta = solve(gram(tr, keys, "xs", "y_scaled", k + 1), k + 1, ridge=RIDGE) \
            .select(*keys, F.col("fit.beta").alias("beta"))
        pred = lb.join(beta, keys).withColumn(
            "p", F.col("beta")[0] + dot_fixed("x", "beta", k, b_offset=1))
    elif model == "global":
        vec = lb.withColumn("features", array_to_vector("x"))
        lr = LinearRegression(featuresCol="features", labelCol="y_scaled", predictionCol="p",
                              regParam=RIDGE, elasticNetParam=0.0, solver="l-bfgs", maxIter=50)
        fitted = lr.fit(vec.where(F.col("split") == "train"))
        pred = fitted.transform(vec).drop("features")
    else:
        raise ValueError(model)
    pred = minmax_unscale(pred, "p", "yhat")
    return pred.select(*keys, F.lit(f"lookback_{model}").alias("model"), F.col("split").alias("segment"),
                       "ds", "y", "yhat")


def training_loss(series: DataFrame, k: int = LOOK_BACK, max_iter: int = 50, keys=KEYS) -> DataFrame:
    """objective per iteration of the global model, plus the final
    train and test mean squared error on the scaled values."""
    spark = series.sparkSession
    lb = lookback_frame(series, k, "train", keys).withColumn("features", array_to_vector("x"))
    lr = LinearRegression(featuresCol="features", labelCol="y_scaled", regParam=RIDGE,
                          elasticNetParam=0.0, solver="l-bfgs", maxIter=max_iter, standardization=False)
    m = lr.fit(lb.where(F.col("split") == "train"))
    hist = m.summary.objectiveHistory  # one number per iteration (bounded by max_iter)
    curve = spark.createDataFrame([(i, float(v)) for i, v in enumerate(hist)], "iteration INT, loss DOUBLE")
    ev = m.transform(lb).groupBy("split").agg(
        F.avg((F.col("y_scaled") - F.col("prediction")) * (F.col("y_scaled") - F.col("prediction"))).alias("mse"))
    return curve, ev
