"""value as a linear function of the month index (or month number),
fitted with SQL regression aggregates on training rows and predicted for
every row. This fills the reference's per-month "LSTM" slot, which maps
a month index (or month-of-year) to a value and plots the in-sample fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import KEYS


def index_trend_coef(df: DataFrame, x: str = "idx", train=None, keys=KEYS) -> DataFrame:
    """(keys, slope, intercept) from rows where ``train`` holds (all if None).

    A single training row (zero x-variance) gets slope 0 and its value as
    intercept.
    """
    src = df if train is None else df.where(train)
    g = src.groupBy(*keys).agg(F.regr_slope(F.col("y"), F.col(x)).alias("_s"),
                               F.regr_intercept(F.col("y"), F.col(x)).alias("_i"),
                               F.avg("y").alias("_m"))
    return g.select(*keys, F.coalesce("_s", F.lit(0.0)).alias("slope"),
                    F.coalesce("_i", F.col("_m")).alias("intercept"))


def index_trend_predict(df: DataFrame, coef: DataFrame, x: str = "idx", keys=KEYS) -> DataFrame:
    return df.join(coef, keys).withColumn("yhat", F.col("intercept") + F.col("slope") * F.col(x))


def index_trend_fit(df: DataFrame, x: str = "idx", keys=KEYS) -> DataFrame:
    """Fit on rows with split in (train, both), predict all rows."""
    coef = index_trend_coef(df, x, F.col("split").isin("train", "both"), keys)
    return index_trend_predict(df, coef, x, keys)


def profile_trend(profile: DataFrame, keys=("repo",)) -> DataFrame:
    """F10 on the month-of-year profile (A4: repo, month 1-12, n) -- the
    pulls slot's input in the reference (defect D10 kept as its own
    operator): n ~ month, fitted on all twelve (or fewer) months."""
    keys = list(keys)
    g = profile.groupBy(*keys).agg(F.regr_slope(F.col("n").cast("double"), F.col("month").cast("double")).alias("_s"),
                                   F.regr_intercept(F.col("n").cast("double"), F.col("month").cast("double"))
                                   .alias("_i"), F.avg("n").alias("_m"))
    coef = g.select(*keys, F.coalesce("_s", F.lit(0.0)).alias("slope"),
                    F.coalesce("_i", F.col("_m")).alias("intercept"))
    return profile.join(coef, keys).withColumn("yhat", F.col("intercept") + F.col("slope") * F.col("month"))
