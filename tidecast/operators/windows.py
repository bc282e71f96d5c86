"""Series window operators: look-back arrays, scaling, splits, differencing
(W1-W6). All windows are partitioned by the series key and run on series
rows (bounded by the calendar span per key), never on raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import KEYS

# Look-back length, train share of the ordered split, test
# share and seed of the shuffled split.
LOOK_BACK = 30
TRAIN_FRAC = 0.8
TEST_FRAC = 0.2
SPLIT_SEED = 42


def split_ordered(series: DataFrame, frac: float = TRAIN_FRAC, keys=KEYS) -> DataFrame:
    """The first ``floor(frac * n)`` points (by ds) are train, the rest test."""
    w = Window.partitionBy(*keys).orderBy("ds")
    wn = Window.partitionBy(*keys)
    return (series.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
                  .withColumn("n_points", F.count(F.lit(1)).over(wn))
                  .withColumn("split", F.when(F.col("idx") < F.floor(F.col("n_points") * F.lit(frac)),
                                              F.lit("train")).otherwise(F.lit("test"))))


def split_hashed(series: DataFrame, test_frac: float = TEST_FRAC, seed: int = SPLIT_SEED,
                 keys=KEYS) -> DataFrame:
    """Shuffled split with a fixed seed; test = first ceil(test_frac * n)
    points in md5(repo|idx|seed) order. Fewer than 2 points: the single
    point is used for both ('both'), as the reference trains on all."""
    w = Window.partitionBy(*keys).orderBy("ds")
    wn = Window.partitionBy(*keys)
    h = F.md5(F.concat_ws("|", F.col("repo"), F.col("idx").cast("string"), F.lit(str(seed))))
    wh = Window.partitionBy(*keys).orderBy(h)
    s = (series.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
               .withColumn("n_points", F.count(F.lit(1)).over(wn))
               .withColumn("_hr", F.row_number().over(wh)))
    n_test = F.ceil(F.col("n_points") * F.lit(test_frac))
    return s.withColumn("split", F.when(F.col("n_points") < 2, F.lit("both"))
                        .when(F.col("_hr") <= n_test, F.lit("test")).otherwise(F.lit("train"))).drop("_hr")


def minmax_scale(df: DataFrame, col: str = "y", out: str = "y_scaled", fit_on: str = "all",
                 keys=KEYS) -> DataFrame:
    """Per-series scaling to [0, 1]; a constant series maps to 0.

    ``fit_on='train'`` takes min/max from train rows only (needs a
    ``split`` column; fixes the leak D8), ``'all'`` matches the reference.
    """
    wn = Window.partitionBy(*keys)
    src = F.col(col) if fit_on == "all" else F.when(F.col("split").isin("train", "both"), F.col(col))
    d = (df.withColumn("y_min", F.min(src).over(wn)).withColumn("y_max", F.max(src).over(wn)))
    rng = F.col("y_max") - F.col("y_min")
    return d.withColumn(out, F.when(rng == 0, F.col(col) - F.col("y_min"))
                        .otherwise((F.col(col) - F.col("y_min")) / rng))


def minmax_unscale(df: DataFrame, col: str, out: str) -> DataFrame:
    """Inverse of ``minmax_scale`` given the y_min / y_max columns."""
    rng = F.col("y_max") - F.col("y_min")
    return df.withColumn(out, F.when(rng == 0, F.col(col) + F.col("y_min"))
                         .otherwise(F.col(col) * rng + F.col("y_min")))


def lookback_windows(series: DataFrame, k: int = LOOK_BACK, by_split: bool = True, col: str = "y",
                     keys=KEYS) -> DataFrame:
    """Each row with the previous ``k`` values as ``x``, target ``y``.

    Rows without ``k`` predecessors are dropped. With ``by_split`` the
    windows are formed separately inside each split (the reference's
    behaviour, D9); otherwise test rows may look back into train.
    """
    part = [*keys, "split"] if by_split else list(keys)
    w = Window.partitionBy(*part).orderBy("ds").rowsBetween(-k, -1)
    return (series.withColumn("x", F.collect_list(F.col(col)).over(w))
                  .where(F.size("x") == k))


def difference(series: DataFrame, keys=KEYS, col: str = "y", out: str = "dy") -> DataFrame:
    """First difference in time order (null for the first point)."""
    w = Window.partitionBy(*keys).orderBy("ds")
    return series.withColumn(out, F.col(col) - F.lag(col, 1).over(w))


def lag_matrix(df: DataFrame, p: int, col: str = "dy", keys=KEYS, prefix: str = "lag") -> DataFrame:
    """Lags 1..p of ``col`` as columns."""
    w = Window.partitionBy(*keys).orderBy("ds")
    return df.select("*", *[F.lag(col, i).over(w).alias(f"{prefix}{i}") for i in range(1, p + 1)])
