"""Series shaping: records -> (repo, metric, ds, y), gap filling, grids.

Scale notes
-----------
* The record -> series aggregate is the only step that sees raw volume.
  It is a plain ``groupBy(repo, metric, ds)`` so Spark runs a partial
  (map-side) aggregate before the shuffle: a repository holding a third
  of all records still sends at most one row per (map task, day) across
  the network.
* Everything after it works on series rows, whose count per key is
  bounded by the calendar (days or months spanned), not by data volume.
  That is what makes ``Window.partitionBy(repo, metric)`` safe below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import KEYS
from ..functions.timecols import month_text, to_day, to_month


def _time(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def monthly_count(df: DataFrame, time_col, metric: str, value_col: str | None = None) -> DataFrame:
    """A3/A5: records (or the sum of ``value_col``) per year-month.

    Null or unparsable times are dropped first (P8). ``ds`` is the
    month-start DATE (T3).
    """
    t = _time(time_col)
    y = F.count(F.lit(1)) if value_col is None else F.sum(F.col(value_col))
    return (df.where(t.isNotNull())
              .groupBy(F.col("repo"), to_month(t).alias("ds"))
              .agg(y.cast("double").alias("y"))
              .select("repo", F.lit(metric).alias("metric"), "ds", "y"))


def daily_series(df: DataFrame, time_col, metric: str, value: str = "count",
                 value_col: str = "issue_number") -> DataFrame:
    """One value per day, null days dropped.

    ``value='count'`` counts records; ``value='sum_number'`` keeps the
    reference's sum of issue numbers (defect D1) as a named option.
    """
    t = _time(time_col)
    if value == "count":
        y = F.count(F.lit(1))
    elif value == "sum_number":
        y = F.sum(F.col(value_col))
    else:
        raise ValueError(f"unknown value {value!r}")
    return (df.where(t.isNotNull())
              .groupBy(F.col("repo"), to_day(t).alias("ds"))
              .agg(y.cast("double").alias("y"))
              .select("repo", F.lit(metric).alias("metric"), "ds", "y"))


def count_by_month_text(df: DataFrame, time_col: str, out: str = "n") -> DataFrame:
    """A1/A2: records per 'YYYY-MM' month of ``time_col`` (nulls dropped)."""
    t = F.col(time_col)
    return (df.where(t.isNotNull())
              .groupBy("repo", month_text(t).alias("month"))
              .agg(F.count(F.lit(1)).alias(out)))


def month_of_year_profile(df: DataFrame, time_col) -> DataFrame:
    """A4: records per calendar month 1-12, all years folded together."""
    t = _time(time_col)
    return (df.where(t.isNotNull())
              .groupBy("repo", F.month(t.cast("date")).cast("long").alias("month"))
              .agg(F.count(F.lit(1)).alias("n")))


def series_bounds(series: DataFrame, keys=KEYS) -> DataFrame:
    """A7 + A8: first/last ds and the number of points per series."""
    return series.groupBy(*keys).agg(F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"),
                                     F.count(F.lit(1)).alias("n_points"))


def record_count(df: DataFrame) -> DataFrame:
    """Records per repository."""
    return df.groupBy("repo").agg(F.count(F.lit(1)).alias("n_records"))


def gap_fill(series: DataFrame, unit: str = "month", fill: float = 0.0, keys=KEYS) -> DataFrame:
    """T5/T6 + J1: dense grid between first and last point, ``fill`` where missing.

    One pass: each series is gathered into a ds -> y map together with its
    bounds (one keyed aggregate; the map is bounded by the calendar span),
    the calendar is exploded from the bounds, and each grid day looks its
    value up in the map. This is the left join of grid and series without
    reading the series twice (a self-join would re-run the record
    aggregate below it). Sparse months must already be month-starts.
    """
    if unit not in ("day", "month"):
        raise ValueError(unit)
    step = F.expr("INTERVAL 1 DAY") if unit == "day" else F.expr("INTERVAL 1 MONTH")
    g = series.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("ds", "y"))).alias("_m"),
                                  F.min("ds").alias("_lo"), F.max("ds").alias("_hi"))
    grid = g.select(*keys, "_m", F.explode(F.sequence("_lo", "_hi", step)).alias("ds"))
    return grid.select(*keys, "ds", F.coalesce(F.element_at("_m", F.col("ds")), F.lit(float(fill))).alias("y"))


def add_index(series: DataFrame, keys=KEYS, col: str = "idx") -> DataFrame:
    """0-based position in time order within each series."""
    w = Window.partitionBy(*keys).orderBy("ds")
    return series.withColumn(col, (F.row_number().over(w) - 1).cast("long"))


def future_month_starts(series: DataFrame, h: int = 12, keys=KEYS) -> DataFrame:
    """The next ``h`` month-starts after each series' last month."""
    last = series.groupBy(*keys).agg(F.max("ds").alias("last_ds"))
    return last.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(h))).alias("k"), "last_ds") \
        .select(*keys, F.col("k").alias("step"), F.add_months(F.trunc("last_ds", "MM"), F.col("k")).alias("ds"))


def future_month_ends(series: DataFrame, h: int = 12, keys=KEYS) -> DataFrame:
    """``h`` month-ends, the first being the end of the last observed month.

    This is what a month-end ('M') frequency continuation does when the
    history is stamped at month starts (defect D7); offered for parity.
    """
    last = series.groupBy(*keys).agg(F.max("ds").alias("last_ds"))
    return last.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(h))).alias("k"), "last_ds") \
        .select(*keys, F.col("k").alias("step"),
                F.last_day(F.add_months(F.col("last_ds"), F.col("k") - 1)).alias("ds"))


def future_days(series: DataFrame, h: int = 30, keys=KEYS) -> DataFrame:
    """The history's days plus the next ``h`` days, flagged."""
    last = series.groupBy(*keys).agg(F.max("ds").alias("last_ds"))
    fut = last.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(h))).alias("k"), "last_ds") \
        .select(*keys, F.date_add("last_ds", F.col("k")).alias("ds"), F.lit(True).alias("future"))
    hist = series.select(*keys, "ds", F.lit(False).alias("future"))
    return hist.unionByName(fut)


def forecast_tail(fc: DataFrame, n: int = 12, keys=KEYS) -> DataFrame:
    """The last ``n`` points of each series (by ds)."""
    w = Window.partitionBy(*keys).orderBy(F.col("ds").desc())
    return fc.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def sorted_points(series: DataFrame, keys=KEYS) -> DataFrame:
    """One row per series with its points as an array sorted by ds.

    ``collect_list`` alone is unordered after a shuffle, hence array_sort
    on (ds, y) structs. The array length is the series length, bounded by
    the calendar span.
    """
    return series.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("ds", "y"))).alias("pts"))
