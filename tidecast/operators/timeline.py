"""Synthetic timelines for undated entities.

Branches and contributors carry no timestamp; the reference gives the
row at list position i (0-based) of n the day ``as_of - n + i`` and then
counts (or sums contributions) per month. Two realisations:

* ``rank_spaced_timeline``: per-row synthetic day, using the skew-safe
  distributed ``positional_index`` (no single task holds a whole repo).
* ``synthetic_monthly``: the monthly series directly, without ranking
  any record. A month's value only depends on which positions fall in
  it: for a count, that is the overlap length; for a sum ordered by the
  summed value itself (contributors, by contributions desc), rows with an
  equal value form one contiguous block of positions with one value, so
  aggregating to (repo, value, count) first is exact. Work and shuffle
  are per distinct value, not per record.

A list may be longer than the calendar (n records span n days). Days are
therefore counted as 64-bit numbers and become dates only where a date
exists; what lies before the year 1 is one row a repository with the
status ``before_calendar``, so no record is lost and no year is negative.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import positional_index


# The first day of the calendar, in days from 1970-01-01.
EPOCH = _dt.date(1970, 1, 1)
FIRST_DAY = (_dt.date(1, 1, 1) - EPOCH).days
BEFORE = "before_calendar"


def _day_number(day: _dt.date) -> int:
    return (day - EPOCH).days


def _as_date(number):
    """DATE of a day number; null before the calendar."""
    return F.when(number >= FIRST_DAY, F.date_add(F.lit(EPOCH), number.cast("int")))


def rank_spaced_timeline(df: DataFrame, as_of: _dt.date, order, out: str = "synthetic_day") -> DataFrame:
    """Per-row synthetic day ``as_of - n + position`` (flagged synthetic by
    name); null for positions before the calendar."""
    pos = positional_index(df, ["repo"], order, out="position")
    number = F.lit(_day_number(as_of)).cast("long") - F.col("group_rows") + F.col("position")
    return pos.withColumn("_day", number).withColumn(out, _as_date(F.when(F.col("_day") >= FIRST_DAY, F.col("_day")))) \
        .drop("group_rows", "_day")


def _month_overlaps(blocks: DataFrame) -> DataFrame:
    """(repo, lo, hi, v) blocks of day numbers -> (repo, ds, y = sum over
    overlap days * v, n = overlap days, status), a null ``ds`` for the days
    before the calendar."""
    early = F.greatest(F.least(F.col("hi"), F.lit(FIRST_DAY - 1)) - F.col("lo") + 1, F.lit(0))
    inside = blocks.where(F.col("hi") >= FIRST_DAY).select(
        "repo", "v", _as_date(F.greatest(F.col("lo"), F.lit(FIRST_DAY).cast("long"))).alias("lo"), _as_date(F.col("hi")).alias("hi"))
    m = inside.select("repo", "lo", "hi", "v",
                      F.explode(F.sequence(F.trunc("lo", "MM"), F.trunc("hi", "MM"),
                                           F.expr("INTERVAL 1 MONTH"))).alias("ds"))
    days = F.datediff(F.least(F.last_day("ds"), F.col("hi")), F.greatest(F.col("ds"), F.col("lo"))) + 1
    months = m.select("repo", "ds", (days * F.col("v")).alias("y"), days.cast("long").alias("n"), F.lit("ok").alias("status"))
    before = blocks.where(F.col("lo") < FIRST_DAY).select(
        "repo", F.lit(None).cast("date").alias("ds"), (early * F.col("v")).alias("y"), early.cast("long").alias("n"),
        F.lit(BEFORE).alias("status"))
    return months.unionByName(before).groupBy("repo", "ds", "status").agg(
        F.sum("y").cast("double").alias("y"), F.sum("n").cast("long").alias("n"))


def synthetic_months(df: DataFrame, as_of: _dt.date, metric: str, value_col: str | None = None) -> DataFrame:
    """(repo, metric, ds, y, n, status): monthly count (``value_col=None``) or
    monthly sum of ``value_col`` for a list ordered by ``value_col``
    descending, n the records of the month. One row a repository with a null
    ``ds`` and the status ``before_calendar`` holds what no date exists for."""
    today = F.lit(_day_number(as_of)).cast("long")
    if value_col is None:
        n = df.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
        blocks = n.select("repo", (today - F.col("n")).alias("lo"), (today - 1).alias("hi"), F.lit(1).cast("long").alias("v"))
    else:
        g = df.groupBy("repo", F.col(value_col).alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
        w_all = Window.partitionBy("repo")
        w_before = Window.partitionBy("repo").orderBy(F.col("v").desc()) \
            .rowsBetween(Window.unboundedPreceding, -1)
        g = g.withColumn("n", F.sum("cnt").over(w_all)) \
             .withColumn("start", F.coalesce(F.sum("cnt").over(w_before), F.lit(0)))
        first = today - F.col("n") + F.col("start")
        blocks = g.select("repo", "v", first.alias("lo"), (first + F.col("cnt") - 1).alias("hi"))
    return _month_overlaps(blocks).select("repo", F.lit(metric).alias("metric"), "ds", "y", "n", "status")


def synthetic_monthly(df: DataFrame, as_of: _dt.date, metric: str, value_col: str | None = None,
                      with_n: bool = False) -> DataFrame:
    """The months of ``synthetic_months`` that the calendar has; ``with_n``
    keeps the records of the month."""
    cols = ["ds", "y", "n"] if with_n else ["ds", "y"]
    return synthetic_months(df, as_of, metric, value_col).where(F.col("status") == "ok").select("repo", "metric", *cols)
