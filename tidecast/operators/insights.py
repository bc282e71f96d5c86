"""Peak weekday / month insights.

Counting is a keyed aggregate with map-side combine; the argmax runs on
at most 7 (or 12) rows per repository. Ties: earliest calendar position
(Monday first, January first), the same rule in the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecols import month_name, weekday_name, weekday_pos


def weekday_histogram(df: DataFrame, col: str) -> DataFrame:
    t = F.col(col)
    return (df.where(t.isNotNull())
              .groupBy("repo", weekday_name(t).alias("weekday"), weekday_pos(t).alias("weekday_pos"))
              .agg(F.count(F.lit(1)).alias("n")))


def month_histogram(df: DataFrame, col: str) -> DataFrame:
    t = F.col(col)
    return (df.where(t.isNotNull())
              .groupBy("repo", month_name(t).alias("month_name"), F.month(t.cast("date")).alias("month"))
              .agg(F.count(F.lit(1)).alias("n")))


def _argmax(hist: DataFrame, label: str, pos: str, out: str) -> DataFrame:
    w = Window.partitionBy("repo").orderBy(F.col("n").desc(), F.col(pos).asc())
    return (hist.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
                .select("repo", F.col(label).alias(out)))


def peak_weekday(df: DataFrame, col: str, out: str = "peak_weekday") -> DataFrame:
    """Weekday name with most records, nulls ignored."""
    return _argmax(weekday_histogram(df, col), "weekday", "weekday_pos", out)


def peak_month_name(df: DataFrame, col: str, out: str = "peak_month") -> DataFrame:
    """Month name with most records, nulls ignored."""
    return _argmax(month_histogram(df, col), "month_name", "month", out)


def issue_insights(issues: DataFrame, weight: str | None = None) -> DataFrame:
    """The three insights of the issue endpoints, with the created/closed
    columns each honoured (defect D2 fixed): repo, max_created_day_of_week,
    max_closed_day_of_week, max_closed_month_of_year.

    One pass over the issues: every issue emits three (kind, label,
    calendar position) entries, one keyed aggregate counts them (partial
    aggregation, so a hot repository is no problem), and the argmax runs
    on at most 7 + 7 + 12 rows per repository. Null dates count 0, so a
    repository whose issues are all open still gets a row (null insight).
    ``weight`` names a column with the issues a row stands for.
    """
    c, k = F.col("created_at"), F.col("closed_at")
    entries = F.array(
        F.struct(F.lit("max_created_day_of_week").alias("kind"), weekday_name(c).alias("label"),
                 weekday_pos(c).alias("pos")),
        F.struct(F.lit("max_closed_day_of_week").alias("kind"), weekday_name(k).alias("label"),
                 weekday_pos(k).alias("pos")),
        F.struct(F.lit("max_closed_month_of_year").alias("kind"), month_name(k).alias("label"),
                 F.month(k.cast("date")).alias("pos")))
    w1 = F.lit(1) if weight is None else F.col(weight)
    e = issues.select("repo", w1.alias("_w"), F.explode(entries).alias("e")).select("repo", "_w", "e.*")
    hist = e.groupBy("repo", "kind", "label", "pos").agg(F.sum(F.when(F.col("label").isNotNull(), F.col("_w"))
                                                               .otherwise(0)).alias("n"))
    w = Window.partitionBy("repo", "kind").orderBy(F.col("n").desc(), F.col("pos").asc_nulls_last())
    top = hist.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1) \
        .select("repo", "kind", F.when(F.col("n") > 0, F.col("label")).alias("label"))
    kinds = ["max_created_day_of_week", "max_closed_day_of_week", "max_closed_month_of_year"]
    return top.groupBy("repo").pivot("kind", kinds).agg(F.first("label"))
