"""Reports (R1-R3, R5); ``publish`` has the sink R4.

Reports are one row per repository, assembled from small keyed frames
(month counts, insights, statuses, forecasts) with left joins on ``repo``.
Nested columns (maps of month -> count, arrays of forecast points) are
built with ``map_from_entries(array_sort(collect_list(struct(...))))``:
each list is bounded by the number of months or forecast steps, never by
the number of records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import repo_status
from ..operators import insights as I
from ..session import cut_lineage

SLOTS = ["lstm", "prophet", "statsmodels"]


def _month_map(counts: DataFrame, out: str) -> DataFrame:
    return counts.groupBy("repo").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("month", "n")))).alias(out))


def _month_text(counts: DataFrame, out: str) -> DataFrame:
    e = F.array_sort(F.collect_list(F.struct("month", "n")))
    txt = F.array_join(F.transform(e, lambda x: F.concat(x["month"], F.lit(":"), x["n"].cast("string"))), ",")
    return counts.groupBy("repo").agg(txt.alias(out))


def repository_facts(repos: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """S2 semantics: stars/forks per key, missing -> 0."""
    if facts is None:
        return repos.select("repo", F.lit(0).cast("long").alias("stars"), F.lit(0).cast("long").alias("forks"))
    return repos.join(facts, "repo", "left").select(
        "repo", F.coalesce("stars", F.lit(0)).cast("long").alias("stars"),
        F.coalesce("forks", F.lit(0)).cast("long").alias("forks"))


def issue_report(issues: DataFrame, facts: DataFrame | None = None, forecasts: DataFrame | None = None,
                 flat: bool = False) -> DataFrame:
    """Facts, created/closed counts by month, three insights, and
    (optionally) each slot's forecast points as an array per repository.

    One aggregate of the issues by (repo, created day, closed day) feeds
    every branch; it is bounded by the calendar and written once.
    """
    days = cut_lineage(issues.groupBy("repo", F.col("created_at").cast("date").alias("created_at"),
                                      F.col("closed_at").cast("date").alias("closed_at"))
                       .agg(F.count(F.lit(1)).alias("w")))

    def by_month(col):
        month = F.date_format(col, "yyyy-MM").alias("month")
        return days.where(F.col(col).isNotNull()).groupBy("repo", month).agg(F.sum("w").alias("n"))

    pack = _month_text if flat else _month_map
    out = (repository_facts(days.select("repo").distinct(), facts)
           .join(pack(by_month("created_at"), "created_issues_by_month"), "repo", "left")
           .join(pack(by_month("closed_at"), "closed_issues_by_month"), "repo", "left")
           .join(I.issue_insights(days, weight="w"), "repo", "left"))
    if forecasts is not None:
        fc = forecasts.where(F.col("segment") != "train").groupBy("repo").pivot("slot", SLOTS).agg(
            F.array_sort(F.collect_list(F.struct("ds", "yhat"))))
        for s in SLOTS:
            fc = fc.withColumnRenamed(s, f"{s}_forecast")
        out = out.join(fc, "repo", "left")
    return out


def metric_reports(status: DataFrame, forecasts: DataFrame | None = None) -> DataFrame:
    """R2: one row per (repo, metric), the three slots side by side: status,
    and the forecast points (arrays by date) when given; a slot without a
    forecast is null. One keyed pivot each, however many metrics."""
    keys = ["repo", "metric"]
    out = status.groupBy(*keys).agg(
        F.max("n_records").alias("n_records"), F.max("n_points").alias("n_points"),
        *[F.max(F.when(F.col("slot") == s, F.col("status"))).alias(f"{s}_status") for s in SLOTS])
    if forecasts is not None:
        point = F.struct("ds", "yhat")
        fc = forecasts.where(F.col("segment") != "train").groupBy(*keys).agg(
            *[F.array_sort(F.collect_list(F.when(F.col("slot") == s, point))).alias(f"_{s}") for s in SLOTS])
        fc = fc.select(*keys, *[F.when(F.size(f"_{s}") > 0, F.col(f"_{s}")).alias(f"{s}_forecast") for s in SLOTS])
        out = out.join(fc, keys, "left")
    return out


def metric_report(status: DataFrame, metric: str, forecasts: DataFrame | None = None) -> DataFrame:
    """R2 of one metric."""
    fc = None if forecasts is None else forecasts.where(F.col("metric") == metric)
    return metric_reports(status.where(F.col("metric") == metric), fc).drop("metric")


def points_text(col: str):
    """'date:value,...' of an array of (ds, yhat), values with two decimals."""
    return F.array_join(F.transform(col, lambda p: F.concat(
        p["ds"].cast("string"), F.lit(":"), F.round(p["yhat"], 2).cast("decimal(18,2)").cast("string"))), ",")


def status_report(status: DataFrame, fit_status: DataFrame | None = None) -> DataFrame:
    """One status per (repo, metric, slot): gates first, then what the
    fit reported ('degenerate' / 'failed'), plus the key's own validity."""
    out = status.withColumn("key_status", repo_status("repo"))
    if fit_status is not None:
        out = out.join(fit_status, ["repo", "metric", "slot"], "left").withColumn(
            "status", F.when((F.col("status") == "ok") & F.col("fit_status").isNotNull(), F.col("fit_status"))
            .otherwise(F.col("status"))).drop("fit_status")
    return out


def month_entries(report: DataFrame) -> DataFrame:
    """R1's month maps as rows: (repo, event, month, n, months), ``months``
    being the size of the map."""
    out = None
    for event in ("created", "closed"):
        col = f"{event}_issues_by_month"
        part = report.where(F.col(col).isNotNull()).select(
            "repo", F.lit(event).alias("event"), F.explode(F.map_entries(col)).alias("e"), F.size(col).alias("months")) \
            .select("repo", "event", F.col("e.key").alias("month"), F.col("e.value").alias("n"), "months")
        out = part if out is None else out.unionByName(part)
    return out
