"""Minimum-data gates (P12) and the eligible / rejected split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import repo_status


def slot_gates():
    """MAP<metric, ARRAY<slot, estimator, min_records, min_points>> literal
    built from the registry (fixed size), for a per-row lookup + explode."""
    from ..registry import METRICS
    entries = []
    for m, spec in METRICS.items():
        entries.append(F.lit(m))
        entries.append(F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(sl.estimator).alias("estimator"),
                                          F.lit(sl.gate.min_records).alias("min_records"),
                                          F.lit(sl.gate.min_points).alias("min_points"))
                                 for s, sl in spec.slots.items()]))
    return F.create_map(*entries)


def series_counts(series: DataFrame, repos: DataFrame, metrics: list[str]) -> DataFrame:
    """(repo, metric, n_records, n_points) for every repository and metric,
    zeros where a repository has no record of a metric.

    ``series``: staged points (repo, metric, ds, y, n) with n the records of
    the point; ``repos``: (repo). Counts come from the series, so no record
    is read again.
    """
    counts = series.groupBy("repo", "metric").agg(F.sum("n").cast("long").alias("n_records"),
                                                  F.count(F.lit(1)).alias("n_points"))
    known = repos.select("repo").union(series.select("repo")).distinct()
    base = known.select("repo", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    zero = F.lit(0).cast("long")
    return base.join(counts, ["repo", "metric"], "left").select(
        "repo", "metric", F.coalesce("n_records", zero).alias("n_records"), F.coalesce("n_points", zero).alias("n_points"))


def eligibility(counts: DataFrame, gate_metric: str = "metric") -> DataFrame:
    """Status per (repo, metric, slot) from per-series counts.

    ``counts``: (repo, metric, n_records, n_points). Status is
    'invalid_repo' when the key is not 'owner/name' (P10), 'no_data'
    without records, 'not_enough_data' below a gate, else 'ok'. Each row
    picks its metric's slots from the registry map and explodes them -- no
    join, so nothing degrades into a nested loop when ``metric`` is a
    constant. ``gate_metric`` names the column whose gates apply.
    """
    j = counts.select("*", F.explode(F.element_at(slot_gates(), F.col(gate_metric))).alias("_g")) \
        .select("*", "_g.*").drop("_g")
    status = (F.when(repo_status("repo") != "ok", repo_status("repo"))
               .when(F.col("n_records") == 0, F.lit("no_data"))
               .when((F.col("n_records") < F.col("min_records")) | (F.col("n_points") < F.col("min_points")),
                     F.lit("not_enough_data"))
               .otherwise(F.lit("ok")))
    return j.select("repo", "metric", "slot", "estimator", "n_records", "n_points", status.alias("status"))


def eligible_series(series: DataFrame, status: DataFrame, slot: str) -> DataFrame:
    """Series rows whose (repo, metric) passes ``slot``'s gate (left semi)."""
    ok = status.where((F.col("slot") == slot) & (F.col("status") == "ok")).select("repo", "metric")
    return series.join(ok, ["repo", "metric"], "left_semi")


def rejected_series(series: DataFrame, status: DataFrame, slot: str) -> DataFrame:
    """Series rows that fail ``slot``'s gate (left anti against the ok set)."""
    ok = status.where((F.col("slot") == slot) & (F.col("status") == "ok")).select("repo", "metric")
    return series.join(ok, ["repo", "metric"], "left_anti")


def missing_column_status(df: DataFrame, metric: str, columns: list[str]) -> DataFrame | None:
    """When a landed entity lacks a column the metric needs (e.g. a
    pulls landing without ``created_at``), every (repo, slot) of that
    metric gets 'no_column' instead of a crash. The check itself is on
    the schema (driver side, no data read); None when all columns exist."""
    missing = [c for c in columns if c not in df.columns]
    if not missing:
        return None
    from ..registry import METRICS
    slots = F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(sl.estimator).alias("estimator"))
                      for s, sl in METRICS[metric].slots.items()])
    return df.select("repo").distinct().select("repo", F.lit(metric).alias("metric"), F.explode(slots).alias("s")) \
        .select("repo", "metric", "s.slot", "s.estimator", F.lit(0).cast("long").alias("n_records"),
                F.lit(0).cast("long").alias("n_points"), F.lit("no_column").alias("status"))
