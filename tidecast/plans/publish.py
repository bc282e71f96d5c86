"""Published forecasts as snapshots that are swapped in whole.

    <path>/data/publication=<id>/metric=../model=../bucket=..   rows
    <path>/manifest/version=<n>                                 one small file

A publication writes the folders it touches (old rows merged in) under an id
of its own, and then a new manifest: which publication holds each (metric,
model, bucket). A version exists once its single file has been renamed into
place, the last thing a job does. Readers take the newest manifest, so they
see the state before or after, never half of it; a job that dies earlier
leaves folders that no manifest names.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Repositories of one (metric, model) are spread over so many folders.
FORECAST_BUCKETS = 64
FOLDER = ["metric", "model", "bucket"]


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``; None if nothing was ever completed there."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, DataFrame | None]:
    """(version, (metric, model, bucket, publication)) of the newest snapshot,
    or of ``version``; (0, None) before the first."""
    versions = _read(spark, f"{path}/manifest")
    if versions is None:
        return 0, None
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    return version, versions.where(F.col("version") == version).select(*FOLDER, "publication")


def _rows(spark: SparkSession, path: str, entries: DataFrame) -> DataFrame:
    """Rows of the folders that ``entries`` name; others are pruned by their partition columns."""
    data = spark.read.option("mergeSchema", "true").parquet(f"{path}/data")
    return data.join(entries, [*FOLDER, "publication"], "left_semi")


def read_forecasts(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The published rows (``version``: of an earlier snapshot)."""
    _, entries = manifest(spark, path, version)
    if entries is None:
        raise ValueError(f"nothing published at {path}")
    return _rows(spark, path, entries).drop("publication", "bucket")


def write_forecasts(df: DataFrame, path: str) -> int:
    """Publish forecasts; returns the new version. What ``df`` holds for a
    (repo, metric, model) replaces what was there, everything else stays.

    Of two publishers at a time one gets version n + 1, the other an error
    (the version exists) and may publish again on top of it.
    """
    spark = df.sparkSession
    version, entries = manifest(spark, path)
    new = cut_lineage(df.withColumn("bucket", F.pmod(F.xxhash64("repo"), F.lit(FORECAST_BUCKETS)).cast("int")))
    touched = new.select(*FOLDER).distinct()
    merged = new
    if entries is not None:
        old = _rows(spark, path, entries.join(touched, FOLDER, "left_semi")).drop("publication")
        kept = old.join(new.select("repo", "metric", "model").distinct(), ["repo", "metric", "model"], "left_anti")
        merged = new.unionByName(kept, allowMissingColumns=True)
    publication = f"p{uuid.uuid4().hex}"
    merged.write.partitionBy(*FOLDER).parquet(f"{path}/data/publication={publication}")
    named = touched.withColumn("publication", F.lit(publication))
    if entries is not None:
        named = named.unionByName(entries.join(touched, FOLDER, "left_anti"))
    # one file, so that it appears in one rename
    named.coalesce(1).write.mode("error").parquet(f"{path}/manifest/version={version + 1}")
    return version + 1
