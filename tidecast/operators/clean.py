"""Projection, validation and filtering of entity records."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import name as repo_name
from ..functions.keys import owner as repo_owner
from ..functions.keys import repo_status
from ..functions.timecols import parse_time, to_day_text


def project_issue(raw: DataFrame) -> DataFrame:
    """P1 (+T4): landed issue objects -> clean issues table."""
    return raw.select("repo", F.col("number").alias("issue_number"),
                      to_day_text("created_at").alias("created_at"),
                      to_day_text("closed_at").alias("closed_at"),
                      F.col("state"), F.col("user.login").alias("author"))


def project_pull(raw: DataFrame) -> DataFrame:
    return raw.select("repo", F.col("number"), parse_time("created_at").alias("created_at"))


def project_commit(raw: DataFrame) -> DataFrame:
    """Sha and commit.author.date."""
    return raw.select("repo", F.col("sha"), parse_time("commit.author.date").alias("date"))


def project_branch(raw: DataFrame) -> DataFrame:
    """Name and commit.sha, plus the list position carried as ``seq``."""
    return raw.select("repo", F.col("name"), F.col("commit.sha").alias("commit_sha"), F.col("seq"))


def project_contributor(raw: DataFrame) -> DataFrame:
    """Login -> name (default 'unknown'), contributions (default 0)."""
    return raw.select("repo", F.coalesce(F.col("login"), F.lit("unknown")).alias("name"),
                      F.coalesce(F.col("contributions"), F.lit(0)).cast("long").alias("contributions"),
                      F.col("seq"))


def project_release(raw: DataFrame, strict: bool = True) -> DataFrame:
    """P5 + P9 + T2: name (default 'unknown'); releases without a
    published_at are dropped; strict format as the release endpoints use."""
    return (raw.where(F.col("published_at").isNotNull() & (F.col("published_at") != ""))
               .select("repo", F.coalesce(F.col("name"), F.lit("unknown")).alias("name"),
                       parse_time("published_at", strict=strict).alias("published_at")))


def since(df: DataFrame, col: str, as_of: _dt.date, days: int = 730) -> DataFrame:
    """Keep the last ``days`` days before ``as_of``.

    The bound is a literal on the bare column, so it reaches the parquet
    scan as a pushed filter.
    """
    lo = _dt.datetime.combine(as_of - _dt.timedelta(days=days), _dt.time())
    kind = df.schema[col].dataType
    if isinstance(kind, T.TimestampNTZType):
        bound = F.lit(lo.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")  # zone-free
    elif isinstance(kind, T.DateType):
        bound = F.lit(lo.date())
    else:
        bound = F.lit(lo)
    return df.where(F.col(col) >= bound)


def only_present(df: DataFrame, col: str) -> DataFrame:
    """Drop null (or unparsable -> null) times."""
    return df.where(F.col(col).isNotNull())


def published_only(df: DataFrame, col: str = "published_text") -> DataFrame:
    """Drop empty or missing publication text."""
    return df.where(F.nullif(F.col(col), F.lit("")).isNotNull())


def validate_repo(df: DataFrame, col: str = "repo") -> DataFrame:
    """P10: status column per key, plus owner/name when valid."""
    return df.select("*", repo_status(col).alias("status"), repo_owner(col).alias("owner"),
                     repo_name(col).alias("name"))


def dedupe_records(df: DataFrame, key: list[str], fetched: str) -> DataFrame:
    """The last fetched row of each key (overlapping pages and windows
    fetch a record again, perhaps changed since); column order is kept.

    A keyed maximum with map-side combine on the full key, so a hot
    repository is spread by its record ids.
    """
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(fetched)).alias("_r"))
    return last.select(*key, "_r.*").select(*df.columns)


def project_series(df: DataFrame, time_col: str, value_col: str | None = None, metric: str = "series") -> DataFrame:
    """Choose the time and value columns and name them ``ds``/``y``
    (value 1 per record when ``value_col`` is None)."""
    y = F.lit(1.0) if value_col is None else F.col(value_col).cast("double")
    return df.select("repo", F.lit(metric).alias("metric"), F.col(time_col).alias("ds"), y.alias("y"))
