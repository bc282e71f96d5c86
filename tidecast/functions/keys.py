"""Repository key validation (P10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repo_status(c="repo") -> Column:
    """'ok' when the key is non-empty and splits into exactly owner/name."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.when(c.isNull() | (c == ""), F.lit("invalid_repo"))
             .when(F.size(F.split(c, "/")) == 2, F.lit("ok"))
             .otherwise(F.lit("invalid_repo")))


def owner(c="repo") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(repo_status(c) == "ok", F.split(c, "/").getItem(0))


def name(c="repo") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(repo_status(c) == "ok", F.split(c, "/").getItem(1))
