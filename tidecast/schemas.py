"""Explicit schemas of the landed JSON."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

# Landed JSON (one API page per file). Only the fields the engine reads.
_USER = StructType([StructField("login", StringType())])
_AUTHOR = StructType([StructField("date", StringType())])
_COMMIT_BODY = StructType([StructField("author", _AUTHOR)])
_SHA = StructType([StructField("sha", StringType())])

LANDED = {
    "repository": StructType([
        StructField("full_name", StringType()),
        StructField("stargazers_count", LongType()),
        StructField("forks_count", LongType()),
    ]),
    "issues": StructType([
        StructField("number", LongType()),
        StructField("created_at", StringType()),
        StructField("closed_at", StringType()),
        StructField("state", StringType()),
        StructField("user", _USER),
    ]),
    "pulls": StructType([
        StructField("number", LongType()),
        StructField("created_at", StringType()),
    ]),
    "commits": StructType([
        StructField("sha", StringType()),
        StructField("commit", _COMMIT_BODY),
    ]),
    "branches": StructType([
        StructField("name", StringType()),
        StructField("commit", _SHA),
    ]),
    "contributors": StructType([
        StructField("login", StringType()),
        StructField("contributions", LongType()),
    ]),
    "releases": StructType([
        StructField("name", StringType()),
        StructField("published_at", StringType()),
    ]),
}
