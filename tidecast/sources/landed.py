"""Landed API pages.

Layout: ``{root}/{entity}/{owner}/{name}/page-NNNN.json``, one JSON array
(one API page) per file, except ``repository`` which holds one object per
file. The repository key ``owner/name`` comes from the path.

Each page is read whole (``wholetext``) and parsed with an explicit
schema, then ``posexplode`` yields every record with its position, so
list order (needed by the undated entities, T8) is exact: ``seq =
page * 1_000_000 + position``. A page is one API response (<= 100
records), so a file is always a small unit of work; parallelism comes
from the number of pages. Parquet landings (already flat, with ``repo``)
are read directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean as C
from ..schemas import LANDED

PAGE_STRIDE = 1_000_000
_PATH = r".*/([^/]+)/([^/]+)/([^/]+)/[^/]*?(\d+)?\.json$"


def _pages(spark: SparkSession, root: str, entity: str) -> DataFrame:
    path = f"{root.rstrip('/')}/{entity}/*/*/*.json"
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("p"))
    return raw.select(
        "value",
        F.concat_ws("/", F.regexp_extract("p", _PATH, 2), F.regexp_extract("p", _PATH, 3)).alias("repo"),
        F.coalesce(F.regexp_extract("p", _PATH, 4).try_cast("long"), F.lit(0)).alias("page"))


def read_raw(spark: SparkSession, root: str, entity: str) -> DataFrame:
    """S1 (raw): one row per landed record, API field names, plus repo/seq."""
    schema = LANDED[entity]
    pages = _pages(spark, root, entity)
    recs = pages.select("repo", "page", F.posexplode(F.from_json("value", T.ArrayType(schema))).alias("pos", "r"))
    return recs.select("repo", (F.col("page") * PAGE_STRIDE + F.col("pos")).alias("seq"), "r.*")


def parse_records(df: DataFrame, entity: str, col: str = "json") -> DataFrame:
    """Records kept as one JSON text a row (repo, seq, ``col``) -> landed
    columns. Malformed text gives null fields, absent fields are null."""
    return df.select("repo", "seq", F.from_json(col, LANDED[entity]).alias("r")).select("repo", "seq", "r.*")


def project(raw: DataFrame, entity: str) -> DataFrame:
    """Landed columns -> clean entity table."""
    return _PROJECT[entity](raw)


def repository_facts(raw: DataFrame) -> DataFrame:
    """Stars and forks per repository; a missing count is 0."""
    return raw.select("repo", F.coalesce("stargazers_count", F.lit(0)).cast("long").alias("stars"),
                      F.coalesce("forks_count", F.lit(0)).cast("long").alias("forks"))


_PROJECT = {
    "issues": C.project_issue,
    "pulls": C.project_pull,
    "commits": C.project_commit,
    "branches": C.project_branch,
    "contributors": C.project_contributor,
    "releases": C.project_release,
}


def read_entity(spark: SparkSession, root: str, entity: str, fmt: str = "json") -> DataFrame:
    """Clean entity table from landed pages."""
    if fmt == "parquet":
        return spark.read.parquet(f"{root.rstrip('/')}/{entity}")
    return _PROJECT[entity](read_raw(spark, root, entity))


def read_repository(spark: SparkSession, root: str) -> DataFrame:
    """Repository facts; a missing count is 0."""
    pages = _pages(spark, root, "repository")
    return repository_facts(pages.select("repo", F.from_json("value", LANDED["repository"]).alias("r"))
                            .select("repo", "r.*"))


def concat_pages(*dfs: DataFrame) -> DataFrame:
    """S3: append page sets (columns missing on one side become null)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def restrict_to(df: DataFrame, repos: DataFrame) -> DataFrame:
    """Keep the selected repositories (a user-supplied key list).

    A semi join; Spark broadcasts the key list only if AQE measures it
    under the broadcast threshold, otherwise it shuffles both sides.
    """
    return df.join(repos.select("repo").distinct(), "repo", "left_semi")
