"""Monthly activity counts kept current as new API pages land.

The reference pulls every page again on each request. Here new page files
are picked up by a file-source stream, parsed exactly like the batch
reader, and folded into running (repo, metric, month) counts. The state is
one row per (repository, month) -- bounded by the calendar, not by the
number of records -- and is checkpointed in the query's checkpoint
location (a shared folder on a cluster), so a restarted query resumes
from the last committed batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timecols import to_month
from ..schemas import LANDED
from ..sources.landed import _PATH, _PROJECT, PAGE_STRIDE

TIME_COL = {"issues": "created_at", "pulls": "created_at", "commits": "date", "releases": "published_at"}


def stream_records(spark: SparkSession, root: str, entity: str, max_files: int = 1000) -> DataFrame:
    """Streaming version of ``read_entity`` (dated entities only)."""
    path = f"{root.rstrip('/')}/{entity}/*/*/"
    raw = (spark.readStream.option("maxFilesPerTrigger", max_files)
           .text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("p")))
    pages = raw.select(
        "value",
        F.concat_ws("/", F.regexp_extract("p", _PATH, 2), F.regexp_extract("p", _PATH, 3)).alias("repo"),
        F.coalesce(F.regexp_extract("p", _PATH, 4).try_cast("long"), F.lit(0)).alias("page"))
    recs = pages.select("repo", "page", F.posexplode(F.from_json("value", T.ArrayType(LANDED[entity])))
                        .alias("pos", "r"))
    recs = recs.select("repo", (F.col("page") * PAGE_STRIDE + F.col("pos")).alias("seq"), "r.*")
    return _PROJECT[entity](recs)


def monthly_counts_stream(records: DataFrame, entity: str) -> DataFrame:
    """Running A3 over a stream: (repo, metric, ds, y)."""
    t = F.col(TIME_COL[entity])
    return (records.where(t.isNotNull())
                   .groupBy("repo", to_month(t).alias("ds"))
                   .agg(F.count(F.lit(1)).cast("double").alias("y"))
                   .select("repo", F.lit(entity).alias("metric"), "ds", "y"))


def start_monthly_counts(spark: SparkSession, root: str, entity: str, checkpoint: str,
                         sink, trigger_once: bool = False):
    """Start the stream. ``sink(batch_df, batch_id)`` receives the updated
    (repo, metric, ds, y) rows of each micro-batch (update mode)."""
    counts = monthly_counts_stream(stream_records(spark, root, entity), entity)
    w = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
