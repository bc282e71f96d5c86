"""Helpers that several operators share: staged tables, column names that
cannot clash, and row selection by a narrow key."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let the session hand at most ``rows`` rows at once to Python.

    Batches are counted in rows, so with the usual 10,000 a batch of long
    texts takes hundreds of MB in the JVM and again in Python. A smaller
    limit that the session already has stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    have = int(spark.conf.get(name))
    if have <= 0 or have > rows:
        spark.conf.set(name, str(rows))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage: what follows starts from the written table, also
    after executors are lost. Operators write narrow tables only (ids,
    digests, counts); the pipeline also writes the texts between its stages.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/tidecast-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Narrow rows (ids, counts, hashes) that make a file of a staged table.
FILE_ROWS = 25_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of about ``rows`` narrow rows in as few partitions as they
    need, so that small tables are not written as many tiny files."""
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def fresh(df: DataFrame, name: str) -> str:
    """A column name starting with ``name`` that ``df`` doesn't use yet."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def text_hash(text: Column) -> Column:
    """64-bit hash of the whole original text (null has its own value)."""
    return F.xxhash64(text)


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` named by ``keys`` (doc_id, th), one row a key.

    ``th`` is ``text_hash(text)``. Ids may be null. A row that occurs
    several times over, same id and same text, comes out once; only then
    the surviving rows are shuffled once more to drop the repeats.
    """
    th = fresh(docs, "th")
    hashed = docs.withColumn(th, text_hash(F.col("text")))
    k = keys.select(F.col("doc_id").alias("_k_id"), F.col("th").alias("_k_th")).distinct()
    out = hashed.join(k, hashed["doc_id"].eqNullSafe(k["_k_id"]) & (hashed[th] == k["_k_th"]), "left_semi")
    repeated = docs.select("doc_id", text_hash(F.col("text")).alias("h")).groupBy("doc_id", "h").count() \
        .where("count > 1").limit(1)
    if not repeated.isEmpty():
        out = out.dropDuplicates(["doc_id", th])
    return out.drop(th)
