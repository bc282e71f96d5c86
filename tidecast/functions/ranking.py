"""Skew-safe ranking helpers.

A window partitioned only by ``repo`` sends every row of a repository to
one task. For raw records (not series) that is unbounded, so these
helpers rank without ever putting a whole key into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_columns(order) -> list[Column]:
    """``[("col", descending), ...]`` -> sort columns (nulls placed like SQL)."""
    out = []
    for c, desc in order:
        out.append(F.col(c).desc() if desc else F.col(c).asc())
    return out


def positional_index(df: DataFrame, part_cols: list[str], order, out: str = "pos",
                     num_partitions: int | None = None, stage: bool = True) -> DataFrame:
    """0-based position of each row within ``part_cols`` in ``order``, plus
    the group size as ``group_rows``.

    Equivalent to ``row_number() over (partition by part_cols order by ...) - 1``
    but a hot key is spread over many tasks:

    1. range-partition by (part_cols, order): each task holds a contiguous
       slice of the global order, so a hot key spans several tasks;
    2. rank inside each (task, key) slice -- bounded by the task size;
    3. per-(task, key) row counts (a tiny aggregate) turned into offsets
       with a running sum over task ids of the same key;
    4. position = offset of the slice + rank inside it.

    The ranked slices feed two branches (the counts and the final join),
    so with ``stage`` they are written once (reliable checkpoint) instead
    of range-shuffling the input twice.

    ``order`` must be a total order within a key (add a unique tie-break),
    otherwise positions among ties are arbitrary, as with row_number.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_cols = [F.col(c) for c in part_cols] + order_columns(order)
    ranged = df.repartitionByRange(n, *sort_cols).withColumn("_pid", F.spark_partition_id())
    w = Window.partitionBy("_pid", *part_cols).orderBy(*order_columns(order))
    local = ranged.withColumn("_lpos", F.row_number().over(w) - 1)
    if stage:
        from ..session import cut_lineage
        local = cut_lineage(local)
    counts = local.groupBy("_pid", *part_cols).agg(F.count(F.lit(1)).alias("_cnt"))
    wc = Window.partitionBy(*part_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = (counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(wc), F.lit(0)))
                  .withColumn("group_rows", F.sum("_cnt").over(Window.partitionBy(*part_cols)))
                  .drop("_cnt"))
    return (local.join(offs, ["_pid", *part_cols])
                 .withColumn(out, (F.col("_off") + F.col("_lpos")).cast("long"))
                 .drop("_pid", "_lpos", "_off"))


def top_k_per_group(df: DataFrame, group_cols: list[str], order, k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per group in ``order`` (ties broken by the order).

    ``row_number() ... <= k`` lets Catalyst insert a partial group limit
    before the shuffle (WindowGroupLimit), so at most ``k`` rows per group
    and map task cross the network even for a hot group.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order_columns(order))
    return df.withColumn(out, F.row_number().over(w).cast("long")).where(F.col(out) <= k)
