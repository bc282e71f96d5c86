"""Exact dedup with a heavy-hitter split (DataFrame functions only).

1. One pass over the texts writes a narrow table: id, SHA-256 of the text
   without white space, code points of the original text.
2. A Misra-Gries family sketch (Spark's ``approx_top_k_accumulate``:
   bounded counters, decremented together when full) names digests that
   may be frequent. It is built per task group and the estimates are added
   up, so no single task merges the sketch of every task.
3. The candidates are verified: their exact count and the row that stays
   come from one aggregate with map-side combine. At most ``max_heavy``
   such rows exist, so they are broadcast and the copies of frequent texts
   are settled map-side, without a shuffle however many there are.
4. All other digests are rare by the sketch's error bound
   (about rows / counters), so an ordinary shuffle on the digest with a
   window is safe: no group is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import keep_rows, stage, text_hash

#: Characters that the comparison ignores: space, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"


def digest_table(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, n_chars, th, digest) of every row; staged, so that rid is stable."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return stage(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id"),
        F.char_length(text).cast("long").alias("n_chars"), text_hash(F.col("text")).alias("th"),
        F.unhex(F.sha2(F.translate(text, SPACES, ""), 256)).alias("digest")), "digests")


def _order():
    """Best row of a group first: most code points, smallest id (null last), then fixed ties."""
    return F.struct((-F.col("n_chars")).alias("neg"), F.col("doc_id").isNull().alias("no_id"),
                    F.col("doc_id"), F.col("th"), F.col("rid"))


def frequent_digests(table: DataFrame, counters: int, max_heavy: int, task_groups: int = 64) -> DataFrame:
    """(h, ): 64-bit hashes of digests that may be frequent, at most ``max_heavy``.

    Every task group has a sketch of its own, and the estimates are added
    up per hash, so each group's error is relative to its own rows and the
    sum's to all rows.
    """
    h = F.xxhash64("digest").alias("h")
    parts = table.select(h, (F.spark_partition_id() % task_groups).alias("g")).groupBy("g") \
        .agg(F.expr(f"approx_top_k_accumulate(h, {counters})").alias("s"))
    found = parts.select(F.explode(F.expr(f"approx_top_k_estimate(s, {max_heavy})")).alias("e"))
    return found.groupBy(F.col("e.item").alias("h")).agg(F.sum("e.count").alias("n")).where("n > 1") \
        .orderBy(F.desc("n"), "h").limit(max_heavy).select("h")


def exact_dedup(docs: DataFrame, counters: int = 8192, max_heavy: int = 1024) -> DataFrame:
    """One row per row of ``docs`` (needs doc_id, text): doc_id, keep_id,
    group_size, kept, text_sha256, th (hash of the original text).

    Texts are equal when identical after deleting every character of
    ``SPACES``. Of equal texts, the row with the most code points in the
    original text stays, then the smallest doc_id.

    Defined cases: a null text counts as empty, and all empty texts are one
    group; a null doc_id sorts after every number (keep_id is null if such
    a row stays); rows repeated with the same id and text are a group like
    any other, and exactly one of them is kept; an empty table gives an
    empty result; extra columns are ignored whatever their names.
    """
    table = digest_table(docs)
    cand = frequent_digests(table, counters, max_heavy)
    hashed = table.withColumn("h", F.xxhash64("digest"))
    heavy = stage(hashed.join(F.broadcast(cand), "h", "left_semi").groupBy("digest")
                  .agg(F.min(_order()).alias("best"), F.count(F.lit(1)).alias("n"))
                  .select(F.col("digest").alias("hd"), F.col("best.doc_id").alias("keep_id"),
                          F.col("best.rid").alias("keep_rid"), F.col("n")), "heavy")
    tagged = table.join(F.broadcast(heavy), table["digest"] == heavy["hd"], "left")
    frequent = tagged.where("hd is not null").select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("rid") == F.col("keep_rid")).alias("kept"),
        "digest", "th")
    w = Window.partitionBy("digest").orderBy(F.desc("n_chars"), F.asc_nulls_last("doc_id"), "th", "rid")
    rest = table.join(F.broadcast(heavy), table["digest"] == heavy["hd"], "left_anti").select(
        "doc_id", F.first("doc_id").over(w).alias("keep_id"),
        F.count(F.lit(1)).over(Window.partitionBy("digest")).alias("group_size"),
        (F.row_number().over(w) == 1).alias("kept"), "digest", "th")
    return frequent.unionByName(rest).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept",
        F.lower(F.hex("digest")).alias("text_sha256"), "th")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the copies: the row that stays of every group, all columns."""
    return keep_rows(docs, exact_dedup(docs).where("kept").select("doc_id", "th"))
