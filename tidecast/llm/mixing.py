"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Targets: the sources in order weigh 5, 2, 1, repeating, and share
``budget`` times all words; a target stops at ``cap`` times its source's
size and the excess is shared again by weight (water filling: a source
gets ``min(cap * size, level * weight)`` for one common level).

Rates: for every source, document rates r minimise the entropy distance
to the common base rate ``budget`` under two constraints: sum(r * size) is
the target, and r <= cap. The minimum has the tilted form
r = min(cap, budget * exp(theta * size / mean size)), and theta is the
root of the convex dual's gradient. All sources take Newton steps at once,
each step one distributed aggregate, inside brackets that only shrink.
Since r depends on a document through (source, size) alone, the steps run
over the counts by (source, size), not over documents.

Copies: cumulated rates over growing sizes are rounded, so a source's
copies follow the rates with less than one copy of error anywhere; what
words that leaves over or under is settled on the smallest documents and
then on single documents of the size still missing.
Inside a cell of equal (source, size), documents are told apart by a hash
order, ranked in sqrt(n) buckets so that no cell is one task's group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import positional_index
from .rows import fresh, stage, text_hash

#: Fixed value: a word of the size measure.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def size_table(docs: DataFrame) -> DataFrame:
    """Staged (rid, doc_id, skey, source, size, th); skey is source as a non-null key."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    source = F.col("source").cast("string")
    return stage(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("skey"), source.alias("source"),
        size.alias("size"), text_hash(F.col("text")).alias("th")), "sizes")


def source_targets(cells: DataFrame, budget: float, cap: float, weights=WEIGHTS) -> DataFrame:
    """Staged (skey, source_size, docs_n, weight, target) from counts by (skey, source, size)."""
    per = stage(cells.groupBy("skey", "source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs_n"))
        .withColumn("no_source", F.col("source").isNull().cast("int")), "sources")
    ranked = positional_index(per, [], [("no_source", False), ("source", False)], out="pos")
    w = reduce(lambda c, i: c.when(F.col("pos") % len(weights) == i, float(weights[i])),
               range(1, len(weights)), F.when(F.col("pos") % len(weights) == 0, float(weights[0])))
    ranked = stage(ranked.select("skey", "source_size", "docs_n", w.alias("weight")), "weights")
    total = budget * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    # Raise the level until no source below its cap would pass it: sources
    # reach their caps in turn, so this ends after a few rounds.
    limit, level, capped = F.col("source_size") * cap, 0.0, -1
    while total > 0:
        full = limit <= F.col("weight") * level
        row = ranked.agg(F.sum(F.when(full, limit)).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("w"),
                         F.count(F.when(full, 1)).alias("k")).first()
        if row["k"] == capped or not row["w"]:
            break
        capped, level = row["k"], (total - (row["taken"] or 0.0)) / row["w"]
    return ranked.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(level)))


def _rate(budget: float, cap: float):
    tilt = F.least(F.col("theta") * F.col("size") / F.col("mean"), F.lit(700.0))
    return F.when(F.col("at_cap"), F.lit(cap)).otherwise(F.least(F.lit(cap), F.lit(budget) * F.exp(tilt)))


def balance(cells: DataFrame, targets: DataFrame, budget: float, cap: float,
            tolerance: float = 1e-7, max_steps: int = 60) -> DataFrame:
    """(skey, ..., theta): the dual solution of every source.

    Newton on the dual, safeguarded: a step that leaves the bracket
    [lo, hi] known so far is replaced by its middle, and while a side is
    still open steps are at most 4 wide.
    """
    state = stage(targets.select(
        "skey", "source_size", "target",
        F.greatest(F.col("source_size") / F.col("docs_n"), F.lit(1e-9)).alias("mean"),
        (F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)).alias("at_cap"),
        F.lit(0.0).alias("theta"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
        F.lit(False).alias("done")), "dual")
    words = F.col("n") * F.col("size")
    for _ in range(max_steps):
        r = _rate(budget, cap)
        x = F.col("size") / F.col("mean")
        sums = cells.join(state.where("not done"), "skey").groupBy("skey").agg(
            F.sum(words * r).alias("got"),
            F.sum(F.when(r < cap, words * r * x).otherwise(0.0)).alias("slope"))
        s = state.join(sums, "skey", "left").withColumn("gap", F.col("got") - F.col("target"))
        s = s.withColumn("done", F.col("done") | F.col("at_cap") | F.col("gap").isNull()
                         | (F.abs("gap") <= tolerance * F.greatest(F.col("target"), F.lit(1.0))))
        s = s.withColumn("lo", F.when(F.col("gap") < 0, F.col("theta")).otherwise(F.col("lo"))) \
            .withColumn("hi", F.when(F.col("gap") > 0, F.col("theta")).otherwise(F.col("hi")))
        newton = F.when(F.col("slope") > 0, F.col("theta") - F.col("gap") / F.col("slope")) \
            .otherwise(F.col("theta") - 4 * F.signum("gap"))
        newton = F.greatest(F.col("theta") - 4, F.least(F.col("theta") + 4, newton))
        inside = (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi")))
        nxt = F.when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = stage(s.withColumn("theta", F.when(F.col("done"), F.col("theta")).otherwise(nxt))
                      .drop("got", "slope", "gap"), "dual")
        if state.where("not done").limit(1).isEmpty():
            break
    return state


def cell_copies(cells: DataFrame, state: DataFrame, budget: float, cap: float) -> DataFrame:
    """(skey, size, n, copies): whole copies for every cell of equal (source, size)."""
    limit = int(cap)
    c = cells.join(state.select("skey", "mean", "at_cap", "theta", "target"), "skey") \
        .select("skey", "size", "n", "target", _rate(budget, cap).alias("rate"))
    w = Window.partitionBy("skey").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("skey").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("upto", F.sum(F.col("n") * F.col("rate")).over(w))
    k = F.floor(F.col("upto") + 0.5) - F.floor(F.coalesce(F.lag("upto").over(
        Window.partitionBy("skey").orderBy("size")), F.lit(0.0)) + 0.5)
    c = c.withColumn("k", F.greatest(F.lit(0), F.least(k, F.col("n") * limit)))
    # Words still missing (or over) are settled on the smallest documents, as far as they have room.
    c = c.withColumn("miss", F.col("target") - F.sum(F.col("k") * F.col("size")).over(Window.partitionBy("skey")))
    room = F.when(F.col("miss") >= 0, F.col("n") * limit - F.col("k")).otherwise(F.col("k"))
    c = c.withColumn("room", F.when(F.col("size") > 0, room).otherwise(F.lit(0)))
    c = c.withColumn("ahead", F.coalesce(F.sum(F.col("room") * F.col("size")).over(before), F.lit(0)))
    fit = F.floor((F.abs("miss") - F.col("ahead")) / F.greatest(F.col("size"), F.lit(1)))
    fix = F.greatest(F.lit(0), F.least(fit, F.col("room"))) * F.signum("miss").cast("long")
    c = c.select("skey", "size", "n", "target", (F.col("k") + fix).cast("long").alias("k"))
    # What is left is less than a document's size: one copy more (or less) of the size nearest to it, thrice.
    source = Window.partitionBy("skey")
    for _ in range(3):
        c = c.withColumn("miss", F.col("target") - F.sum(F.col("k") * F.col("size")).over(source))
        room = F.when(F.col("miss") >= 0, F.col("k") < F.col("n") * limit).otherwise(F.col("k") > 0)
        gap = F.abs(F.abs("miss") - F.col("size"))
        c = c.withColumn("gap", F.when(room & (F.col("size") > 0) & (gap < F.abs("miss")), F.struct(gap, F.col("size"))))
        chosen = F.coalesce(F.col("gap") == F.min("gap").over(source), F.lit(False))
        c = c.withColumn("k", F.col("k") + F.when(chosen, F.signum("miss").cast("long")).otherwise(F.lit(0)))
    return c.select("skey", "size", "n", F.col("k").cast("long").alias("copies"))


def mix(docs: DataFrame, budget: float = 1.5, cap: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """One row per row of ``docs`` (needs doc_id, text, source): doc_id, th,
    size, source_size, target, copies, taken (copies * size).

    Defined cases: a null text has size 0; a null source is a source of its
    own and comes last; documents of size 0 take nothing and get copies at
    the base rate; repeated rows count as documents each; a source without
    words has target 0; an empty table gives an empty result; extra columns
    are ignored whatever their names. Ranks follow a hash of id and text,
    so reruns agree whatever the partitioning.
    """
    table = size_table(docs)
    cells = stage(table.groupBy("skey", "source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    targets = stage(source_targets(cells, budget, cap, weights), "targets")
    cells = cells.select("skey", "size", "n")
    copies = cell_copies(cells, balance(cells, targets, budget, cap), budget, cap) \
        .join(targets.select("skey", "source_size", "target"), "skey")
    h = F.xxhash64("doc_id", "th")
    rows = stage(table.join(copies, ["skey", "size"]).select(
        "rid", "doc_id", "th", "skey", "size", "source_size", "target", h.alias("h"),
        F.pmod(h, F.ceil(F.sqrt("n"))).alias("bucket"),
        F.floor(F.col("copies") / F.col("n")).alias("every"), (F.col("copies") % F.col("n")).alias("extra")), "rates")
    # Rank by (bucket, h, rid) inside a cell: rank inside the bucket plus the rows of earlier buckets.
    cell = ["skey", "size"]
    inside = F.row_number().over(Window.partitionBy(*cell, "bucket").orderBy("h", "rid"))
    earlier = rows.groupBy(*cell, "bucket").agg(F.count(F.lit(1)).alias("rows_n"))
    earlier = earlier.select(*cell, "bucket", F.coalesce(F.sum("rows_n").over(
        Window.partitionBy(*cell).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    out = rows.withColumn("rank", inside).join(earlier, [*cell, "bucket"])
    n = F.col("every") + F.when(F.col("rank") + F.col("off") <= F.col("extra"), 1).otherwise(0)
    return out.select("doc_id", "th", "size", "source_size", "target", n.cast("long").alias("copies"),
                      (n * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``docs`` as the mix takes them: rows repeated by their copies, rows of no copies gone."""
    doc_id, key, n, rows, th, nth = (fresh(docs, f"mix_{c}") for c in ("id", "key", "copies", "rows", "th", "nth"))
    copies = mix(docs, budget, cap).groupBy(F.col("doc_id").alias(doc_id), F.col("th").alias(key)) \
        .agg(F.sum("copies").alias(n), F.count(F.lit(1)).alias(rows)).where(F.col(n) > 0)
    hashed = docs.withColumn(th, text_hash(F.col("text")))
    if not copies.where(F.col(rows) > 1).limit(1).isEmpty():  # repeats: one row stands for all of them
        hashed = hashed.dropDuplicates(["doc_id", th])
    out = hashed.join(copies, hashed["doc_id"].eqNullSafe(copies[doc_id]) & (hashed[th] == copies[key]))
    return out.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))) \
        .select(*[F.col(f"`{c}`") for c in docs.columns])
