"""Resharding by minimum-cost flow.

The documents lie in old shards; new shards have capacities in bytes. Old
shards are supplies (their sizes), new shards demands (their capacities),
and a byte that stays in its shard costs nothing while a moved byte costs
one (or what a cost table says). The flow of least cost is the plan that
moves the fewest bytes. The network has one node a shard, so it is solved
on the driver from one row a shard, whatever the number of documents.

The plan is carried out in blocks. Each old shard's documents are hashed
into blocks; blocks lie one after another, and so do the plan's amounts: a
document goes where its middle byte falls. A block that lies inside one
amount moves whole, only the few blocks at a border are split. Offsets
come from block sums first and sums inside a block second, so no task ever
holds a whole shard. Only shards that gain or lose are rewritten: into a new
generation of the table, whose manifest names for every shard the generation
that holds it, so an emptied shard is simply no longer named.
"""

from __future__ import annotations

import uuid
from itertools import accumulate
from math import isqrt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranking import positional_index
from .rows import few, fresh, stage, text_hash

#: Folder names of a sharded table; no column of a table has them.
SHARD, GENERATION = "__shard", "__generation"


def least_cost_flow(supply: list[int], demand: list[int], cost=None) -> list[list[int]]:
    """flow[i][j]: units from i to j that meet all supplies and demands at least cost.

    Successive shortest augmenting paths over the residual graph (a path
    may run back along flow already placed). ``cost(i, j)`` must not be
    negative; by default staying (i == j) is free and moving costs one.
    The sums of both lists must be equal.
    """
    if sum(supply) != sum(demand):
        raise ValueError("supplies and demands must have the same sum")
    price = cost or (lambda i, j: 0 if i == j else 1)
    n, m = len(supply), len(demand)
    flow = [[0] * m for _ in range(n)]
    left, need = list(supply), list(demand)
    while any(left):
        dist: list[float] = [0 if left[i] else float("inf") for i in range(n)] + [float("inf")] * m
        came = [-1] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] + price(i, j) < dist[n + j]:
                        dist[n + j], came[n + j], changed = dist[i] + price(i, j), i, True
                    if flow[i][j] and dist[n + j] - price(i, j) < dist[i]:
                        dist[i], came[i], changed = dist[n + j] - price(i, j), n + j, True
        end = min((n + j for j in range(m) if need[j]), key=lambda v: dist[v])
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        path.reverse()
        amount = min([left[path[0]], need[end - n],
                      *(flow[b][a - n] for a, b in zip(path, path[1:], strict=False) if a >= n)])
        for a, b in zip(path, path[1:], strict=False):
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[path[0]] -= amount
        need[end - n] -= amount
    return flow


def size_table(docs: DataFrame, old_shard: Column) -> DataFrame:
    """Staged (rid, doc_id, size, text_crc32, h, old): size is UTF-8 bytes plus one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return stage(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64("doc_id", "text").alias("h"), text_hash(F.col("text")).alias("th"),
        old_shard.cast("int").alias("old")), "shards")


def capacities(total: int, shards: int) -> list[int]:
    """Equal shares of ``total``, at most one byte apart."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def shares(total: int, wanted: list[int]) -> list[int]:
    """``total`` shared in proportion to ``wanted`` capacities (none negative,
    not all zero); what rounding leaves goes to the largest remainders."""
    whole = sum(wanted)
    out = [total * w // whole for w in wanted]
    for i in sorted(range(len(wanted)), key=lambda i: (-(total * wanted[i] % whole), i))[:total - sum(out)]:
        out[i] += 1
    return out


def plan(table: DataFrame, old_shards: int, shards: int, wanted: list[int] | None = None) -> tuple[list[list[int]], int]:
    """The flow between old and new shards, and the bytes it moves."""
    sizes = [0] * old_shards
    for r in table.groupBy("old").agg(F.sum("size").alias("n")).collect():  # one row a shard
        sizes[r["old"]] = r["n"]
    flow = least_cost_flow(sizes, shares(sum(sizes), wanted) if wanted else capacities(sum(sizes), shards))
    return flow, sum(f for i, row in enumerate(flow) for j, f in enumerate(row) if i != j)


def reshard(docs: DataFrame, shards: int = 8, old_shards: int = 6, old_shard: Column | None = None,
            wanted: list[int] | None = None) -> DataFrame:
    """One row per row of ``docs`` (needs doc_id, text): doc_id, size,
    text_crc32, law, shard, slot, grown_shard, old_shard, th.

    The law is ``bytes``: the new shards' sizes are equal, or as ``wanted``
    (one capacity a shard, any unit, taken as proportions), but for the
    documents at the borders (at most one document each side). ``old_shard``
    says where a row lies now, 0 to ``old_shards`` - 1; by default rows lie
    by a hash of id and text. slot counts a shard's rows gaplessly from 0 in
    (old shard, block, hash) order, so reruns agree.

    Defined cases: a null text has size 1; a null doc_id is placed by its
    text; rows repeated with the same id are rows like any other, and equal
    texts need not share a shard (a group of copies may exceed a shard);
    an empty table gives an empty result; extra columns are ignored
    whatever their names.
    """
    old = old_shard if old_shard is not None else F.pmod(F.xxhash64("doc_id", "text"), F.lit(old_shards))
    if wanted is not None and (len(wanted) != shards or min(wanted) < 0 or not sum(wanted)):
        raise ValueError("wanted has one capacity a shard, none negative and not all zero")
    table = size_table(docs, old)
    flow, _ = plan(table, old_shards, shards, wanted)
    # As many blocks as rows in a block: both windows below stay small at any size.
    # Large documents come first, where rows stay, so borders fall between small ones.
    n, mean = table.agg(F.count(F.lit(1)), F.avg("size")).first()
    blocks = max(1, isqrt(n // old_shards))
    block = F.pmod(F.xxhash64("h", F.lit(7)), F.lit(blocks))
    rows = table.withColumn("block", F.when(F.col("size") > 2 * (mean or 0), block).otherwise(block + blocks))

    # Where each row begins in its old shard: the blocks before, then the rows before inside the block.
    before = Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("old", "block").agg(F.sum("size").alias("bytes")) \
        .select("old", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("old", "block").orderBy("h", "rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))) \
        .join(sums, ["old", "block"]).withColumn("middle2", 2 * (F.col("base") + F.col("inner")) + F.col("size"))

    # The plan's amounts one after another: first what stays, then what leaves.
    target = F.lit(None).cast("int")
    for i, row in enumerate(flow):
        stay = [(i, row[i])] if i < shards else []
        amounts = [(j, f) for j, f in [*stay, *((j, f) for j, f in enumerate(row) if j != i)] if f]
        chosen = F.lit(amounts[-1][0] if amounts else 0)
        ends = list(accumulate(f for _, f in amounts))
        for (j, _), end in reversed(list(zip(amounts, ends, strict=True))[:-1]):
            chosen = F.when(F.col("middle2") < 2 * end, j).otherwise(chosen)
        target = F.when(F.col("old") == i, chosen).otherwise(target)
    located = placed.withColumn("shard", target.cast("int")).select(
        "rid", "doc_id", "size", "text_crc32", "h", "th", "old", "block", "shard")

    # Slots: rows of the shard in earlier (old, block) cells, then the rank inside the cell.
    cells = located.groupBy("shard", "old", "block").agg(F.count(F.lit(1)).alias("rows_n"))
    ahead = Window.partitionBy("shard").orderBy("old", "block").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", "old", "block", F.coalesce(F.sum("rows_n").over(ahead), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard", "old", "block").orderBy("h", "rid")) - 1
    return few(located.withColumn("rank", rank).join(cells, ["shard", "old", "block"]), n).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("old").alias("old_shard"), "th")


def generations(spark: SparkSession, path: str) -> DataFrame | None:
    """(shard, generation) of the newest manifest; None before the first."""
    try:
        known = spark.read.parquet(f"{path}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    newest = known.agg(F.max("written").alias("newest"))
    return known.join(newest, known["written"] == newest["newest"]).select("shard", "generation")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The sharded table: columns as written, and the shard in the column
    ``shard`` (``shard_`` and so on where the table has one)."""
    data = spark.read.parquet(f"{path}/data")
    named = generations(spark, path).select(F.col("shard").alias(SHARD), F.col("generation").alias(GENERATION))
    own = data.drop(SHARD, GENERATION)
    return data.join(named, [SHARD, GENERATION], "left_semi").select(*own.columns, F.col(SHARD).alias(fresh(own, "shard")))


def rewrite_affected(docs: DataFrame, placed: DataFrame, path: str) -> list[int]:
    """Write the shards that gain or lose rows into a new generation at
    ``path`` and return their numbers; the files of all other shards stay
    untouched. The first call writes every shard.

    ``placed`` is the result of ``reshard`` over the same rows. ``docs`` may
    have columns of any name. Rows repeated with one id and one text go to
    the shards that ``placed`` says, as many to each as it counts. An
    emptied shard is not named in the new manifest, which is one file,
    written last: a job that dies before leaves the old state.
    """
    spark = docs.sparkSession
    known = generations(spark, path)
    moved = placed.where(F.col("shard") != F.col("old_shard"))
    both = moved.select("shard").union(moved.select(F.col("old_shard").alias("shard"))).distinct()
    touched = sorted(r["shard"] for r in both.collect())  # at most one number a shard
    if known is None:
        touched = sorted({r["shard"] for r in placed.select("shard").distinct().collect()} | set(touched))
    key, at, place = (fresh(docs, c) for c in ("key", "at", "place"))

    def named(df: DataFrame, th: Column) -> DataFrame:
        return df.withColumn(key, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), th.cast("string")))

    places = named(placed.where(F.col("shard").isin(touched)), F.col("th")).select(key, F.col("shard").alias(SHARD), F.col("slot").alias(at))
    repeated = named(placed, F.col("th")).groupBy(key).count().where("count > 1").select(key)
    rows = named(docs, text_hash(F.col("text")))
    out = rows.join(places.join(repeated, key, "left_anti"), key).select(*docs.columns, SHARD)
    if not repeated.isEmpty():
        # the i-th row of an id and text takes the i-th of its places, touched or not
        again = named(placed, F.col("th")).join(repeated, key, "left_semi").select(key, F.col("shard").alias(SHARD), F.col("slot").alias(at))
        numbered = positional_index(again, [key], [(SHARD, False), (at, False)], out=place).select(key, place, SHARD)
        twins = positional_index(rows.join(repeated, key, "left_semi").withColumn(at, F.monotonically_increasing_id()),
                                 [key], [(at, False)], out=place)
        out = out.unionByName(twins.join(numbered.where(F.col(SHARD).isin(touched)), [key, place]).select(*docs.columns, SHARD))
    generation = f"g{uuid.uuid4().hex}"
    out.write.partitionBy(SHARD).parquet(f"{path}/data/{GENERATION}={generation}")
    new = placed.where(F.col("shard").isin(touched)).select("shard").distinct().withColumn("generation", F.lit(generation))
    if known is not None:
        new = new.unionByName(known.where(~F.col("shard").isin(touched)))
    written = (spark.read.parquet(f"{path}/manifest").agg(F.max("written")).first()[0] + 1) if known is not None else 1
    new.coalesce(1).write.parquet(f"{path}/manifest/written={written}")
    return touched
