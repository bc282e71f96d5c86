"""Exact top-k inner products by pivot-table elimination.

Vectors become whole numbers, floor(256 x). With |q - v|^2 = |q|^2 + |v|^2
- 2 q.v a lower bound on a distance is an upper bound on a score, and the
triangle inequality gives one for every pivot p: |q - v| >= ||q-p| - |v-p||.

1. Pivots come from a bounded sample (``SAMPLE`` rows, chosen by hash);
   they and the sample decide how much is evaluated, never the result. The
   origin is always a pivot, so no bound is worse than |q| |v|.
2. Every vector gets its distances to all pivots. Sorted by nearest pivot
   and distance to it, rows are packed into blocks of ``BLOCK``: one row a
   block with its vectors, its pivot table, and the least and greatest
   distance to each pivot. Many equal vectors simply fill several blocks.
3. A query's k-th score in the sample is a floor for its k-th score in all.
   Queries meet the summaries of all blocks, ``SUMMARIES`` at a time; a
   block whose best possible score is below the floor never sees the query.
4. In a block, candidates are evaluated in order of their bound until the
   next bound is below the k-th score so far. Bounds have a margin above
   rounding, evaluated scores are 64-bit whole numbers.

Queries travel in parts of at most ``QUERY_PART``, so a unit of work is one
block and one part, whatever the size of the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import small_batches, stage

#: Rows of the sample for pivots and floors, and its bytes.
SAMPLE, SAMPLE_BYTES = 4096, 1 << 24
#: Pivots of each dimension besides the origin.
PIVOTS = 16
#: Vectors of a block, block summaries and queries that meet at once.
BLOCK, SUMMARIES, QUERY_PART = 4096, 512, 16_384
#: Tasks of the searches in blocks; more units than this share tasks.
MAX_TASKS = 20_000
#: Components from here on would leave 32 bits, squared lengths 61 bits.
LARGEST, LONGEST = float(1 << 23), float(1 << 61)
#: No floor.
NONE = -(1 << 63)

PLACED = "dim int, region int, ring double, rid long, vec_id long, n2 long, v binary, d binary"
PACKED = "block long, dim int, n int, ids binary, no_id binary, rids binary, n2 binary, v binary, d binary, " \
         "lo binary, hi binary, top long"
QUERY = "rid long, vec_id long, dim int, n2 long, v binary, d binary, floor long, part int"


def names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def vectors(table: DataFrame) -> DataFrame:
    """(rid, vec_id, dim, v, n2) of every row that takes part; staged, so that rid is stable."""
    fine = table.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x")) \
        .where(F.col("x").isNotNull()) \
        .where(F.forall("x", lambda x: F.coalesce(F.abs(x) < LARGEST, F.lit(False)))) \
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("x", lambda x: F.floor(256 * x)).alias("v")) \
        .where(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x) < LONGEST)
    return stage(fine.select(F.monotonically_increasing_id().alias("rid"), "vec_id", F.size("v").alias("dim"), "v",
                             F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x).alias("n2")), "vectors")


class Reference:
    """Pivots and sample of one dimension."""

    def __init__(self, rids: np.ndarray, sample: np.ndarray, pivots: int):
        self.rids, self.sample = rids, sample
        # farthest-first: each pivot is the row farthest from all before it, beginning at the origin
        points = sample.astype(float)
        chosen, near = [np.zeros(sample.shape[1])], np.sqrt((points ** 2).sum(1))
        while len(chosen) <= pivots and len(near) and near.max() > 0:
            chosen.append(points[near.argmax()])
            near = np.minimum(near, np.sqrt(((points - chosen[-1]) ** 2).sum(1)))
        self.pivots = np.array(chosen)

    def distances(self, v: np.ndarray) -> np.ndarray:
        """(rows, pivots)"""
        return np.stack([np.sqrt(((v - p) ** 2).sum(1)) for p in self.pivots], 1)

    def floors(self, v: np.ndarray, rids: np.ndarray, k: int) -> np.ndarray:
        """k-th score of each row in the sample, without the row itself."""
        scores = np.stack([self.sample @ q for q in v]) if len(v) else np.zeros((0, len(self.rids)), np.int64)
        own = rids[:, None] == self.rids
        scores[own] = NONE
        if scores.shape[1] < k:
            return np.full(len(v), NONE)
        return np.partition(scores, scores.shape[1] - k, 1)[:, scores.shape[1] - k]


def references(table: DataFrame, sample: int, pivots: int) -> dict[int, Reference]:
    """By dimension; a dimension that the sample lacks has the origin alone."""
    n, widest = table.agg(F.count(F.lit(1)), F.max("dim")).first()
    if not n:
        return {}
    rows = max(1, min(sample, SAMPLE_BYTES // (8 * max(1, widest))))
    share = min(1.0, 1.25 * rows / n)
    drawn = table.where(F.pmod(F.xxhash64("rid", "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1) \
        .select("rid", "dim", "v").limit(rows).collect()
    by: dict[int, list] = {}
    for r in drawn:
        by.setdefault(r["dim"], []).append(r)
    return {dim: Reference(np.array([r["rid"] for r in of]),
                           np.array([r["v"] for r in of], np.int64).reshape(len(of), dim), pivots)
            for dim, of in by.items()}


def by_dimension(batch: pa.RecordBatch, known: dict[int, Reference]):
    """(rows, vectors, reference) of a batch for each dimension in it."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        v = batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        yield at, v.reshape(len(at), dim), known.get(int(dim)) or Reference(np.zeros(0, np.int64), v[:0].reshape(0, dim), 0)


def placed(table: DataFrame, known) -> DataFrame:
    """Every vector with its pivot table row, nearest pivot and distance to it."""
    def place(batches):
        for batch in batches:
            for at, v, ref in by_dimension(batch, known.value):
                d = ref.distances(v)
                part = batch.take(pa.array(at))
                region = d[:, 1:].argmin(1) + 1 if d.shape[1] > 1 else np.zeros(len(at), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("dim"), pa.array(region.astype(np.int32)), pa.array(d[np.arange(len(at)), region]),
                     part.column("rid"), part.column("vec_id"), part.column("n2"),
                     pa.array([x.tobytes() for x in v.astype("<i4")], pa.binary()),
                     pa.array([x.tobytes() for x in d], pa.binary())], names=names(PLACED))
    return table.select("rid", "vec_id", "dim", "v", "n2").mapInArrow(place, PLACED)


def packed(rows: DataFrame, n: int, block: int) -> DataFrame:
    """Blocks of neighbouring vectors, one row each. Staged."""
    spark = rows.sparkSession
    slices = max(1, min(-(-n // (4 * block)), 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = ["dim", "region", "ring", "rid"]

    def pack(batches):
        first, made, held = TaskContext.get().partitionId() << 32, 0, []

        def row():
            dim = held[0][0]
            d = np.frombuffer(b"".join(r[7] for r in held)).reshape(len(held), -1)
            ids = np.array([r[4] or 0 for r in held], np.int64)
            n2 = np.array([r[5] for r in held], np.int64)
            values = [first + made, dim, len(held), ids.tobytes(), np.array([r[4] is None for r in held]).tobytes(),
                      np.array([r[3] for r in held], np.int64).tobytes(), n2.tobytes(), b"".join(r[6] for r in held),
                      d.tobytes(), d.min(0).tobytes(), d.max(0).tobytes(), int(n2.max())]
            return pa.RecordBatch.from_pylist([dict(zip(names(PACKED), values, strict=True))], schema=PACKED_ARROW)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) >= block or held[0][0] != r[0]):
                    yield row()
                    made, held = made + 1, []
                held.append(r)
        if held:
            yield row()

    return stage(rows.repartitionByRange(slices, *order).sortWithinPartitions(*order).mapInArrow(pack, PACKED), "blocks")


PACKED_ARROW = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]])
                          for c in PACKED.split(", ")])
QUERY_ARROW = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]])
                         for c in QUERY.split(", ")])


def queries(table: DataFrame, known, every: int, k: int, parts: int) -> DataFrame:
    """The query rows with pivot distances and floors."""
    def prepare(batches):
        for batch in batches:
            for at, v, ref in by_dimension(batch, known.value):
                rows = batch.take(pa.array(at))
                rids = rows.column("rid").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [rows.column("rid"), rows.column("vec_id"), rows.column("dim"), rows.column("n2"),
                     pa.array([x.tobytes() for x in v.astype("<i4")], pa.binary()),
                     pa.array([x.tobytes() for x in ref.distances(v)], pa.binary()),
                     pa.array(ref.floors(v, rids, k)), pa.array((rids % parts).astype(np.int32))], names=names(QUERY))
    return table.where(F.pmod("vec_id", F.lit(every)) == 0).select("rid", "vec_id", "dim", "v", "n2") \
        .mapInArrow(prepare, QUERY)


def bounds(n2: np.ndarray | float, other: np.ndarray | float, apart: np.ndarray) -> np.ndarray:
    """Greatest possible scores of vectors at least ``apart`` from each other, with a margin above rounding."""
    return (n2 + other - apart ** 2) / 2 + 1e-12 * (n2 + other) + 1e-6


def rounding(dim: int, d: np.ndarray, other: np.ndarray) -> np.ndarray:
    """More than rounding can change differences of the distances ``d`` and ``other``."""
    return (dim + 8) * 2.3e-16 * (d.max(-1) + other.max(-1))


def apart(dim: int, d: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least distance of points with pivot distances ``d`` from points between ``lo`` and ``hi``."""
    out = np.zeros(np.broadcast_shapes(d.shape[:-1], lo.shape[:-1]))
    for p in range(d.shape[-1]):
        np.maximum(out, np.maximum(lo[..., p] - d[..., p], d[..., p] - hi[..., p]), out=out)
    return np.maximum(out - rounding(dim, d, hi), 0)


def meet_summaries(left: pa.Table, right: pa.Table) -> pa.Table:
    """Queries (left) x summaries (right): the queries that each block must see."""
    out = []
    dims, blocks = right.column("dim").to_numpy(), right.column("block").to_numpy()
    q_dims = left.column("dim").to_numpy()
    for dim in np.unique(q_dims):
        of = np.flatnonzero(dims == dim)
        if not len(of):
            continue
        lo, hi = (np.frombuffer(b"".join(right.column(c).take(pa.array(of)).to_pylist())).reshape(len(of), -1)
                  for c in ("lo", "hi"))
        top = right.column("top").to_numpy()[of].astype(float)
        rows = np.flatnonzero(q_dims == dim)
        for a in range(0, len(rows), 1024):
            part = left.take(pa.array(rows[a:a + 1024]))
            d = np.frombuffer(b"".join(part.column("d").to_pylist())).reshape(len(part), -1)
            n2 = part.column("n2").to_numpy().astype(float)[:, None]
            best = bounds(n2, top, apart(dim, d[:, None, :], lo, hi))
            q, b = np.nonzero(best >= part.column("floor").to_numpy().astype(float)[:, None])
            out.append(part.take(pa.array(q)).select(names(QUERY)).append_column("block", pa.array(blocks[of[b]])))
    if not out:
        return pa.schema([*QUERY_ARROW, ("block", pa.int64())]).empty_table()
    return pa.concat_tables(out)


def search(q: np.ndarray, n2: int, d: np.ndarray, floor: int, rid: int, block: dict, k: int) -> np.ndarray:
    """Best (score, vec_id, no id, rid) of a block, at most k, none below ``floor``."""
    least = np.abs(block["d"] - d[:, None]).max(0)
    least = np.maximum(least - rounding(len(q), d, block["farthest"]), 0)
    possible = bounds(float(n2), block["n2"], least)
    possible[block["rids"] == rid] = -np.inf
    order = np.flatnonzero(possible >= floor)
    order = order[np.argsort(-possible[order], kind="stable")]
    best = np.zeros((0, 4), np.int64)
    v = block["v"]
    if n2 and n2 * block["top"] < 1 << 104:
        q, v = q.astype(float), block["v_float"]  # products below 2^52: exact, and several times as fast
    kth, a, size = floor, 0, 256
    while a < len(order) and possible[order[a]] >= kth:
        at = order[a:a + size]
        # where most of a block is left, one product over all of it is cheaper than picking rows
        scores = ((v @ q)[at] if 3 * len(at) > len(v) else v[at] @ q).astype(np.int64)
        ok = scores >= kth
        at, scores = at[ok], scores[ok]
        best = np.concatenate([best, np.stack([scores, block["ids"][at], block["no_id"][at], block["rids"][at]], 1)])
        best = best[np.lexsort((best[:, 3], best[:, 1], best[:, 2], -best[:, 0]))][:k]
        if len(best) == k:
            kth = max(kth, int(best[-1, 0]))
        a, size = a + size, 16 * size
    return best


FOUND = "q_rid long, query_id long, vec_id long, rid long, score long"
FOUND_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in FOUND.split(", ")])


def meet_block(k: int):
    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """The queries (left) of one block (right)."""
        if not len(left) or not len(right):
            return FOUND_ARROW.empty_table()
        row = right.select(names(PACKED)).to_pylist()[0]
        n, dim = row["n"], row["dim"]
        block = {"ids": np.frombuffer(row["ids"], np.int64), "no_id": np.frombuffer(row["no_id"], bool).astype(np.int64),
                 "rids": np.frombuffer(row["rids"], np.int64), "n2": np.frombuffer(row["n2"], np.int64).astype(float),
                 "v": np.frombuffer(row["v"], "<i4").astype(np.int64).reshape(n, dim), "top": row["top"],
                 "d": np.ascontiguousarray(np.frombuffer(row["d"]).reshape(n, -1).T)}
        block["farthest"] = block["d"].max(1)
        block["v_float"] = block["v"].astype(float)
        out, q_rids, q_ids = [], [], []
        for q in left.select(names(QUERY)).to_pylist():
            best = search(np.frombuffer(q["v"], "<i4").astype(np.int64), q["n2"], np.frombuffer(q["d"]), q["floor"],
                          q["rid"], block, k)
            out.append(best)
            q_rids += [q["rid"]] * len(best)
            q_ids += [q["vec_id"]] * len(best)
        found = np.concatenate(out)
        ids = pa.array(found[:, 1], mask=found[:, 2].astype(bool))
        return pa.Table.from_arrays([pa.array(q_rids, pa.int64()), pa.array(q_ids, pa.int64()), ids,
                                     pa.array(found[:, 3]), pa.array(found[:, 0])], schema=FOUND_ARROW)
    return meet


def top_k(table: DataFrame, every: int = 50, k: int = 5, pivots: int = PIVOTS, sample: int = SAMPLE,
          block: int = BLOCK) -> DataFrame:
    """The ``k`` highest scores of each query: query_id, rank, vec_id, score.

    ``table`` needs vec_id and embedding (array of numbers). Queries are the
    rows whose vec_id is divisible by ``every``, candidates all rows but the
    query's own; the score is the inner product of floor(256 x), ties go to
    the smaller vec_id.

    Defined cases: a vector that is null or holds a null, infinite or
    not-a-number component takes no part, nor does one whose scores could
    leave 64 bits (a component of 2^23 or more, a squared whole length of
    2^61 or more); vectors of different lengths never meet, empty vectors
    score 0 with one another; a row without vec_id is no query, and as a
    candidate comes after all others of its score; of rows repeated with
    one id each is a query and a candidate of its own, so results repeat;
    an empty table, or no other row of the length, gives no rows; extra
    columns are ignored whatever their names.
    """
    spark = table.sparkSession
    small_batches(spark)
    rows = vectors(table)
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if(F.pmod("vec_id", F.lit(every)) == 0)).first()
    known = spark.sparkContext.broadcast(references(rows, sample, pivots))
    parts = max(1, -(-n_queries // QUERY_PART))
    blocks = packed(placed(rows, known), n, block)
    n_blocks = blocks.count()
    chunks = max(1, -(-n_blocks // SUMMARIES))
    chunk = F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int")
    summaries = blocks.select("block", "dim", "lo", "hi", "top", chunk.alias("chunk"))
    asked = queries(rows, known, every, k, parts)
    every_chunk = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    every_part = summaries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    seen = every_chunk.groupBy("chunk", "part").cogroup(every_part.groupBy("chunk", "part")) \
        .applyInArrow(meet_summaries, f"{QUERY}, block long")
    dealt = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # as many tasks as units: the rows are few bytes and much work, which Spark would put into one task
    units = max(1, min(n_blocks * parts, MAX_TASKS))
    met = (df.repartition(units, "block", "part").groupBy("block", "part") for df in (seen, dealt))
    found = next(met).cogroup(next(met)).applyInArrow(meet_block(k), FOUND)
    w = Window.partitionBy("q_rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
