"""Document fingerprints from prefix polynomial hashes.

A text's modular prefix array P[i] = sum(code[k] * base^k, k < i) mod p
gives the hash of every span in constant time, so any two spans can be
compared, and the longest common extension of two positions is found by
binary search over its length.

A fingerprint holds the length, the hash of the whole text, the prefix
and the suffix hashes at lengths growing by sqrt(2), and the smallest
hashes of all spans of ``SPAN`` code points. From two fingerprints alone
one reads: equality; the longest common prefix and suffix (binary search
over the ladders); the share of common spans. Their likeness is the larger
of the two shares, so one contiguous edit anywhere is seen as well as many
small ones.

To fingerprint each document with the next one's head spliced on, rows
must meet their successor. Ids alone are ranked: quantiles of doc_id cut
the ids into buckets, texts move once to their bucket, and the first
document of a bucket is sent to the bucket before as well. Inside a
sorted bucket each row then sees the next; no task holds more than a few
texts at a time.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import small_batches, text_hash

P31 = np.uint64((1 << 31) - 1)
#: Two bases; their hashes together have 62 bits.
BASES = (1_000_003, 776_531_401)
#: Code points of a sampled span, and how many span hashes are kept.
SPAN, KEPT = 16, 32


def mod31(x: np.ndarray) -> np.ndarray:
    """x mod 2^31 - 1 for uint64 below 2^62."""
    x = (x & P31) + (x >> np.uint64(31))
    x = (x & P31) + (x >> np.uint64(31))
    return np.where(x >= P31, x - P31, x)


@lru_cache(maxsize=16)
def _powers(base: int, size: int) -> np.ndarray:
    """base^0 .. base^(size-1) mod p, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < size:
        out = np.concatenate([out, mod31(out * np.uint64(pow(base, len(out), int(P31))))])
    return out[:size]


def powers(base: int, n: int) -> np.ndarray:
    """At least ``n`` powers; sizes are powers of two, so few arrays are kept."""
    return _powers(base, 1 << max(10, n.bit_length()))


class PrefixHash:
    """Prefix arrays of one text; spans are [i, j) in code points."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        self.n = len(self.codes)
        c = self.codes.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for b in BASES:
            p = np.empty(self.n + 1, np.uint64)
            p[0] = 0
            # terms are below 2^31, so plain sums stay exact up to 2^32 code points
            np.cumsum(mod31(c * powers(b, self.n)[:self.n]), out=p[1:])
            self.sums.append(mod31(p))

    def spans(self, i, j, which: int) -> np.ndarray:
        """Hashes of the spans [i, j) (arrays) under one base, as if each began at 0."""
        p = self.sums[which]
        inverse = powers(pow(BASES[which], -1, int(P31)), self.n + 1)
        return mod31(mod31(p[j] + P31 - p[i]) * inverse[i])

    def span(self, i: int, j: int) -> int:
        a, b = (int(self.spans(np.array([i]), np.array([j]), w)[0]) for w in (0, 1))
        return a << 31 | b

    def common(self, i: int, other: PrefixHash, j: int) -> int:
        """Longest common extension of position ``i`` here and ``j`` there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                low = mid
            else:
                high = mid - 1
        return low


@lru_cache(maxsize=64)
def _rungs(bits: int) -> np.ndarray:
    return np.unique(np.floor(2.0 ** (np.arange(2, 2 * bits + 1) / 2)).astype(np.int64))


def rungs(n: int) -> np.ndarray:
    """Lengths 2, 2, 4, 5, 8, 11, ... up to ``n``."""
    r = _rungs(max(1, n.bit_length()))
    return r[r <= n]


def _hex(x: np.ndarray) -> str:
    return x.astype(">u4").tobytes().hex()


def fingerprint(text: str) -> str:
    """length.whole.prefixes.suffixes.spans in hex; equal texts have equal fingerprints."""
    h = PrefixHash(text)
    n = h.n
    whole = int(h.sums[0][n]) << 31 | int(h.sums[1][n])
    at = rungs(n)
    zero, end = np.zeros(len(at), np.int64), np.full(len(at), n, np.int64)
    fold = np.uint64(0x9E3779B1)
    mask = np.uint64(0xFFFFFFFF)
    pre = (h.spans(zero, at, 0) * fold ^ h.spans(zero, at, 1)) & mask
    suf = (h.spans(end - at, end, 0) * fold ^ h.spans(end - at, end, 1)) & mask
    if n:
        i = np.arange(max(1, n - SPAN + 1))
        s = h.spans(i, np.minimum(i + SPAN, n), 0)
        s = (s * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        small = np.unique(np.partition(s, 8 * KEPT)[:8 * KEPT]) if len(s) > 8 * KEPT else np.unique(s)
        if len(small) < KEPT < len(s):
            small = np.unique(s)  # many repeats: look at all
        s = small[:KEPT]
    else:
        s = np.zeros(0, np.uint64)
    return f"{n:x}.{whole:x}.{_hex(pre)}.{_hex(suf)}.{_hex(s)}"


def _shared(a: str, b: str) -> int:
    """How many leading 8-digit entries agree, by binary search (agreement of prefixes is monotone)."""
    low, high = 0, min(len(a), len(b)) // 8
    while low < high:
        mid = (low + high + 1) // 2
        if a[8 * mid - 8:8 * mid] == b[8 * mid - 8:8 * mid]:
            low = mid
        else:
            high = mid - 1
    return low


def likeness(a: str, b: str) -> float:
    """0 to 1 from two fingerprints alone; 1 for equal ones."""
    if a == b:
        return 1.0
    na, _, pa_, sa, ka = a.split(".")
    nb, _, pb, sb, kb = b.split(".")
    n, m = int(na, 16), int(nb, 16)
    if not n or not m:
        return 0.0
    short = rungs(min(n, m))
    ends = [int(short[k - 1]) if k else 0 for k in (_shared(pa_, pb), _shared(sa, sb))]
    run = min(sum(ends), min(n, m)) / max(n, m)
    x = {ka[i:i + 8] for i in range(0, len(ka), 8)}
    y = {kb[i:i + 8] for i in range(0, len(kb), 8)}
    lowest = sorted(x | y)[:max(len(x), len(y))]
    jaccard = sum(v in x and v in y for v in lowest) / len(lowest)
    return max(run, 2 * jaccard / (1 + jaccard))


def edited(text: str, following: str) -> str:
    """The last floor(n / 4) code points replaced by the first as many of ``following``."""
    q = len(text) // 4
    return text[:len(text) - q] + following[:q]


def _buckets(docs: DataFrame, buckets: int) -> tuple[np.ndarray, pd.DataFrame]:
    """Cuts between buckets of ids, and each bucket's first id with the
    bucket before it (cyclically, empty buckets skipped): one row a bucket."""
    shares = ",".join(str(i / buckets) for i in range(1, buckets))
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    cuts = ids.agg(F.expr(f"percentile_approx(id, array({shares}), 10000)")).first()[0] if shares else []
    cuts = np.unique(np.array(cuts or [], np.int64))
    number = _bucket_of(cuts)
    heads = ids.withColumn("bucket", number(F.col("id"))).groupBy("bucket") \
        .agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), F.col("id"))).alias("m")) \
        .select("bucket", "m.id").toPandas().sort_values("bucket")
    heads["before"] = np.roll(heads["bucket"].to_numpy(), 1)
    return cuts, heads


def _bucket_of(cuts: np.ndarray):
    @F.pandas_udf(T.IntegerType())
    def number(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        out = np.zeros(len(ids), np.int32)  # null ids come first
        out[known] = np.searchsorted(cuts, ids[known].to_numpy(np.int64), side="right")
        return pd.Series(out)

    return number


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(bucket, guest, doc_id, text) in buckets sorted by id, each bucket
    followed by the next bucket's first rows as guests."""
    spark = docs.sparkSession
    cuts, heads = _buckets(docs, 4 * parts)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), text_hash(F.col("text")).alias("th"))
    rows = rows.withColumn("bucket", _bucket_of(cuts)(F.col("doc_id").cast("long")))
    small = spark.createDataFrame(
        [(None if pd.isna(i) else int(i), int(b)) for i, b in zip(heads["id"], heads["before"], strict=True)],
        "head long, before int")  # one row a bucket
    joined = rows.join(F.broadcast(small), rows["doc_id"].cast("long").eqNullSafe(small["head"])
                       & (F.col("before").isNotNull()), "left")
    home = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    away = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("guest"))
    places = F.when(F.col("before").isNull(), F.array(home)).otherwise(F.array(home, away))
    spread = joined.select("doc_id", "text", "th", F.explode(places).alias("p")).select("p.*", "doc_id", "text", "th")
    return spread.repartition(parts, "bucket") \
        .sortWithinPartitions("bucket", "guest", F.asc_nulls_first("doc_id"), "th").drop("th")


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (needs a numeric doc_id, text): doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    The next row is the one of the next larger doc_id; after the last comes
    the first. near_edited and near_next are the likeness of the row's
    fingerprint to the edited text's and to the next row's.

    Defined cases: a null text counts as empty (empty texts are alike with
    1, an empty and another text with 0); null ids come before all numbers;
    rows of the same id follow in the order of a hash of their text; a
    single row is its own next; an empty table gives an empty result; extra
    columns are ignored whatever their names.
    """
    small_batches(docs.sparkSession)
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
    names = [f.name for f in schema]

    def run(batches):
        held = None  # (bucket, id, text, fingerprint) of the row that waits for its next
        for batch in batches:
            ids: list = []
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for bucket, guest, doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[0] == bucket:
                    mine = held[3]
                    theirs = fingerprint(text)
                    new = edited(held[2], text)
                    print_new = mine if new == held[2] else fingerprint(new)
                    ids.append(held[1])
                    for col, v in zip(out, (len(held[2]), hashlib.sha256(new.encode()).hexdigest(), mine, print_new,
                                            likeness(mine, print_new), likeness(mine, theirs)), strict=True):
                        col.append(v)
                else:
                    theirs = None
                # a guest only closes its bucket
                held = None if guest else (bucket, doc_id, text, theirs or fingerprint(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.column(2).type), pa.array(out[0], pa.int64()),
                 *[pa.array(c, pa.string()) for c in out[1:4]], *[pa.array(c, pa.float64()) for c in out[4:]]],
                names=names)

    return with_next(docs, parts).mapInArrow(run, schema)
