"""Near-duplicate join on word shingles: MinHash with Bayesian pruning, exact verification.

1. Each text becomes its set of five-word shingles (64-bit hashes) and a
   MinHash signature. Texts of equal shingle sets are one class; only one
   row a class goes on, so copies never meet each other.
2. Signatures are cut into bands; classes that agree in a band fall into
   a bucket. Buckets of the same members are kept once.
3. In a bucket, signatures are compared a few hashes at a time. A pair is
   dropped as soon as the posterior probability that its similarity
   reaches the threshold, given the matches so far, falls below
   ``TOLERANCE``. What survives is handed on as a spanning star a group,
   not as pairs.
4. Connected survivors form candidate groups (large-star / small-star,
   on tables, never on the driver). Texts are read once more for them, and
   every pair inside a group is verified exactly by counting common
   shingles, again giving counts and spanning stars, not pairs.
5. Verified links connect the classes into near-duplicate groups.

Large buckets and groups are split into blocks, and each pair of blocks is
a task's unit of its own; a row is sent to as many units as there are
blocks. So the largest unit is bounded and no member or link is dropped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import few, keep_rows, small_batches, stage, text_hash

WORDS = 5
THRESHOLD = Fraction(4, 5)
#: 28 bands of 4: a pair of similarity 0.8 misses all bands with probability 4e-7.
BANDS, ROWS = 28, 4
HASHES = BANDS * ROWS
#: Hashes compared before each pruning step, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Members of a block of signatures, and of shingle sets.
SIGNATURE_BLOCK, SHINGLE_BLOCK = 512, 256
#: Keys are broadcast up to this many rows (about 40 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 500_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M3
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _tables():
    """Word bytes (a-z, 0-9, _ and all of non-ASCII), byte values, hash family: from one fixed seed."""
    rng = np.random.default_rng(20240229)
    word = np.zeros(256, bool)
    for a, b in ((48, 58), (95, 96), (97, 123), (128, 256)):
        word[a:b] = True
    value = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    mult = rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
    return word, value, mult, add


@lru_cache(maxsize=1)
def _places() -> np.ndarray:
    """An odd factor for each place in a word (they recur in words beyond 65,536 bytes)."""
    return _mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of ``text``.

    Words are runs of letters, digits and underscores (and any non-ASCII
    character) in lower case. A text of fewer than five words has one
    shingle of all its words, a text without words none.
    """
    word, value, _, _ = _tables()
    data = np.frombuffer(text.lower().encode("utf-8"), np.uint8)
    edge = np.diff(np.concatenate([[0], word[data].view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    # hash of a word: the sum of byte value x factor of its place in the word
    at = np.arange(len(data))
    place = (at - start[np.maximum(np.cumsum(edge[:-1] == 1) - 1, 0)]) & 0xFFFF
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(value[data] * _places()[place])])
        w = _mix(sums[end] - sums[start] + (end - start).astype(np.uint64) * _M1)
        n = min(WORDS, len(w))
        h = np.zeros(len(w) - n + 1, np.uint64)
        for k in range(n):
            h = h * _M1 + w[k:len(w) - n + 1 + k]
        return np.unique(_mix(h + np.uint64(n)))


def signature(sh: np.ndarray) -> np.ndarray:
    """``HASHES`` 16-bit MinHash values of a non-empty shingle set."""
    _, _, mult, add = _tables()
    low = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for at in range(0, len(sh), 2048):  # bounded memory for long texts
            part = sh[at:at + 2048]
            low = np.minimum(low, (part[:, None] * mult + add).min(axis=0))
    # the low bits of a product depend on few bits of its factors: take mixed ones
    return (_mix(low) >> np.uint64(48)).astype(np.uint16)


def least_matches(compared: int, threshold: float = float(THRESHOLD), tolerance: float = TOLERANCE) -> int:
    """Fewest matches among ``compared`` hashes that keep a pair.

    With a uniform prior, the similarity after m matches of n has a
    Beta(m + 1, n - m + 1) posterior, and the probability that it reaches t
    is the binomial sum of C(n + 1, i) t^i (1 - t)^(n + 1 - i) for i <= m.
    """
    n, total = compared + 1, 0.0
    for m in range(compared + 1):
        total += math.comb(n, m) * threshold ** m * (1 - threshold) ** (n - m)
        if total >= tolerance:
            return m
    return compared


def surviving(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Boolean matrix: pairs of signature rows that no pruning step drops."""
    alive = np.ones((len(a), len(b)), bool)
    matches = np.zeros((len(a), len(b)), np.int16)
    for at in range(0, HASHES, STEP):
        upto = min(at + STEP, HASHES)
        need = least_matches(upto)
        i, j = np.nonzero(alive)
        if not len(i):
            break
        if 4 * len(i) > alive.size:
            for k in range(at, upto):
                matches += a[:, k, None] == b[None, :, k]
            alive &= matches >= need
        else:
            for lo in range(0, len(i), 1 << 16):
                x, y = i[lo:lo + (1 << 16)], j[lo:lo + (1 << 16)]
                matches[x, y] += (a[x, at:upto] == b[y, at:upto]).sum(axis=1, dtype=np.int16)
                alive[x, y] = matches[x, y] >= need
    return alive


def common_counts(sets: list[np.ndarray], rows: slice, cols: slice) -> np.ndarray:
    """How many shingles each of ``sets[rows]`` shares with each of ``sets[cols]``, exactly."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    col = np.cumsum(np.concatenate([[True], flat[1:] != flat[:-1]])) - 1
    often = np.bincount(col)[col] > 1  # a shingle of one set only is common to no pair
    row, col = row[often], col[often]
    total = np.zeros((len(sets[rows]), len(sets[cols])), np.float32)
    if not len(col):
        return total
    col = np.cumsum(np.concatenate([[0], col[1:] != col[:-1]]))
    for at in range(0, int(col[-1]) + 1, 4096):  # a slice of columns at a time
        here = (col >= at) & (col < at + 4096)
        dense = np.zeros((len(sets), min(4096, int(col[-1]) + 1 - at)), np.float32)
        dense[row[here], col[here] - at] = 1
        total += dense[rows] @ dense[cols].T
    return total


def stars(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each row's connected part under a symmetric link matrix."""
    root = np.full(len(ids), -1, np.int64)
    for first in np.argsort(ids, kind="stable"):
        if root[first] >= 0:
            continue
        part = np.zeros(len(ids), bool)
        part[first] = True
        front = part
        while front.any():
            reach = links[front].any(axis=0) & ~part
            part = part | reach
            front = reach
        root[part] = ids[first]
    return root


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Columns (as lists) of each run of equal first ``keys`` columns in a sorted stream."""
    held: list[list] | None = None
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        n, at = len(cols[0]), 0
        while at < n:
            key, end = [c[at] for c in cols[:keys]], at + 1
            while end < n and all(c[end] == k for c, k in zip(cols[:keys], key, strict=True)):
                end += 1
            part = [c[at:end] for c in cols]
            if held is not None and [c[0] for c in held[:keys]] == key:
                held = [x + y for x, y in zip(held, part, strict=True)]
            else:
                if held is not None:
                    yield held
                held = part
            at = end
    if held is not None:
        yield held


def signatures(docs: DataFrame) -> DataFrame:
    """Staged (rid, doc_id, th, n, ck, sig) of every row; ck names the shingle set.

    A text without words is a class by itself."""
    schema = f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, n int, ck binary, sig binary"

    def run(batches):
        for batch in batches:
            rids = batch.column(0).to_pylist()
            n, ck, sig = [], [], []
            for rid, value in zip(rids, batch.column(3), strict=True):
                sh = shingles(value.as_py())
                n.append(len(sh))
                ck.append(hashlib.blake2b(sh.tobytes() if len(sh) else b"row %d" % rid, digest_size=16).digest())
                sig.append(signature(sh).tobytes() if len(sh) else b"")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n, pa.int32()), pa.array(ck, pa.binary()), pa.array(sig, pa.binary())],
                names=["rid", "doc_id", "th", "n", "ck", "sig"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text_hash(F.col("text")).alias("th"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return stage(rows.mapInArrow(run, schema), "signatures")


def bands(reps: DataFrame) -> DataFrame:
    """(key, cid): one row a band of each class; the key is the band's four hashes and its number."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
            with np.errstate(over="ignore"):
                k = s.copy().view(np.uint64)[:, :, 0]
                k = _mix(k * _M1 + np.arange(1, BANDS + 1, dtype=np.uint64) * _M2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k.reshape(-1).view(np.int64)),
                 pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["key", "cid"])

    return reps.select("cid", "sig").mapInArrow(run, "key long, cid long")


def in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (key, n, cid, ...) sent to the pairs of blocks (i <= j) of their
    group: columns key, i, j, side, cid, ... (side: 0 in block i, 1 in
    block j of another number), partitioned and sorted by pair."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    own = F.pmod(F.xxhash64("cid", "key"), F.col("blocks")).cast("int")
    cut = rows.withColumn("blocks", blocks).withColumn("own", own)
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = [c for c in rows.columns if c not in ("key", "n", "cid")]
    cut = cut.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     (F.col("own") > F.col("other")).cast("int").alias("side"), "cid", *rest)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "cid")


def candidate_stars(members: DataFrame) -> DataFrame:
    """(a, b) with a > b: spanning stars of the pairs that survive pruning, from (key, n, cid, sig)."""

    def run(batches):
        for key, i, j, side, cid, sig in _groups(batches, 3):
            ids = np.array(cid, np.int64)
            if len(ids) < 2:
                continue
            s = np.frombuffer(b"".join(sig), np.uint16).reshape(len(ids), HASHES)
            if i[0] == j[0]:
                links = surviving(s, s)
            else:
                k = side.count(0)
                links = np.zeros((len(ids), len(ids)), bool)
                links[:k, k:] = surviving(s[:k], s[k:])
                links |= links.T
            np.fill_diagonal(links, False)
            root = stars(links, ids)
            a, b = ids[root != ids], root[root != ids]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return in_blocks(members, SIGNATURE_BLOCK).select("key", "i", "j", "side", "cid", "sig") \
        .mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rows: int) -> DataFrame:
    """(node, root): the smallest node of each connected part, for the nodes of ``edges`` (a, b).

    Large-star and small-star steps in turn, until nothing changes; every
    step is a keyed minimum with map-side combine and a join, written out.
    ``rows``: about how many edges to expect (for the number of files).
    """
    edges = stage(few(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .distinct(), rows), "edges")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("x"), F.col("m").alias("y")),
            F.struct(F.col("a").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.*")
        edges = stage(few(small.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(),
                          seen[0] if seen else rows), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def verified(payload: DataFrame) -> DataFrame:
    """(cid, root, links, doc_links) a row and block pair, from
    (key, n, cid, docs_n, sh): exact links, counted in classes and in documents."""
    up, down = THRESHOLD.numerator, THRESHOLD.denominator

    def run(batches):
        for key, i, j, side, cid, docs_n, sh in _groups(batches, 3):
            first = [k for k in range(len(cid)) if k == 0 or (cid[k], side[k]) != (cid[k - 1], side[k - 1])]
            ids = np.array([cid[k] for k in first], np.int64)
            weight = np.array([docs_n[k] for k in first], np.int64)
            sets = [np.frombuffer(sh[k], np.uint64) for k in first]
            sizes = np.array([len(s) for s in sets], np.int64)
            if i[0] == j[0]:
                rows = cols = slice(None)
            else:
                k = sum(side[x] == 0 for x in first)
                rows, cols = slice(0, k), slice(k, None)
            links = np.zeros((len(ids), len(ids)), bool)
            if sets[rows] and sets[cols]:
                common = common_counts(sets, rows, cols).astype(np.int64)
                both = sizes[rows, None] + sizes[None, cols]
                links[rows, cols] = (up + down) * common >= up * both  # common / (both - common) >= up / down
            links |= links.T
            np.fill_diagonal(links, False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(stars(links, ids)), pa.array(links.sum(axis=1, dtype=np.int64)),
                 pa.array((links * weight).sum(axis=1))], names=["cid", "root", "links", "doc_links"])

    return in_blocks(payload, SHINGLE_BLOCK).select("key", "i", "j", "side", "cid", "docs_n", "sh") \
        .mapInArrow(run, "cid long, root long, links long, doc_links long")


def shingle_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(key, n, cid, docs_n, sh) for the rows that ``needed`` (_id, _th, key, n, cid, docs_n) names."""
    if needed.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    hashed = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"),
                         text_hash(F.col("text")).alias("th"))
    rows = hashed.join(needed, (hashed["th"] == needed["_th"]) & hashed["doc_id"].eqNullSafe(needed["_id"]))

    def run(batches):
        for batch in batches:
            sh = [shingles(v.as_py()).tobytes() for v in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sh, pa.binary())],
                                             names=["key", "n", "cid", "docs_n", "sh"])

    return rows.select("key", "n", "cid", "docs_n", "text") \
        .mapInArrow(run, "key long, n long, cid long, docs_n long, sh binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (needs doc_id, text): doc_id, class_id
    (smallest doc_id of its near-duplicate group), n_links (other documents
    of similarity 0.8 or more, copies included), n_text_links (other
    shingle sets of that similarity), n_copies (other documents of the same
    shingle set), kept (one a group), th.

    Groups are the connected parts of the links.

    Defined cases: a null or empty text, or one without words, links to
    nothing and is a group by itself; a text of fewer than five words has
    one shingle; a null doc_id sorts after every number (class_id is null
    if a group has no other); rows repeated with the same id and text are
    copies of each other, one of them is kept; an empty table gives an
    empty result; extra columns are ignored whatever their names.
    """
    small_batches(docs.sparkSession)
    table = signatures(docs)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("rid").alias("rid"))
    rows = table.count()
    classes = stage(few(table.groupBy("ck").agg(F.min("rid").alias("cid"), F.count(F.lit(1)).alias("docs_n"),
                                            F.min(order).alias("best")), rows), "classes")
    reps = stage(few(table.where("n > 0").join(classes.select("cid"), F.col("rid") == F.col("cid"), "left_semi")
                     .select(F.col("rid").alias("cid"), "sig"), rows), "reps")

    all_bands = bands(reps)
    h = F.xxhash64("cid") % 1_000_000_007
    full = all_bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h"), F.min("cid").alias("lo"),
                                        F.max("cid").alias("hi")).where("n > 1")
    # buckets of the same members (same count, sum of hashes and ends) are kept once
    once = full.groupBy("n", "h", "lo", "hi").agg(F.min("key").alias("key")).select("key", "n")
    members = all_bands.join(once, "key").join(reps, "cid").select("key", "n", "cid", "sig")
    group = components(candidate_stars(members), rows)

    sizes = group.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    needed = group.join(sizes, "root").join(classes, F.col("node") == F.col("cid")) \
        .join(table.select("rid", F.col("doc_id").alias("_id"), F.col("th").alias("_th")), F.col("rid") == F.col("cid")) \
        .select("_id", "_th", F.col("root").alias("key"), "n", "cid", "docs_n")
    found = stage(verified(shingle_sets(docs, stage(few(needed, rows), "needed"))), "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"), F.sum("doc_links").alias("doc_links"))
    parts = components(found.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")),
                       rows).select(F.col("node").alias("cid"), "root")

    named = classes.join(links, "cid", "left").join(parts, "cid", "left") \
        .withColumn("root", F.coalesce("root", "cid"))
    named = stage(few(named, rows), "named")
    best = named.groupBy("root").agg(F.min("best").alias("first"))
    named = named.join(best, "root").select("ck", "docs_n", "links", "doc_links", "first")
    none = F.lit(0).cast("long")
    return few(table.select("rid", "doc_id", "th", "ck").join(named, "ck"), rows).select(
        "doc_id", F.col("first.id").alias("class_id"),
        (F.col("docs_n") - 1 + F.coalesce("doc_links", none)).alias("n_links"),
        F.coalesce("links", none).alias("n_text_links"), (F.col("docs_n") - 1).alias("n_copies"),
        (F.col("rid") == F.col("first.rid")).alias("kept"), "th")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns."""
    return keep_rows(docs, near_duplicates(docs).where("kept").select("doc_id", "th"))
