"""Phrase collocations by counts summed over partitions.

1. Shares: bytes of text by language, one cheap scan.
2. Mining: the corpus is dealt into ``SHARDS`` shards, or more where one
   would not fit a task (``shard_bytes`` of text). Each shard counts all its
   phrases in hash buckets, words and pairs first and then, where the pairs
   may be frequent, longer phrases. What a shard sends is its buckets in
   use, about a byte each, and never the phrases.
3. Union: the counts of a bucket are added up over all shards. Buckets with
   ``support`` or more are one bit each, at most 2^MAX_BITS bits for each of
   the two rounds and the only thing broadcast. A phrase with ``support``
   occurrences in all is in such a bucket, so no phrase is lost. Others may
   share it; they are counted like the rest and fall at step 4.
4. Counting: a last pass counts in every shard each phrase that the buckets
   let through, by its words and not by its hash; the counts are added up per
   (language, phrase) and phrases below ``support`` dropped.
5. Scores, absorbed phrases and ranks are joins on these exact counts.

Shards need not be the same in all passes, so a repeated task changes
nothing. The bound is ``support`` over the whole corpus and not over a shard,
so it doesn't fall with the number of shards.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import small_batches, stage

#: Bytes that end a piece become a full stop, the others stay.
ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b".........")
#: Most buckets of a round: 2^28, as bits 32 MB.
MAX_BITS = 28
#: Shards of the corpus, and the largest text of one: its words are in memory as numbers.
SHARDS, SHARD_BYTES = 16, 48 << 20
#: Text of a language that is split into words at once.
TEXT_BYTES = 4 << 20
#: Languages whose share is known exactly while mining; the others are taken as no smaller than the last of these.
MAX_LANGS = 10_000
#: Buckets of a block, whose sums are made at once: 2^16, so that a place in it has two bytes.
BLOCK_BITS = 16


class Shard:
    """The words of one language in one shard, as numbers; 0 is the end of a piece."""

    def __init__(self):
        self.parts = [pa.DictionaryArray.from_arrays(pa.array([0], pa.int32()), pa.array([b"."]))]
        self.texts, self.bytes = [], 0

    def add(self, text: bytes) -> None:
        self.texts.append(text)
        self.bytes += len(text) + 1
        if self.bytes >= TEXT_BYTES:
            self.split()

    def split(self) -> None:
        """The texts added since the last time, as numbers of their different words."""
        text = b".".join([*self.texts, b""]).lower().translate(ENDS).replace(b".", b" . ")  # bytes: only A-Z lower-cased
        words = pc.ascii_split_whitespace(pa.array([text.strip()], pa.binary()).view(pa.string())).flatten()
        self.parts.append(words.view(pa.binary()).dictionary_encode())
        self.texts, self.bytes = [], 0

    def words(self) -> tuple[np.ndarray, pa.Array]:
        """The numbers, and the words by their number."""
        if self.texts:
            self.split()
        self.parts = pa.chunked_array(self.parts).unify_dictionaries().chunks
        return np.concatenate([part.indices.to_numpy() for part in self.parts]), self.parts[0].dictionary

    def join(self, other: Shard) -> None:
        self.parts += other.parts
        self.texts += other.texts
        self.bytes += other.bytes


def spread(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit hashes mixed, so that any of them can be used alone."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases one word longer."""
    return spread(h * np.uint64(0x9E3779B97F4A7C15) + word)


def seeds(lang: str, vocabulary: pa.Array) -> np.ndarray:
    """Hash of every word, by its number; languages differ."""
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))


class Buckets:
    """Set of 64-bit hashes by their first bits; may hold others by chance, never loses one."""

    def __init__(self, cells, bits: int):
        self.cells, self.bits = cells, bits  # cells: broadcast

    def holds(self, h: np.ndarray) -> np.ndarray:
        p = bucket(h, self.bits)
        return (self.cells.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.uint32)


def followed(w: np.ndarray, base: np.ndarray, held: dict[int, Buckets], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, starts, hashes) of the phrases of 1 to ``most`` words that the
    buckets ``held`` of their length let through; without such all pass. A
    phrase can be frequent only where the two phrases one word shorter are."""
    one = held[1].holds(base) if 1 in held else np.ones(len(base), bool)
    one[0] = False
    at = np.flatnonzero(one[w]).astype(np.int32)
    h = base[w[at]]
    yield 1, at, h
    for m in range(2, most + 1):
        follows = np.zeros(len(w) + 1, bool)  # starts of phrases one word shorter
        follows[at] = True
        ok = follows[at + 1]
        at, h = at[ok], h[ok]
        h = longer(h, base[w[at + m - 1]])
        if m in held:
            ok = held[m].holds(h)
            at, h = at[ok], h[ok]
        yield m, at, h


def packed(buckets: np.ndarray, most: int, counts: np.dtype) -> Iterator[pa.RecordBatch]:
    """How often each of ``buckets`` occurs, at most ``most`` times. A row for
    each block: gaps between its buckets in use as low and high bytes, then
    the counts, compressed."""
    buckets.sort()
    blocks = np.arange(int(buckets[-1] >> BLOCK_BITS) + 2 if len(buckets) else 1) << BLOCK_BITS
    edges, codec, rows = np.searchsorted(buckets, blocks).tolist(), pa.Codec("zstd", 1), []
    for block, (a, b) in enumerate(itertools.pairwise(edges)):
        if a < b:
            part = buckets[a:b]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            gap = np.diff(part[first], prepend=np.uint32(block << BLOCK_BITS))
            n = np.minimum(np.diff(first, append=len(part)), most).astype(counts)
            data = b"".join((gap.astype(np.uint8).tobytes(), (gap >> 8).astype(np.uint8).tobytes(), n.tobytes()))
            rows.append((block, len(gap), codec.compress(data, asbytes=True)))
    for a in range(0, len(rows), 1000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*rows[a:a + 1000], strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["block", "used", "data"])


def unpacked(used: int, data: bytes, counts: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Places in its block of the buckets of a row of ``packed``, and their counts."""
    raw = pa.Codec("zstd").decompress(data, used * (2 + counts.itemsize), asbytes=True)
    low, high = np.frombuffer(raw, np.uint8, 2 * used).reshape(2, used).astype(np.int64)
    return np.cumsum(low | high << 8), np.frombuffer(raw, counts, used, 2 * used)


def mined(shard: Shard, lang: str, held: dict[int, Buckets], lengths: range, bits: int) -> Iterator[np.ndarray]:
    """Buckets of all phrases of ``lengths`` words in the shard, once for each occurrence."""
    w, names = shard.words()
    for m, _, h in followed(w, seeds(lang, names), held, lengths[-1]):
        if m in lengths:
            yield bucket(h, bits)


def counted(shard: Shard, lang: str, held: dict[int, Buckets], most: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(length, phrases, counts) of all phrases that the buckets let through, by
    length; first the number of words, as length 0."""
    w, names = shard.words()
    base = seeds(lang, names)
    yield 0, pa.array([b""], pa.binary()), np.array([np.count_nonzero(w)])
    ids = w.copy()  # number of the phrase that starts here
    for m, at, _ in followed(w, base, held, most):
        key = ids[at].astype(np.int64)
        if m > 1:
            key *= len(base)
            key += w[at + m - 1]
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])[:len(key)]
        del key
        at = at[order]
        del order
        ids[at] = np.cumsum(new, dtype=np.int32) - 1
        first = np.flatnonzero(new)
        n, at = np.diff(first, append=len(at)), at[first]
        for a in range(0, len(at), 20_000):
            words = [names.take(pa.array(w[at[a:a + 20_000] + i])) for i in range(m)]
            yield m, pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary())), n[a:a + 20_000]


def shards(batches, limit: int) -> Iterator[dict[str, Shard]]:
    """The texts of a task by language, ``limit`` bytes of text at a time. A
    small rest joins the shard before it, since every shard sends its own counts."""
    whole, held, size = None, {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            shard = held.get(lang)
            if shard is None:
                shard = held[lang] = Shard()
            shard.add(text)
            size += len(text) + 1
            if size >= limit:
                if whole:
                    yield whole
                whole, held, size = held, {}, 0
    if whole and 2 * size < limit:
        for lang, shard in held.items():
            if lang in whole:
                whole[lang].join(shard)
            else:
                whole[lang] = shard
        held = {}
    for some in (whole, held):
        if some:
            yield some


def union_filter(sent: DataFrame, bits: int, support: int, counts: np.dtype) -> Buckets:
    """The buckets that reach ``support`` over all rows of ``packed``."""
    size = min(bits, BLOCK_BITS)

    def add(rows: pa.Table) -> pa.Table:
        sums = np.zeros(1 << size, np.int64)
        for used, data in zip(rows.column("used").to_pylist(), rows.column("data").to_pylist(), strict=True):
            place, n = unpacked(used, data, counts)
            sums[place] += n
        cells = np.packbits(sums >= support, bitorder="little").tobytes()
        return pa.table([rows.column("block")[:1].cast(pa.int32()), pa.array([cells], pa.binary())], names=["block", "cells"])

    cells = np.zeros((1 << bits - size, 1 << size - 3), np.uint8)
    for block in sent.groupBy("block").applyInArrow(add, "block int, cells binary").toArrow().to_batches():
        for i, part in zip(block.column(0).to_pylist(), block.column(1), strict=True):
            cells[i] = np.frombuffer(part.as_buffer(), np.uint8)
    return Buckets(sent.sparkSession.sparkContext.broadcast(cells.reshape(-1)), bits)


def phrase_counts(docs: DataFrame, support: int = 100, most: int = 5, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, m, phrase, f): exact counts of every phrase of m = 1 to ``most``
    words with at least ``support`` occurrences in its language, and under
    m = 0 the number of words of each language. Staged."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    shares = stage(rows.groupBy("lang").agg(F.sum(F.octet_length("text") + F.lit(1).cast("long")).alias("bytes")),
                   "shares")
    total = shares.agg(F.sum("bytes")).first()[0] or 0
    largest = {r["lang"]: r["bytes"] for r in shares.orderBy(F.desc("bytes"), "lang").limit(MAX_LANGS).collect()}
    # a language beyond the list is no larger than the last on it
    rest = min(largest.values(), default=1)
    limit = max(1, min(shard_bytes, -(-total // SHARDS)))
    # tasks of about a shard, so that many small files are not many small shards
    rows = rows.coalesce(max(1, -(-total // limit)))
    least = max(1, int(support))
    # some ten buckets for each phrase that could be frequent
    bits, counts = min(MAX_BITS, max(10, int(2 * total // least).bit_length())), np.min_scalar_type(least)

    def mine(batches, held, lengths):
        for some in shards(batches, limit):
            found = [np.zeros(0, np.uint32)]
            while some:
                lang, shard = some.popitem()
                if largest.get(lang, rest) >= 2 * least:  # a word and its end are two bytes
                    found += mined(shard, lang, held, lengths, bits)
            lang = shard = None
            found = np.concatenate(found)
            yield from packed(found, least, counts)

    held: dict[int, Buckets] = {}
    for lengths in (range(1, min(most, 2) + 1), range(3, most + 1)):
        if lengths:
            found = rows.mapInArrow(lambda b, held=dict(held), lengths=lengths: mine(b, held, lengths),
                                    "block int, used int, data binary")
            held |= dict.fromkeys(lengths, union_filter(found, bits, least, counts))

    def count(batches):
        for some in shards(batches, limit):
            while some:
                lang, shard = some.popitem()
                for m, phrases, n in counted(shard, lang, held, most):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), m, np.int32)),
                         phrases.cast(pa.string()), pa.array(n.astype(np.int64))], names=["lang", "m", "phrase", "n"])

    sums = rows.mapInArrow(count, "lang string, m int, phrase string, n long") \
        .groupBy("lang", "m", "phrase").agg(F.sum("n").alias("f"))
    return stage(sums.where(f"m = 0 OR f >= {int(support)}"), "phrases")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, m, a, l, r, n, score) of every phrase of two words or
    more, by its lowest-scoring cut. Whole-number arithmetic of 38 digits."""
    parts = """flatten(transform(sequence(1, m - 1), k -> array(
        struct(k AS k, true AS first, array_join(slice(w, 1, k), ' ') AS part),
        struct(k AS k, false AS first, array_join(slice(w, k + 1, m - k), ' ') AS part))))"""
    cuts = counts.where("m > 1").withColumn("w", F.split("phrase", " ")) \
        .selectExpr("lang", "phrase", "m", "f AS a", f"inline({parts})")
    part = counts.where("m > 0").select(F.col("lang").alias("p_lang"), F.col("phrase").alias("p"), F.col("f").alias("p_f"))
    words = counts.where("m = 0").select(F.col("lang").alias("n_lang"), F.col("f").alias("n"))
    found = cuts.join(part, (cuts["lang"] == part["p_lang"]) & (cuts["part"] == part["p"])) \
        .groupBy("lang", "phrase", "m", "a", "k").agg(F.max(F.when(F.col("first"), F.col("p_f"))).alias("l"),
                                                      F.max(F.when(~F.col("first"), F.col("p_f"))).alias("r")) \
        .join(words, F.col("lang") == F.col("n_lang"))
    score = """(cast(1000 AS decimal(4)) * cast(a AS decimal(15)) * cast(n AS decimal(18)))
               div (cast(l AS decimal(18)) * cast(r AS decimal(18)))"""
    return found.groupBy("lang", "phrase", "m", "a", "n") \
        .agg(F.min(F.struct(F.expr(score).alias("score"), "k", "l", "r")).alias("c")) \
        .select("lang", "phrase", "m", "a", "c.l", "c.r", "n", "c.score")


def absorbed(counts: DataFrame, percent: int) -> DataFrame:
    """(a_lang, a_phrase, longest_f): phrases inside longer candidates, with
    the largest count of such a candidate."""
    inside = """flatten(transform(sequence(2, m - 1), k -> transform(sequence(1, m - k + 1),
        i -> array_join(slice(w, i, k), ' '))))"""
    return counts.where("m > 2").withColumn("w", F.split("phrase", " ")) \
        .select(F.col("lang").alias("a_lang"), F.explode(F.array_distinct(F.expr(inside))).alias("a_phrase"), "f") \
        .groupBy("a_lang", "a_phrase").agg(F.max("f").alias("longest_f"))


def collocations(docs: DataFrame, support: int = 100, most: int = 5, per_lang: int = 2000, percent: int = 100,
                 shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The first ``per_lang`` phrases of every language by score: lang, rank,
    phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z only), split into pieces at ``.,;:!?`` and
    line ends, and those into words at spaces and tabs. A candidate is a
    phrase of 2 to ``most`` words with a >= ``support`` occurrences within
    pieces of its language; of its cuts into two parts with l and r
    occurrences the lowest floor(1000 a n / (l r)) is its score, n being
    the words of the language. Candidates inside a longer candidate with at
    least ``percent`` per cent of their occurrences are dropped.

    Defined cases: a null text counts as empty and a null lang as ``und``
    (together with that value); a text without words adds nothing, but its
    language exists; ties go to the smaller cut, then to more occurrences
    and the phrase first in UTF-8 byte order; rows repeated with the same id
    count each time; a table without candidates gives an empty result; ids
    and extra columns are ignored whatever their names.
    """
    counts = phrase_counts(docs, support, most, shard_bytes)
    rows = scored(counts)
    gone = absorbed(counts, percent)
    kept = rows.join(gone, (rows["lang"] == gone["a_lang"]) & (rows["phrase"] == gone["a_phrase"]), "left") \
        .where(f"longest_f IS NULL OR 100 * longest_f < {int(percent)} * a")
    # a language may hold most candidates: first ranked in 64 parts, of which each keeps per_lang rows at most
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    near = kept.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(f"rank <= {int(per_lang)}")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(f"rank <= {int(per_lang)}").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
