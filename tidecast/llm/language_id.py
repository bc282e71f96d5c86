"""Language ID with language-bitmask n-gram filters.

The filter is a bit-sliced Bloom filter: one array of cells, each cell a
mask with one bit a language. An n-gram hashes to ``HASHES`` cells; the AND
of their masks has a bit for every language whose filter holds the n-gram,
so one look-up answers for all languages together. More than 64 languages
take several masks a cell (planes).

Learning: n-grams of words (with their borders) are counted in Spark by
(n-gram, language) over the training rows. An n-gram enters the filter of
every language whose rate of it is at least ``share`` times the largest
rate among the languages, so common chance n-grams don't blur the
languages; the rates weigh languages alike, however many rows they have.

Prediction: of a text's n-grams, each language's popcount is corrected for
the filter's false positives, (hits / n - fp) / (1 - fp) with fp the
language's fill to the power of ``HASHES``. The largest corrected share is
the language. Equal shares (very short texts) go to the language of most
training documents, then by name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import small_batches

HASHES = 2
#: log2 of the cells of the smallest filter.
LEAST_BITS = 21
#: Orders of the n-grams; a word's borders count as characters.
ORDERS = (2, 3, 4, 5)
LETTER = regex.compile(r"\p{L}")
WORD = regex.compile(r"[\p{L}\p{M}']+")
#: Long texts are looked at in slices of words of so many code points.
SLICE = 1 << 18
_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def ngram_hashes(text: str):
    """64-bit hashes of the n-grams of ``text``, an array for each slice.

    Words are runs of letters in lower case, joined by single spaces; an
    n-gram may start or end at a space but doesn't span one.
    """
    words = WORD.findall(text.lower())
    at = 0
    while at < len(words):
        size, end = 1, at
        while end < len(words) and (size < SLICE or end == at):
            size += len(words[end]) + 1
            end += 1
        joined = " " + " ".join(words[at:end]) + " "
        at = end
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
        space = codes == 32
        out = []
        with np.errstate(over="ignore"):
            h = codes + np.uint64(1)
            inner = np.zeros(len(codes), np.int64)  # spaces strictly inside the n-gram
            for n in range(2, max(ORDERS) + 1):
                if len(codes) < n:
                    break
                h = h[:-1] * np.uint64(_MULT[0]) + codes[n - 1:] + np.uint64(n)
                inner = inner[:-1] + (space[n - 2:-1] if n > 2 else 0)
                if n in ORDERS:
                    x = h[inner == 0]
                    x = (x ^ (x >> np.uint64(31))) * np.uint64(_MULT[1])
                    out.append(x ^ (x >> np.uint64(29)))
        if out:
            yield np.concatenate(out)


def cells_of(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The ``HASHES`` cells of each n-gram in an array of 2**bits cells."""
    with np.errstate(over="ignore"):
        return [((hashes * np.uint64(_MULT[k % 3] + 2 * k)) >> np.uint64(64 - bits)).astype(np.int64)
                for k in range(HASHES)]


def training_counts(train: DataFrame) -> DataFrame:
    """(lang, h, n): how often each n-gram occurs, summed in Spark from per-batch counts."""

    def run(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(langs, texts, strict=True):
                by.setdefault(lang, []).extend(ngram_hashes(text or ""))
            for lang, parts in by.items():
                if parts:
                    h, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(h), pa.string()), pa.array(h.astype(np.int64)),
                         pa.array(n.astype(np.int64))], names=["lang", "h", "n"])

    return train.select("lang", "text").mapInArrow(run, "lang string, h long, n long") \
        .groupBy("lang", "h").agg(F.sum("n").alias("n"))


def sample(train: DataFrame, rows: dict[str, int], per_lang: int) -> DataFrame:
    """About ``per_lang`` of a language's ``rows`` training rows (all, if fewer).

    A row is taken when its hash of id and text lies in the share
    per_lang / rows of the hash range, so no row is ranked or moved.
    """
    span = 1 << 63
    key, take = F.xxhash64("doc_id", "text"), F.lit(False)
    for lang, n in rows.items():
        bound = min(span - 1, -span + 2 * span * per_lang // n)
        take = F.when(F.col("lang") == lang, key <= bound).otherwise(take)
    return train.where(take).select("lang", "text")


class MaskFilter:
    """masks[plane][cell]: the bit-sliced filter; ``langs`` in bit order."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], prior: list[int], bits: int):
        self.langs, self.bits = langs, bits
        planes = math.ceil(len(langs) / 64) or 1
        # the narrowest mask that has a bit a language
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64)
                    if k == np.uint64 or len(langs) <= 8 * np.dtype(k).itemsize)
        self.masks = [np.zeros(1 << bits, kind) for _ in range(planes)]
        for i, h in enumerate(grams):
            for cell in cells_of(h, bits):
                self.masks[i // 64][cell] |= kind(1 << (i % 64))
        fill = [float((self.masks[i // 64] & kind(1 << (i % 64)) != 0).mean()) for i in range(len(langs))]
        self.fp = np.array([f ** HASHES for f in fill])
        # equal shares: most training documents first, then by name
        self.order = sorted(range(len(langs)), key=lambda i: (-prior[i], langs[i]))

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        cells = cells_of(hashes, self.bits)
        out = np.zeros(len(self.langs), np.int64)
        for p, masks in enumerate(self.masks):
            found = masks[cells[0]]
            for c in cells[1:]:
                found = found & masks[c]
            here = range(64 * p, min(64 * (p + 1), len(self.langs)))
            if len(here) <= 8:
                seen = np.bincount(found.astype(np.int64), minlength=1 << len(here))
                for i in here:
                    out[i] = seen[(np.arange(len(seen)) >> (i % 64)) & 1 == 1].sum()
            else:
                for i in here:
                    out[i] = int(np.count_nonzero(found & masks.dtype.type(1 << (i % 64))))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not LETTER.search(text):
            return "und", 0.0
        n, hits = 0, np.zeros(len(self.langs), np.int64)
        for h in ngram_hashes(text):
            n += len(h)
            hits += self.hits(h)
        if not n:
            return self.langs[self.order[0]], 0.0
        share = np.clip((hits / n - self.fp) / np.maximum(1 - self.fp, 1e-9), 0.0, 1.0)
        best = max(self.order, key=lambda i: share[i])
        return self.langs[best], float(share[best])


def filter_bits(largest: int) -> int:
    """Cells of the filter as a power of two: sixteen for each n-gram of the
    largest language, so that a false positive has a chance of about 0.014."""
    return max(LEAST_BITS, (16 * largest - 1).bit_length() if largest else 0)


def learn(train: DataFrame, per_lang: int = 2000, share: float = 0.4, least: int = 2,
          bits: int | None = None) -> MaskFilter:
    """The filter learned from ``train`` (lang, text; rows of null lang are left out).

    About ``per_lang`` documents a language are learned from, the
    documented bound; so the n-gram counts that reach the driver are
    bounded too (an n-gram must occur ``least`` times). ``bits``: log2 of
    the filter's cells, by default from the n-grams learned.
    """
    small_batches(train.sparkSession)
    train = train.where(F.col("lang").isNotNull())
    prior = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(prior)
    counts = training_counts(sample(train, prior, per_lang)).cache()
    total = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    rate = F.col("n") / F.create_map(*[x for k, v in total.items() for x in (F.lit(k), F.lit(float(v)))])[
        F.col("lang")] if total else F.lit(0.0)
    rated = counts.withColumn("rate", rate)
    top = rated.groupBy("h").agg(F.max("rate").alias("top"))
    kept = rated.where(F.col("n") >= least).join(top, "h").where(F.col("rate") >= share * F.col("top")) \
        .select("lang", "h").toPandas()
    counts.unpersist()
    grams = [kept.loc[kept["lang"] == lang, "h"].to_numpy(np.int64).view(np.uint64) for lang in langs]
    if bits is None:
        bits = filter_bits(max(map(len, grams), default=0))
    return MaskFilter(langs, grams, [prior[x] for x in langs], bits)


def held_out():
    """Is a document kept from learning? crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def detect(docs: DataFrame, model: MaskFilter, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` plus lang_pred and score, from the text alone."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in keep]
                          + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        m = shared.value
        for batch in batches:
            said = [m.predict(v.as_py()) for v in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array([s[0] for s in said], pa.string()),
                 pa.array([s[1] for s in said], pa.float64())], names=[f.name for f in schema])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text")).mapInArrow(run, schema)


def language_id(docs: DataFrame, per_lang: int = 2000) -> DataFrame:
    """One row per row of ``docs`` (needs doc_id, text, lang): doc_id,
    held_out, lang_pred, score.

    Learns from text and lang of the rows that are not held out.

    Defined cases: a null text, or one without a letter, is ``und`` with
    score 0; a null lang is not learned from; a null doc_id is not held
    out; repeated rows each get their row, the same prediction; if nothing
    can be learned (an empty table, no lang) all is ``und``; extra columns
    are ignored whatever their names.
    """
    model = learn(docs.where(~held_out()).select("doc_id", "text", "lang"), per_lang)
    said = detect(docs, model, ["doc_id"])
    return said.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def drop_unknown(docs: DataFrame, least_score: float = 0.3, per_lang: int = 2000) -> DataFrame:
    """``docs`` without the rows that no learned language explains: ``und``,
    or a corrected n-gram share under ``least_score``. All columns stay."""
    model = learn(docs.where(~held_out()).select("doc_id", "text", "lang"), per_lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.BooleanType())
    def known(texts: pd.Series) -> pd.Series:
        said = [shared.value.predict(t) for t in texts]
        return pd.Series([lang != "und" and score >= least_score for lang, score in said], dtype=bool)

    return docs.where(known(F.col("text")))
