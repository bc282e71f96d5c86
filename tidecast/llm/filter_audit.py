"""Filter interaction audit by the Hart-Mas-Colell potential.

1. One pass over the texts gives a narrow row a document: part, bit mask
   of the failed row filters, SHA-256 of the text. Only this pass is Python
   (Arrow batches); the rest is DataFrame functions.
2. The duplicate filter needs the smallest id of each text. Rows are added
   up map-side by (text, part, mask, labels) with their smallest id, so a
   text that a third of all rows share is a handful of rows afterwards.
3. What is left are cells (part, mask, rows, good rows, toxic rows): at
   most 2^k a part for k filters.
4. Removal game of a part: v(S) is the number of documents that fail some
   filter of coalition S. The potential is built up over the 2^k
   coalitions, P(S) = (v(S) + sum of P(S without i)) / |S|, and a filter's
   Shapley value is P(all) - P(all without it). Times lcm(1..k) the
   potential is a whole number, so the arithmetic is exact.
5. Every step of every order is a difference of two coalitions.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import small_batches

#: Row filters: letter -> condition under which a document fails, over the columns of ``measures``.
ROW_FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_upper > 3 * n_chars",
    "D": "n_symbols > 0",
}
#: Letter of the filter that drops a text which a smaller doc_id has.
DUPLICATES = "E"

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"
MEASURES = "doc_id long, part string, digest binary, n_chars long, n_words long, n_distinct long, n_upper long, " \
           "n_symbols long"


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, n_chars, n_words, n_distinct, n_upper, n_symbols) of every whole text.

    Words are what white space (space, tab to carriage return) separates,
    case-sensitive; the digest is the text's SHA-256. Python because word
    lists of whole texts cost several times as much in SQL functions.
    """
    small_batches(docs.sparkSession)

    def measured(batches):
        for batch in batches:
            found = []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                words = text.split()  # of bytes: exactly the six white-space characters
                found.append((hashlib.sha256(text).digest(), len(words), len(set(words)),
                              len(text) - len(text.translate(None, UPPER)),
                              len(text) - len(text.translate(None, SYMBOLS))))
            digest, *counts = zip(*found, strict=True) if found else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digest, pa.binary()),
                 pc.utf8_length(batch.column(2)).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts)],
                names=[f.split()[0] for f in MEASURES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang"), F.lit("")),
                       F.coalesce(F.col("text"), F.lit(""))).mapInArrow(measured, MEASURES)


def failures(docs: DataFrame, filters: dict) -> DataFrame:
    """(doc_id, part, mask, digest): bit i of ``mask`` is set if the i-th filter fails."""
    mask = " | ".join(f"IF({fails}, {1 << i}, 0)" for i, fails in enumerate(filters.values()))
    return measures(docs).select("doc_id", "part", F.expr(mask).alias("mask"), "digest")


def label_flags(labels: DataFrame) -> DataFrame:
    """(label_id, good, toxic), one row an id; of repeated labels any 1 counts."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")) \
        .agg(one("quality").alias("good"), one("toxic").alias("toxic"))


def cells(docs: DataFrame, labels: DataFrame, filters: dict) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents by the set of filters they
    fail; the highest bit is the duplicate filter."""
    rows = failures(docs, filters).groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    # rows without an id have no label: a salt of their own spreads them over the join's tasks
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0))
    flags = label_flags(labels).withColumn("label_salt", F.lit(0).cast("long"))
    known = rows.withColumn("salt", salt)
    known = known.join(flags, (known["doc_id"] == flags["label_id"]) & (known["salt"] == flags["label_salt"]), "left")
    good, toxic = (F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic"))
    by_text = known.select("digest", "part", "mask", good.alias("good"), toxic.alias("toxic"), "n", "doc_id") \
        .groupBy("digest", "part", "mask", "good", "toxic").agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_no_id"),
            F.min("doc_id").alias("first_id"), F.min_by("n", "doc_id").alias("n_first"))
    smallest = F.min("first_id").over(Window.partitionBy("digest"))
    split = by_text.withColumn("smallest", smallest).withColumn(
        "first_n", F.col("n_no_id") + F.when(F.col("first_id") == F.col("smallest"), F.col("n_first")).otherwise(0))
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("first_n").alias("n")),
                   F.struct(F.col("mask").bitwiseOR(1 << len(filters)).alias("mask"),
                            (F.col("n") - F.col("first_n")).alias("n")))
    return split.select("part", "good", "toxic", F.explode(both).alias("c")) \
        .groupBy("part", F.col("c.mask").alias("mask")).agg(
            F.sum("c.n").alias("n"), F.sum(F.when(F.col("good"), F.col("c.n")).otherwise(0)).alias("n_good"),
            F.sum(F.when(F.col("toxic"), F.col("c.n")).otherwise(0)).alias("n_toxic"))


def games(table: DataFrame, k: int) -> DataFrame:
    """One row a part: ``total``, the coalition values ``v``, ``v_good`` and
    ``v_toxic`` (index: bit mask of the coalition) and the potential of
    ``v`` times lcm(1..k), ``potential``."""
    full, scale = (1 << k) - 1, math.lcm(*range(1, k + 1))
    bits = "array(" + ",".join(str(1 << i) for i in range(k)) + ")"
    value = "transform(sequence(0, {full}), s -> aggregate(c, 0L, (a, x) -> a + IF((x.mask & s) != 0, x.{n}, 0L)))"
    return table.groupBy("part").agg(F.sum("n").alias("total"),
                                     F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("c")) \
        .selectExpr("part", "total", *(f"{value.format(full=full, n=n)} AS {v}" for n, v in (
            ("n", "v"), ("n_good", "v_good"), ("n_toxic", "v_toxic")))) \
        .selectExpr("*", f"""aggregate(sequence(1, {full}), array(0L), (p, s) -> concat(p, array(
            ({scale}L * v[s] + aggregate({bits}, 0L, (a, b) -> a + IF((s & b) != 0, p[s ^ b], 0L)))
            div bit_count(s)))) AS potential""")


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict | None = None,
                 duplicates: str = DUPLICATES) -> DataFrame:
    """One row per part (value of lang, null as empty), order of the filters
    and step: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    ``docs`` needs doc_id, text, lang; ``labels`` doc_id, quality, toxic.
    ``filters`` maps letters to SQL conditions over ``measures``; the
    duplicate filter follows them. k filters give k! orders, so k stays
    small. ``shapley`` is the sum of what the filter removes over all
    orders, k! times its Shapley value.

    Defined cases: a null text counts as empty; an empty text has no words
    and fails ``A`` alone (unless it is a duplicate); a row without doc_id
    has no label, is no duplicate and makes none; rows repeated with the
    smallest id of their text all pass ``E``; of repeated labels any
    quality or toxic of 1 counts, null counts as 0, and labels without a
    document are ignored; an empty table gives an empty result; extra
    columns are ignored whatever their names.
    """
    filters = ROW_FILTERS if filters is None else filters
    letters = "".join(filters) + duplicates
    k = len(letters)
    full = (1 << k) - 1
    orders = ",".join("".join(p) for p in itertools.permutations(letters))
    bit = "shiftleft(1, instr('{letters}', substring(filter_order, {j}, 1)) - 1)"
    steps = games(cells(docs, labels, filters), k) \
        .withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))) \
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k)))) \
        .selectExpr("*", f"{bit.format(letters=letters, j='step')} AS own",
                    f"aggregate(sequence(1, step), 0, (m, j) -> m | {bit.format(letters=letters, j='j')}) AS after") \
        .selectExpr("*", "after ^ own AS before")
    return steps.selectExpr(
        "part", "filter_order", "step", "total - v[after] AS kept", "v[after] - v[before] AS removed",
        "v[own] - (v[after] - v[before]) AS redundant", f"v[{full}] - v[{full} ^ own] AS unique_fails",
        "v_good[after] - v_good[before] AS good_lost", "v_toxic[after] - v_toxic[before] AS toxic_lost",
        f"{math.factorial(k) // math.lcm(*range(1, k + 1))}L * (potential[{full}] - potential[{full} ^ own]) AS shapley")
