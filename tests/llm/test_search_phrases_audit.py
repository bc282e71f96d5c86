"""op11 to op13: plain-Python versions on small tables, edge cases, bounds that never decide."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.frames import CLASH, SCHEMA, edge_rows, frame
from tidecast.llm import collocations, filter_audit, pivot_search

VECTORS = "vec_id LONG, embedding ARRAY<DOUBLE>, label INT"
LABELS = "doc_id LONG, quality INT, toxic INT"


# ---------------------------------------------------------------- op11

def nearest(rows, every, k):
    """(query_id, rank, vec_id, score) by comparing all pairs; rows are told apart by position."""
    fine = []
    for i, (vec_id, x, *_) in enumerate(rows):
        if x is not None and all(c is not None and math.isfinite(c) and abs(c) < 2 ** 23 for c in x):
            fine.append((i, vec_id, [math.floor(256 * c) for c in x]))
    out = []
    for i, q_id, q in fine:
        if q_id is None or q_id % every:
            continue
        scores = [(-sum(a * b for a, b in zip(q, v)), c_id is None, c_id or 0, c_id)
                  for j, c_id, v in fine if j != i and len(v) == len(q)]
        for rank, (score, _, _, c_id) in enumerate(sorted(scores)[:k], 1):
            out.append((q_id, rank, c_id, -score))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def edge_vectors():
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)], 0) for i in range(60)]
    rows += [(i, [1.0, 0.5, -0.25, 0.0, 2.0], 1) for i in range(60, 90)]           # one vector many times: ties
    rows += [(i, [rng.gauss(5, .1) for _ in range(3)], 2) for i in range(90, 100)]  # another length
    return rows + [
        (100, None, 0), (101, [], 0), (110, [], 0), (102, [1.0, None, 0.0, 0.0, 0.0], 0),
        (120, [float("nan")] * 5, 0), (130, [float("inf"), 0.0, 0.0, 0.0, 0.0], 0), (140, [1e30] * 5, 0),
        (None, [1.0, 0.5, -0.25, 0.0, 2.0], None), (-10, [-1.0] * 5, 0), (150, [0.0] * 5, 0),
        (160, [0.1] * 7, 0),                                                         # no other row of its length
        (20, [2.0, 2.0, 2.0, 2.0, 2.0], 0), (200, [1e6] * 5, 0)]                     # repeated id; long vector


@pytest.mark.parametrize("block, sample, pivots", [(4096, 4096, 16), (7, 4, 2), (16, 40, 0)])
def test_top_k_all_pairs(spark, block, sample, pivots):
    """Sample, pivots and blocks change what is evaluated, never the result."""
    rows = edge_vectors()
    got = found(pivot_search.top_k(spark.createDataFrame(rows, VECTORS), every=10, block=block, sample=sample, pivots=pivots))
    assert got == nearest(rows, 10, 5)


def test_top_k_parts_and_summaries(spark, monkeypatch):
    """Several parts of queries and several groups of summaries."""
    monkeypatch.setattr(pivot_search, "QUERY_PART", 3)
    monkeypatch.setattr(pivot_search, "SUMMARIES", 2)
    rows = edge_vectors()
    assert found(pivot_search.top_k(spark.createDataFrame(rows, VECTORS), every=10, k=3, block=9)) == nearest(rows, 10, 3)


def test_top_k_bounds_hold_and_drop_far_blocks():
    rng = np.random.default_rng(0)
    v = np.floor(256 * rng.normal(size=(400, 8)) + 2000 * rng.integers(0, 2, (400, 1))).astype(np.int64)
    ref = pivot_search.Reference(np.arange(50), v[:50], 6)
    d = ref.distances(v)
    n2 = (v ** 2).sum(1)
    for i in range(20):
        possible = pivot_search.bounds(float(n2[i]), n2.astype(float), pivot_search.apart(8, d[i], d, d))
        assert (possible >= v @ v[i]).all()
    floors = ref.floors(v[:20], np.arange(20), 5)
    for i in range(20):
        scores = np.delete(v @ v[i], i)
        assert floors[i] <= np.sort(scores)[-5]
        assert floors[i] == np.sort(np.delete(v[:50] @ v[i], i))[-5]


def test_top_k_empty_and_clashing(spark):
    assert pivot_search.top_k(spark.createDataFrame([], VECTORS)).collect() == []
    assert pivot_search.top_k(spark.createDataFrame([(None, None, None)] * 3, VECTORS)).collect() == []
    rows = edge_vectors()[:70]
    df = spark.createDataFrame(rows, VECTORS)
    for c in ("rid", "v", "n2", "dim", "score", "rank", "part", "block", "query_id", "x"):
        df = df.selectExpr("*", f"cast(null as string) as {c}")
    assert found(pivot_search.top_k(df, every=10)) == nearest(rows, 10, 5)


# ---------------------------------------------------------------- op12

def phrases(rows, support, most=5, per_lang=2000, percent=100):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, most + 1):
                f.update((lang, tuple(w[i:i + m])) for i in range(len(w) - m + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= support}
    out = []
    for (lang, w), a in cand.items():
        if any(lang == other[0] and len(other[1]) > len(w) and 100 * b >= percent * a
               and any(other[1][i:i + len(w)] == w for i in range(len(other[1]))) for other, b in cand.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    table = []
    for lang, group in itertools.groupby(sorted(out), key=lambda r: r[0]):
        for rank, (_, s, a, w, le, r, total) in enumerate(itertools.islice(group, per_lang), 1):
            table.append((lang, rank, w.decode(), -a, le, r, total, -s))
    return sorted(table)


def mined(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def prose(seed, rows):
    rng = random.Random(seed)
    words = ["New", "york", "the", "of", "été", "cat", " ", "don't", "a b", "中文", "x" * 300]
    ends = [" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "!", "\x0b", " "]
    out = []
    for i in range(rows):
        text = "".join(rng.choice(words[:4 + i % 8]) + rng.choice(ends) for _ in range(rng.randint(0, 60)))
        out.append((i, text + rng.choice(["", "new york city council", "NEW York City"]), rng.choice(["en", "en", "fr", None]), "s", 0))
    return out


@pytest.mark.parametrize("support, shard_bytes, most, percent", [(5, 1 << 20, 5, 100), (5, 700, 5, 100), (1, 2000, 3, 100),
                                                                 (4, 4000, 4, 60)])
def test_phrases_by_counting_everything(spark, support, shard_bytes, most, percent):
    rows = prose(support, 150) + edge_rows()
    df = frame(spark, rows, clash=True).repartition(7)
    got = mined(collocations.collocations(df, support=support, shard_bytes=shard_bytes, most=most, percent=percent, per_lang=50))
    want = phrases([(r[1], r[2]) for r in rows], support, most, 50, percent)
    assert got == want and len(want) > 20


def test_phrases_without_a_crossing(spark):
    rows = [(i, "a b. c d", "en", "s", 0) for i in range(6)] + [(9, None, "en", "s", 0)]
    got = mined(collocations.collocations(frame(spark, rows), support=6))
    assert [(r[2], r[3]) for r in got] == [("a b", 6), ("c d", 6)]


def test_phrases_products_beyond_64_bits(spark):
    n = 4 * 10 ** 13
    counts = spark.createDataFrame(
        [("en", 0, "", n), ("en", 1, "a", 3 * 10 ** 12), ("en", 1, "b", 2 * 10 ** 12), ("en", 2, "a b", 10 ** 12 + 7)],
        "lang STRING, m INT, phrase STRING, f LONG")
    row = collocations.scored(counts).collect()[0]
    assert row["score"] == 1000 * (10 ** 12 + 7) * n // (6 * 10 ** 24)


def test_phrase_filter_full_and_languages_beyond_the_list(spark, monkeypatch):
    """A filter with far too few bits and an incomplete list of languages change nothing."""
    monkeypatch.setattr(collocations, "MAX_BITS", 7)
    monkeypatch.setattr(collocations, "MAX_LANGS", 1)
    rows = prose(2, 120)
    got = mined(collocations.collocations(frame(spark, rows).repartition(5), support=6, shard_bytes=900))
    assert got == phrases([(r[1], r[2]) for r in rows], 6)


def test_phrases_of_more_shards_than_support(spark, monkeypatch):
    """A bound of less than one occurrence a shard doesn't let all phrases through."""
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(60)) + rng.choice([". new york city", ""]), "en", "s", 0)
            for i in range(200)]
    df, sent = frame(spark, rows).repartition(4), []
    real = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: sent.append(real(self, *a, **k)) or sent[-1])
    got = mined(collocations.collocations(df, support=20, shard_bytes=600))  # some 80 shards
    assert got == phrases([(r[1], r[2]) for r in rows], 20) and "new york city" in {r[2] for r in got}
    occurrences = sum(60 - m + 1 for m in range(2, 6)) * len(rows)
    assert sent[-1].where("m > 1").agg({"n": "sum"}).first()[0] < occurrences / 5


@pytest.mark.parametrize("most", [100, 70_000])
def test_phrase_buckets_packed(most):
    rng = np.random.default_rng(0)
    buckets = np.concatenate([rng.integers(0, 1 << 20, 5000), rng.integers(0, 300, 100_000), [0, 65_535, 65_536, (1 << 28) - 1],
                              np.full(80_000, 65_536)]).astype(np.uint32)
    want, counts, got = Counter(buckets.tolist()), np.min_scalar_type(most), {}
    for row in (row for batch in collocations.packed(buckets, most, counts) for row in batch.to_pylist()):
        place, n = collocations.unpacked(row["used"], row["data"], counts)
        got |= zip(((row["block"] << 16) + place).tolist(), n.tolist(), strict=True)
    assert got == {b: min(n, most) for b, n in want.items()}


def test_phrases_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None,) * 5] * 3, SCHEMA), support=1).collect() == []


# ---------------------------------------------------------------- op13

def audit(docs, labels):
    """By applying every order to the rows one after another."""
    texts = [(i, "" if t is None else t, "" if lang is None else lang) for i, t, lang, *_ in docs]
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    rows = []
    for i, t, lang in texts:
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and any(j is not None and j < i and u == t for j, u, _ in texts)}
        rows.append((lang, fails, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if r[1][x]]
                left = [r for r in left if not r[1][x]]
                total[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(r[1][x] for r in mine) - len(gone),
                    sum(r[1][x] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def audited(df):
    cols = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in cols] for r in df.collect()}


def audit_rows():
    rng = random.Random(1)
    docs = list(edge_rows())
    for i in range(20, 90):
        words = [rng.choice(["alpha", "Beta", "gamma", "DELTA", "#", "x"]) + str(rng.randint(0, rng.choice([2, 400])))
                 for _ in range(rng.choice([3, 199, 200, 260]))]
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(words), rng.choice(["en", "fr", None, ""]), "s", 0))
    docs += [(200 - i, docs[rng.randrange(13, 60)][1], rng.choice(["en", "fr"]), "s", 0) for i in range(30)]
    docs += [docs[20], (None, docs[21][1], "en", "s", 0)]  # a repeated row; a copy without id
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 210, 2)]
    return docs, labels + [(4, 1, 0), (4, 0, 1), (9999, 1, 1), (None, 1, 1)]


def test_audit_by_applying_every_order(spark):
    docs, labels = audit_rows()
    table = spark.createDataFrame(labels, LABELS).selectExpr("*", "'x' as part", "1 as n", "'y' as lang")
    assert audited(filter_audit.filter_audit(frame(spark, docs, clash=True), table)) == audit(docs, labels)


def test_audit_of_other_filters(spark):
    docs, labels = audit_rows()
    two = {"A": filter_audit.ROW_FILTERS["A"], "D": filter_audit.ROW_FILTERS["D"]}
    got = audited(filter_audit.filter_audit(frame(spark, docs), spark.createDataFrame(labels, LABELS), two))
    want = audit(docs, labels)
    for (part, order, step), row in got.items():
        # the three filters alone are the first three steps of an order of all five
        assert row[:2] == want[part, order + "BC", step][:2]
    for part in {p for p, _, _ in got}:
        for x in "ADE":
            assert {row[6] for (p, o, s), row in got.items() if p == part and o[s - 1] == x} == \
                   {sum(row[1] for (p, o, s), row in got.items() if p == part and o[s - 1] == x)}


def test_audit_empty(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.filter_audit(spark.createDataFrame([], SCHEMA), none).collect() == []
    rows = audited(filter_audit.filter_audit(spark.createDataFrame([(None,) * 5] * 3, SCHEMA), none))
    assert len(rows) == 600 and rows["", "EABCD", 2][:3] == [0, 3, 0] and rows["", "EABCD", 1][1] == 0


def test_clash_names_cover_new_columns():
    assert "label STRING" in CLASH
