"""Defined results for nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import pytest

from tests.llm.frames import LONG, SCHEMA, edge_rows, frame
from tidecast.llm import (exact_dedup, fingerprints, jaccard_join, language_id, license_scan, mixing, packing,
                          secret_scan, sharding, token_counts)

OPERATORS = {
    "op1": exact_dedup.exact_dedup, "op2": language_id.language_id, "op3": packing.pack,
    "op4": fingerprints.fingerprints, "op5": sharding.reshard, "op6": mixing.mix, "op7": secret_scan.secret_scan,
    "op8": token_counts.token_counts, "op9": jaccard_join.near_duplicates, "op10": license_scan.license_scan,
}


def found(spark, op):
    return OPERATORS[op](frame(spark, edge_rows(), clash=True)).collect()


@pytest.mark.parametrize("op", list(OPERATORS))
def test_empty_table(spark, op):
    assert OPERATORS[op](spark.createDataFrame([], SCHEMA)).collect() == []


def test_all_null_column(spark):
    df = spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA)
    for op, run in OPERATORS.items():
        assert len(run(df).collect()) == 3, op


def test_exact_dedup(spark):
    rows = found(spark, "op1")
    assert len(rows) == len(edge_rows())
    by = {r["doc_id"]: r for r in rows if r["doc_id"] in (1, 2, 3, 4, 5)}
    assert [by[i]["keep_id"] for i in (1, 2, 3)] == [3, 3, 3] and by[3]["kept"] and not by[1]["kept"]
    assert by[1]["group_size"] == 3 and by[4]["group_size"] == 3  # null, empty, null with null id
    assert by[4]["keep_id"] == 4 and by[4]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert sorted(r["kept"] for r in rows if r["doc_id"] == 8) == [False, True]


def test_language_id(spark):
    rows = found(spark, "op2")
    assert len(rows) == len(edge_rows())
    by = {r["doc_id"]: r for r in rows}
    for i in (4, 5, 7):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows} <= {"und", "en", "fr", "la", "de"}
    nothing = language_id.language_id(spark.createDataFrame([(0, "words here", None, "a", 1)], SCHEMA)).collect()
    assert nothing[0]["lang_pred"] == "und"


def test_packing(spark):
    rows = found(spark, "op3")
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 for r in rows)
    empty = [r for r in rows if r["doc_id"] in (4, 5)]
    assert [(r["start"], r["length"], r["doc_tokens"]) for r in empty] == [(0, 1, 1)] * 2
    long = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == 6)
    assert long[0] == (0, 4096) and sum(n for _, n in long) == [r for r in rows if r["doc_id"] == 6][0]["doc_tokens"]


def test_fingerprints(spark):
    rows = found(spark, "op4")
    assert len(rows) == len(edge_rows())
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["near_next"] == 1.0
    assert by[4]["n_chars"] == 0 and by[4]["near_next"] == 1.0  # the next is empty as well
    assert by[6]["n_chars"] == len(LONG)
    assert by[5]["near_next"] == 0.0
    alone = fingerprints.fingerprints(frame(spark, [edge_rows()[0]])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_sharding(spark):
    rows = found(spark, "op5")
    assert len(rows) == len(edge_rows())
    by = {r["doc_id"]: r for r in rows}
    assert (by[4]["size"], by[5]["size"], by[4]["text_crc32"]) == (1, 1, 0)
    for s in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_mixing(spark):
    rows = found(spark, "op6")
    assert len(rows) == len(edge_rows())
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["size"] == by[5]["size"] == by[4]["taken"] == 0
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    # sources by code point: a, b, c, z, the emoji, null last
    assert by[6]["source_size"] == len(LONG.split()) + 4 and by[None]["source_size"] == len(edge_rows()[7][1].split())


def test_secret_scan(spark):
    rows = found(spark, "op7")
    assert len(rows) == len(edge_rows())
    assert all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)


def test_token_counts(spark):
    rows = found(spark, "op8")
    by = {r["doc_id"]: r for r in rows}
    assert (by[4]["n_bytes"], by[4]["n_tokens"], by[4]["over_limit"]) == (0, 0, False)
    assert by[6]["over_limit"] and by[6]["limit_chars"] < len(LONG)
    assert by[9]["n_bytes"] == len(edge_rows()[11][1].encode())


def test_near_duplicates(spark):
    rows = found(spark, "op9")
    assert len(rows) == len(edge_rows())
    by = {r["doc_id"]: r for r in rows}
    assert [by[i]["class_id"] for i in (1, 2, 3)] == [1, 1, 1] and by[1]["n_links"] == 2
    for i in (4, 5):
        assert by[i]["class_id"] == i and by[i]["n_links"] == 0 and by[i]["kept"]
    assert sorted(r["kept"] for r in rows if r["doc_id"] == 8) == [False, True]
    assert {r["n_links"] for r in rows if r["doc_id"] is None} == {0}


def test_license_scan(spark):
    rows = found(spark, "op10")
    assert len(rows) == len(edge_rows()) and all(r["license"] is None and r["n_matches"] == 0 for r in rows)


def test_filters_keep_columns_and_one_of_repeats(spark):
    docs = frame(spark, edge_rows(), clash=True)
    for run in (exact_dedup.drop_copies, jaccard_join.drop_near_duplicates, mixing.mixed, language_id.drop_unknown):
        out = run(docs)
        assert out.columns == docs.columns
    kept = exact_dedup.drop_copies(docs).select("doc_id").collect()
    assert sorted(r[0] for r in kept if r[0] is not None) == [3, 4, 6, 7, 8, 9, 10]
    assert sum(r[0] == 8 for r in jaccard_join.drop_near_duplicates(docs).collect()) == 1
    copies = {}
    for r in mixing.mix(docs).collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + r["copies"]
    got = {}
    for r in mixing.mixed(docs).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in copies.items() if v}
