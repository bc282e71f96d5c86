"""The corpus pipeline, stage by stage against plain Python, and on edge cases."""

import re
from collections import Counter

import corpus_pipeline
from tests.llm.frames import SCHEMA, documents, edge_rows, frame
from tests.llm.test_against_brute_force import brute_links, check_mix
from tidecast.llm import mixing, packing

SF = "/root/testdata/sf0.001"


def stages(spark, docs, folder):
    """Results of all stages, each written and read again as the next one's input."""
    out = []
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/{k}"
        function(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_every_stage(spark, scratch):
    docs = documents(spark)
    known, unique, apart, mixed, pieces = stages(spark, docs, scratch)
    for df in (known, unique, apart, mixed):
        assert df.columns == docs.columns
    # language ID leaves the prose of the table alone
    assert known.count() == docs.where("text rlike '[a-zA-Z]'").count()
    # exact dedup: the longest original, then the smallest id, of each group stays
    best = {}
    for r in known.collect():
        text = r["text"] or ""
        key = re.sub("[\x20\x09-\x0d]", "", text)
        best[key] = min(best.get(key, (1, 0)), (-len(text), r["doc_id"]))
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(i for _, i in best.values())
    # near duplicates: the smallest id of each group stays
    groups = brute_links(sorted((r["doc_id"], r["text"]) for r in unique.collect()))
    assert {r["doc_id"] for r in apart.collect()} == {c for c, _ in groups.values()}
    # mixing: rows repeat by their copies
    want = mixing.mix(apart).collect()
    check_mix(want, apart.collect())
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(
        {r["doc_id"]: r["copies"] for r in want if r["copies"]})
    # packing: every copy is packed whole
    rows, copies = pieces.collect(), Counter(r["doc_id"] for r in mixed.collect())
    tokens = {r["doc_id"]: r["doc_tokens"] for r in rows}
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["length"]
    assert total == Counter({i: n * copies[i] for i, n in tokens.items()})
    assert len({r["sequence_id"] for r in rows}) == len(rows)


def test_run_is_all_stages(spark, scratch):
    last = stages(spark, documents(spark), scratch)[-1]
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = corpus_pipeline.run(spark, SF).select(cols).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, last.select(cols).collect()))


def test_edges_and_empty_table(spark, scratch):
    out = stages(spark, frame(spark, edge_rows(), clash=True), f"{scratch}/a")
    ids = {r["doc_id"] for r in out[2].collect()}
    assert 3 in ids and not ids & {1, 2, 4, 5, 7}  # copies, empty and wordless texts are gone
    assert sum(r["doc_id"] == 8 for r in out[2].collect()) == 1
    for df in stages(spark, spark.createDataFrame([], SCHEMA), f"{scratch}/b"):
        assert df.count() == 0


def test_piece_lengths_cover_a_document():
    for n in range(1, 3 * packing.MAX_LEN, 97):
        assert sum(packing.binary_lengths(n)) == n
