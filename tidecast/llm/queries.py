"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import collocations as _phrases
from . import exact_dedup as _dedup
from . import filter_audit as _audit
from . import fingerprints as _prints
from . import jaccard_join as _jaccard
from . import language_id as _language
from . import license_scan as _licenses
from . import mixing as _mixing
from . import packing as _packing
from . import pivot_search as _search
from . import secret_scan as _secrets
from . import sharding as _sharding
from . import token_counts as _tokens


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dedup.exact_dedup(documents(spark, sf_dir)).drop("th")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _language.language_id(documents(spark, sf_dir))


def op3_pack_power_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack(documents(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prints.fingerprints(documents(spark, sf_dir))


def op5_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sharding.reshard(documents(spark, sf_dir)).drop("th")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix(documents(spark, sf_dir)).drop("th")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secrets.secret_scan(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens.token_counts(documents(spark, sf_dir))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jaccard.near_duplicates(documents(spark, sf_dir)).drop("th")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _licenses.license_scan(documents(spark, sf_dir))


def op11_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases.collocations(documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit.filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language_id": op2_language_id,
    "op3_pack_power_of_two": op3_pack_power_of_two,
    "op4_fingerprints": op4_fingerprints,
    "op5_reshard": op5_reshard,
    "op6_mix_sources": op6_mix_sources,
    "op7_secret_scan": op7_secret_scan,
    "op8_token_counts": op8_token_counts,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_license_scan": op10_license_scan,
    "op11_pivot_top_k": op11_pivot_top_k,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_filter_audit": op13_filter_audit,
}

# Base patterns as one SQL row a kind: number, name, pattern, value group, least value length.
_KINDS = r"""kinds(k, kind, pat, grp, least) AS (VALUES
  (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]+', 0, 24), (3, 'owned', '[A-Za-z0-9+/_-]+', 0, 20))"""

ORACLE = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
                   FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER w = 1 AS kept,
               text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id)""",
    "op7_secret_scan": f"""
        WITH {_KINDS},
        d AS (SELECT doc_id, coalesce(source, chr(0)) AS owner, coalesce(text, '') AS t FROM documents),
        -- the i-th match of a kind starts after i pieces and i - 1 matches
        c AS (SELECT doc_id, owner, k, kind, least,
                     list_transform(string_split_regex(t, pat), lambda x: length(x)) AS gaps,
                     list_transform(regexp_extract_all(t, pat), lambda x: length(x)) AS lens,
                     CASE WHEN k = 0 THEN regexp_extract_all(t, pat, 2) ELSE regexp_extract_all(t, pat) END AS vals
              FROM d, kinds),
        m AS (SELECT doc_id, owner, k, kind, least, unnest(range(1, len(lens) + 1)) AS i, gaps, lens, vals FROM c),
        n AS (SELECT doc_id, owner, k, kind, vals[i] AS v,
                     list_sum(gaps[1:i]) + coalesce(list_sum(lens[1:i - 1]), 0) AS a, lens[i] AS len
              FROM m WHERE length(vals[i]) >= least AND (k < 3 OR regexp_matches(vals[i], '[0-9]'))),
        base AS (SELECT * FROM n WHERE k < 3),
        cand AS (SELECT * FROM base UNION ALL
                 SELECT * FROM n WHERE k = 3 AND NOT EXISTS (
                   SELECT 1 FROM base b WHERE b.doc_id = n.doc_id AND b.a < n.a + n.len AND n.a < b.a + b.len)),
        own AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, doc_id)) AS repos, bool_or(k < 3) AS in_base
                FROM cand GROUP BY v),
        j AS (SELECT cand.*, owners <= 2 AND repos <= 10 AS live, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + len AS BIGINT) AS s
              FROM cand JOIN own USING (v)
              WHERE k < 3 OR (owners <= 2 AND repos <= 10 AND (in_base OR (regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]'))))),
        g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
                     count(*) FILTER (k = 2) AS n_hex,
                     coalesce(string_agg(s, ',' ORDER BY a, k) FILTER (k < 3), '') AS b,
                     string_agg(s, ',' ORDER BY a, k) AS spans,
                     count(*) FILTER (k < 3 AND live) AS n_live, count(*) FILTER (k < 3 AND NOT live) AS n_example
              FROM j GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
               coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans,
               coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
        FROM d LEFT JOIN g ON g.doc_id = d.doc_id""",
    "op9_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_\x{80}-\x{10FFFF}]+') AS w FROM documents),
        k0 AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
               FROM d),
        k AS (SELECT doc_id, s, len(s) AS n,
                     CASE WHEN len(s) = 0 THEN CAST(doc_id AS VARCHAR) ELSE md5(array_to_string(list_sort(s), '|')) END AS ck
              FROM k0),
        e AS (SELECT doc_id, unnest(s) AS x FROM k),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
              FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT p.a, p.b, ka.ck AS ca, kb.ck AS cb FROM p JOIN k ka ON ka.doc_id = p.a JOIN k kb ON kb.doc_id = p.b
              WHERE 5 * p.c >= 4 * (ka.n + kb.n - p.c)),
        r AS (SELECT doc_id, doc_id AS root FROM k UNION SELECT l.a, r.root FROM l JOIN r ON l.b = r.doc_id),
        c AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id),
        g AS (SELECT a, count(*) AS n_links, count(DISTINCT cb) FILTER (cb <> ca) AS n_text_links,
                     count(*) FILTER (cb = ca) AS n_copies FROM l GROUP BY a)
        SELECT c.doc_id, c.class_id, coalesce(n_links, 0) AS n_links, coalesce(n_text_links, 0) AS n_text_links,
               coalesce(n_copies, 0) AS n_copies, c.doc_id = c.class_id AS kept
        FROM c LEFT JOIN g ON g.a = c.doc_id""",
    "op11_pivot_top_k": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
                   FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
              FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
        FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5""",
    "op12_phrase_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
        g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2),
                     lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
              FROM p, (VALUES (1), (2), (3), (4), (5)) x(m) WHERE len(w) >= m),
        f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase),
        n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
        c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100),
        k AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS p1, array_to_string(w[k + 1:m], ' ') AS p2
              FROM c, (VALUES (1), (2), (3), (4)) x(k) WHERE k < m),
        s AS (SELECT k.lang, k.phrase, k.m, a, k, f1.f AS l, f2.f AS r, CAST(n AS BIGINT) AS n,
                     CAST(1000 * CAST(a AS HUGEINT) * n // (CAST(f1.f AS HUGEINT) * f2.f) AS BIGINT) AS score
              FROM k JOIN f f1 ON f1.lang = k.lang AND f1.phrase = p1 JOIN f f2 ON f2.lang = k.lang AND f2.phrase = p2
                   JOIN n ON n.lang = k.lang),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        h AS (SELECT b.* FROM b WHERE NOT EXISTS (
                SELECT 1 FROM c WHERE c.lang = b.lang AND c.m > b.m AND 100 * c.a >= 100 * b.a
                  AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
        SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score
        FROM h WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY rank <= 2000""",
    "op13_filter_audit": r"""
        WITH d AS (SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t,
                          regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, [len(w) < 200, 2 * len(list_distinct(w)) < len(w),
                     100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
                     regexp_matches(t, '[#$%&*|]'),
                     coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails,
                     coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
              FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
        g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
              FROM f GROUP BY part, fails),
        c(i) AS (VALUES (1), (2), (3), (4), (5)),
        o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS ord FROM c a, c b, c, c d, c e
              WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        s AS (SELECT part, ord, c.i AS step, fails, n, n_good, n_toxic, fails[ord[c.i]] AS own,
                     list_bool_or(list_transform(ord[1:c.i - 1], lambda j: fails[j])) IS TRUE AS gone,
                     len(list_filter(fails, lambda x: x)) AS bad
              FROM g, o, c),
        r AS (SELECT part, ord, step,
                     coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS kept,
                     coalesce(sum(n) FILTER (own AND NOT gone), 0) AS removed,
                     coalesce(sum(n) FILTER (own AND gone), 0) AS redundant,
                     coalesce(sum(n) FILTER (own AND bad = 1), 0) AS unique_fails,
                     coalesce(sum(n_good) FILTER (own AND NOT gone), 0) AS good_lost,
                     coalesce(sum(n_toxic) FILTER (own AND NOT gone), 0) AS toxic_lost
              FROM s GROUP BY part, ord, step)
        SELECT part, array_to_string(list_transform(ord, lambda j: chr(64 + j)), '') AS filter_order,
               CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
               CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, ord[step]) AS BIGINT) AS shapley
        FROM r""",
}
