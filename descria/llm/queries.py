"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from descria.llm import (
    collocations,
    compress_classifier,
    decontaminate,
    fill_middle,
    jaccard_join,
    line_dedup,
    packing,
    quality_rules,
    sharding,
    token_files,
    toxicity,
    url_filter,
    warc,
)
from descria.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            TWINS[name] = sql
        return fn

    return add


@_query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge_quality(docs, quality_rules.fit_quality_model(docs, table(spark, sf_dir, "labels")))


@_query("op6_compression_classifier")
def op6_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = compress_classifier.fit_compression_model(docs, table(spark, sf_dir, "labels"))
    return compress_classifier.score_quality(docs, model)


@_query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op4_jaccard_join")
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@_query("op5_sampled_splitters")
def op5_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

_RULE_ROWS = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)


@_query(
    "op7_url_filter",
    f"""
    WITH rest AS (
        SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS r FROM pages
    ), parts AS (
        SELECT row_number() OVER () AS n, page_id,
               translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
        FROM rest
    ), rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_ROWS}), hits AS (
        SELECT n, rule_host || rule_path AS rule, rule_verdict,
               row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
        FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    )
    SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
    FROM parts LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (n)
    """,
)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


@_query("op8_simple8b_files")
def op8_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op9_warc_index")
def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@_query("op3_bm25_decontamination")
def op3_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op10_weak_toxicity")
def op10_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity_model(docs, table(spark, sf_dir, "labels")))


_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _hash_number(group: int) -> str:
    return f"CAST('0x' || substr(h, {8 * group - 7}, 8) AS BIGINT)"


@_query(
    "op11_fill_middle",
    f"""
    WITH units AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
               sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
        FROM documents
    ), cuts AS (
        SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, {_hash_number(1)} % (len(u) + 1) AS c1, {_hash_number(2)} % (len(u) + 1) AS c2,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_hash_number(3)} % 100 >= 100 THEN 'plain'
                    WHEN {_hash_number(4)} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
        FROM units
    ), parts AS (
        SELECT doc_id, n, form, t, array_to_string(u[1:least(c1, c2)], '') AS p,
               array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:], '') AS s
        FROM cuts
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM parts
    """,
)
def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


@_query(
    "op12_line_dedup",
    f"""
    WITH docs AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS t FROM documents
    ), lines AS (
        SELECT d, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS k FROM docs
    ), keyed AS (
        SELECT d, k, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_A_TO_Z}) AS key FROM lines
    ), shared AS (
        SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT d) >= 10
    ), kept AS (
        SELECT d, k, line, key IN (SELECT key FROM shared) AS gone FROM keyed
    )
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
    FROM docs JOIN kept USING (d) GROUP BY d, doc_id
    """,
)
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


@_query(
    "op13_collocations",
    f"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), {_A_TO_Z}), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ), numbered AS (
        SELECT row_number() OVER () AS piece, lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces
    ), words AS (
        SELECT lang, piece, unnest(w) AS w1, unnest(range(len(w))) AS k FROM numbered
    ), runs AS (
        SELECT lang, w1, lead(w1, 1) OVER s AS w2, lead(w1, 2) OVER s AS w3, lead(w1, 3) OVER s AS w4
        FROM words WINDOW s AS (PARTITION BY piece ORDER BY k)
    ), counted AS MATERIALIZED (
        SELECT lang, 1 AS m, w1 AS p, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 30
        UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
        UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
        UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM runs WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
    ), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM numbered GROUP BY lang
    ), halves AS (
        SELECT lang, m, p, f, k, array_to_string(string_split(p, ' ')[:k], ' ') AS first, array_to_string(string_split(p, ' ')[k + 1:], ' ') AS rest
        FROM counted, (VALUES (1), (2), (3)) AS q(k) WHERE k < m
    ), best AS (
        SELECT c.lang, c.p, c.m, c.f AS a, c.k, x.f AS l, y.f AS r, CAST(2000000 * CAST(c.f AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
        FROM halves AS c JOIN counted AS x ON x.lang = c.lang AND x.p = c.first JOIN counted AS y ON y.lang = c.lang AND y.p = c.rest
        QUALIFY row_number() OVER (PARTITION BY c.lang, c.p ORDER BY score, c.k) = 1
    ), covered AS (
        SELECT lang, sub, max(f) AS f FROM (
            SELECT lang, f, first AS sub FROM halves WHERE k = m - 1 UNION ALL SELECT lang, f, rest FROM halves WHERE k = 1
        ) GROUP BY lang, sub
    ), ranked AS (
        SELECT b.lang, b.p AS phrase, b.a, b.l, b.r, b.score,
               row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.p) AS rank
        FROM best AS b LEFT JOIN covered AS o ON o.lang = b.lang AND o.sub = b.p
        WHERE o.f IS NULL OR CAST(o.f AS HUGEINT) * 100 < CAST(b.a AS HUGEINT) * 80
    )
    SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents"))
