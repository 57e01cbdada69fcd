"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, byte_codec, divergence, embedding_dedup, merkle, packing, pii, quality, sharding, shingle_join, token_files, toxicity, warc
from .common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.query(spark, table(spark, sf_dir, "documents"), BYTE_BPE)


def op3_byte_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_codec.query(table(spark, sf_dir, "documents"), MULTI_RANKS, public_tokenizers.PATTERN)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(table(spark, sf_dir, "documents"), WORD_BPE)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(spark, table(spark, sf_dir, "pages"))


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.query(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.query(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality, op2_token_files, op3_byte_codec, op4_toxicity, op5_shingle_join,
        op6_packing, op7_pii, op8_embedding_dedup, op9_warc, op10_merkle,
        op11_divergence, op12_sharding, op13_alignment,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op8_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
               AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
                  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) ELSE 0 END >= 0.93),
        counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
        reached AS (SELECT vec_id AS node, vec_id AS origin FROM v UNION SELECT b, origin FROM reached JOIN links ON a = node),
        parts AS (SELECT node AS vec_id, min(origin) AS component_id FROM reached GROUP BY node)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
        FROM v LEFT JOIN counts USING (vec_id) LEFT JOIN parts USING (vec_id)""",
    "op9_warc": """
        WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS html FROM pages),
        q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
                     min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM q""",
    "op10_merkle": """
        WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t FROM documents),
        o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, t) AS place, length(t) AS n, length(t) // 4 AS q FROM d),
        f AS (SELECT o.*, coalesce(lead(t) OVER (ORDER BY place), first_value(t) OVER (ORDER BY place)) AS following FROM o),
        texts AS (SELECT place, doc_id, n, 'own' AS side, t AS txt FROM f
                  UNION ALL SELECT place, doc_id, n, 'edited', substring(t, 1, n - q) || substring(following, 1, q) FROM f),
        leaves AS (SELECT *, list_transform(string_split(txt, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
                     lambda p: list_transform(regexp_extract_all(p, '[^.!?]{1,24}[.!?]*|[.!?]+'), lambda x: sha256(x)))) AS tree FROM texts),
        paragraphs AS (SELECT *, list_transform(tree, lambda s: list_transform(s, lambda p: sha256(list_aggregate(list_append(p, ''), 'string_agg', '')))) AS inner_digests FROM leaves),
        sections AS (SELECT *, list_transform(inner_digests, lambda s: sha256(list_aggregate(s, 'string_agg', ''))) AS outer_digests FROM paragraphs),
        prints AS (SELECT *, list_transform(flatten(flatten(tree)), lambda x: x[:6]) AS codes,
                     sha256(list_aggregate(outer_digests, 'string_agg', '')) || ':' ||
                     list_aggregate(list_transform(outer_digests, lambda s, i: s[:12] || '/' || list_aggregate(list_transform(inner_digests[i],
                       lambda p, k: p[:12] || '.' || list_aggregate(list_append(list_transform(tree[i][k], lambda x: x[:6]), ''), 'string_agg', '')), 'string_agg', ',')), 'string_agg', ';')
                     AS print FROM sections),
        own AS (SELECT *, coalesce(lead(codes) OVER (ORDER BY place), first_value(codes) OVER (ORDER BY place)) AS next_codes FROM prints WHERE side = 'own'),
        pairs AS (SELECT own.place, own.doc_id, own.n, own.print, own.codes AS a, own.next_codes, e.print AS edited_print, e.codes AS edited_codes, e.txt
                  FROM own JOIN prints e ON e.place = own.place AND e.side = 'edited'),
        sides AS (SELECT place, 'edited' AS side, a, edited_codes AS b FROM pairs UNION ALL SELECT place, 'next', a, next_codes FROM pairs),
        alike AS (SELECT place, side, CASE WHEN greatest(len(a), len(b)) = 0 THEN 1.0::DOUBLE ELSE greatest(
                    len(list_intersect(list_distinct(a), list_distinct(b)))::DOUBLE / greatest(len(list_distinct(a)), len(list_distinct(b)), 1),
                    len(list_filter(list_zip(a, b), lambda x: x[1] = x[2]))::DOUBLE / greatest(len(a), len(b), 1)) END AS near FROM sides)
        SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(txt) AS edited_sha256, print AS fingerprint, edited_print AS edited_fingerprint,
               x.near AS near_edited, y.near AS near_next
        FROM pairs JOIN alike x ON x.place = pairs.place AND x.side = 'edited' JOIN alike y ON y.place = pairs.place AND y.side = 'next'""",
    "op11_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        each_term AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
        lists AS (SELECT lang, term FROM each_term GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
        counts AS (SELECT lang, source, term, count(*) AS n FROM each_term JOIN lists USING (lang, term) GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM d),
        sizes AS (SELECT lang, count(*) AS v FROM lists GROUP BY lang),
        totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
        lang_counts AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL),
        lang_totals AS (SELECT lang, sum(n) AS total FROM lang_counts GROUP BY ALL),
        p AS (SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n,
                1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * v) AS p
              FROM groups g JOIN lists l USING (lang) JOIN sizes USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN counts c USING (lang, source, term)),
        q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (total + 2 * v) AS q FROM lang_counts JOIN lang_totals USING (lang) JOIN sizes USING (lang)),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
                 FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
                  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        terms AS (SELECT lang, source, term AS item, CAST((p.p - q) * (p.p - q) // (p.p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p.p > q)
        SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pairs
        UNION ALL SELECT lang, source, 'term', item, value, CAST(rank AS INT)
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= 10""",
}
