"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm import (
    alignment,
    byte_bpe,
    divergence,
    html_blocks,
    license_scan,
    multi_index,
    near_dedup,
    packing,
    quality_rules,
    secret_scan,
    simhash,
    token_store,
    warc_zstd,
)

#: Tokens that a packed sequence holds.
CAPACITY = 4096


def vocabulary(name: str) -> str:
    """Where the vocabulary files of the public tokenizers are on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = quality_rules.learn(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.quality(docs, rules).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "rule",
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_zstd.round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extracted(_table(spark, sf_dir, "pages"))


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(_table(spark, sf_dir, "embeddings"), query_every=50, k=5)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        of_kind = F.filter("base", lambda s: s["kind"] == secret_scan.KINDS.index(kind))
        return F.size(of_kind).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, ("assign", "access", "hex")),
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.packed_digest(docs, vocabulary("word_bpe_49k.json"), 1, CAPACITY)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digest(docs, path, pre_token_pattern())


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(_table(spark, sf_dir, "documents"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = token_store.round_trip(docs, vocabulary("byte_bpe_50k.json"), 0)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = alignment.alignment(
        docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    )
    figures = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return found.select("doc_id", *figures)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name -> callable of (spark, sf_dir)."""
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_warc": op2_warc,
        "op3_html_text": op3_html_text,
        "op4_multi_index": op4_multi_index,
        "op5_secret_scan": op5_secret_scan,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_near_dedup": op8_near_dedup,
        "op9_license_scan": op9_license_scan,
        "op10_token_ids": op10_token_ids,
        "op11_token_alignment": op11_token_alignment,
        "op12_source_divergence": op12_source_divergence,
        "op13_simhash": op13_simhash,
    }


def oracle_sql() -> dict[str, str]:
    """Query name -> SQL that gives the same rows in DuckDB.

    The others have parts that SQL cannot express: learned rules and trees, an
    approximate index, tokenizers, packing, statistics of tokens, the method's own labels.
    """
    return {
        "op2_warc": _WARC_SQL,
        "op8_near_dedup": _NEAR_DEDUP_SQL,
        "op12_source_divergence": _DIVERGENCE_SQL,
    }


#: SHA-1 comes as 40 hex digits; each five of them are four digits of base 32.
_WARC_SQL = """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
    ), kept AS (
        SELECT html, max(page_id) AS kept FROM p GROUP BY html
    )
    SELECT page_id,
           CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
           list_aggregate(list_transform(range(32), lambda i: substr(
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT)
                     >> CAST(15 - i % 4 * 5 AS INT)) & 31 AS INT) + 1, 1)), 'string_agg', '')
               AS payload_digest,
           CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id != kept THEN kept END AS refers_to
    FROM p JOIN kept USING (html)
"""

_NEAR_DEDUP_SQL = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS words
        FROM documents
    ), sets AS MATERIALIZED (
        SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(
                range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
            WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles
        FROM w
    ), sizes AS (
        SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM sets
    ), flat AS (
        SELECT doc_id, unnest(shingles) AS s FROM sets
    ), links AS MATERIALIZED (
        SELECT a.doc_id AS a, b.doc_id AS b
        FROM flat a JOIN flat b ON a.s = b.s AND a.doc_id < b.doc_id
        JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
        GROUP BY a.doc_id, b.doc_id, x.n, y.n
        HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
    ), ways AS (
        SELECT a, b FROM links UNION ALL SELECT b, a FROM links
    ), reach(doc_id, other) AS (
        SELECT doc_id, doc_id FROM sizes
        UNION
        SELECT r.doc_id, l.b FROM reach r JOIN ways l ON l.a = r.other
    )
    SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id,
           s.doc_id = min(r.other) AS kept
    FROM sizes s JOIN reach r ON r.doc_id = s.doc_id
    GROUP BY s.doc_id, s.n
"""

_DIVERGENCE_SQL = r"""
    WITH d AS (
        SELECT row_number() OVER () AS id, coalesce(text, '') AS text,
               coalesce(lang, '') AS lang, coalesce(source, '') AS source
        FROM documents
    ), t AS MATERIALIZED (
        SELECT id, lang, source, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM d
    ), kept AS MATERIALIZED (
        SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10
    ), langs AS (
        SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS total
        FROM kept GROUP BY lang
    ), cells AS MATERIALIZED (
        SELECT t.lang, t.source, t.term, count(*) AS n
        FROM t SEMI JOIN kept k ON k.lang = t.lang AND k.term = t.term
        GROUP BY t.lang, t.source, t.term
    ), g AS MATERIALIZED (
        SELECT x.lang, x.source, coalesce(sum(c.n), 0) AS total
        FROM (SELECT DISTINCT lang, source FROM d) x
        LEFT JOIN cells c ON c.lang = x.lang AND c.source = x.source
        GROUP BY x.lang, x.source
    ), p AS MATERIALIZED (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
               1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.total + 2 * l.v) AS p,
               1 + 1000000000 * (k.n + 2) // (l.total + 2 * l.v) AS q
        FROM g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
        LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    ), sums AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source != a.source
        GROUP BY a.lang, a.source, b.source
    ), pairs AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
        FROM g a JOIN g b ON b.lang = a.lang AND b.source != a.source
        LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    ), terms AS (
        SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
        FROM p WHERE n > 0 AND p > q
    ), ranked AS (
        SELECT *, row_number() OVER (
            PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
        FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
    )
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
    FROM ranked WHERE part = 'pair' OR rank <= 10
"""
