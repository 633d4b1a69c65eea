"""The subpackage's queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandplan.llm import decontaminate, exact_dedup, lexical_search, license_scan, lm_score, packing, quality, sharding, simhash, substring_dedup, token_counts, url_filters, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` has no fetch time, so one within 2024 follows from page_id."""
    second = F.pmod(F.col("page_id") * 7919, F.lit(366 * 24)) * 3600 + 1704067200
    captures = table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds(second).alias("fetched_at"))
    return url_filters.verdicts(captures, url_filters.default_entries(spark))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_packing, op3_benchmark_decontamination, op4_sharding, op5_quality_classifier, op6_lm_scoring, op7_url_filters, op8_simhash_near_dedup, op9_exact_dedup, op10_substring_dedup, op11_lexical_search, op12_license_scan, op13_embedding_whitening)} | {"pipeline": corpus_pipeline.run}

_NORMALISED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ENTRIES = ", ".join(f"('{a}', '{b}', TIMESTAMP '{c}', '{d}')" for a, b, c, d in url_filters.ENTRIES)

ORACLES = {
    "op7_url_filters": f"""
        WITH entries(list_name, pattern, day, action) AS (VALUES {_ENTRIES}),
        daily AS (
            SELECT list_name, pattern, day, max(CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END) AS strict
            FROM entries GROUP BY ALL),
        listed AS (
            SELECT list_name, pattern, CASE strict WHEN 2 THEN 'block' WHEN 1 THEN 'allow' END AS action, day AS valid_from,
                   lead(day) OVER (PARTITION BY list_name, pattern ORDER BY day) AS valid_until, strict
            FROM daily),
        captures AS (
            SELECT page_id, make_timestamp((((page_id * 7919) % 8784) * 3600 + 1704067200) * 1000000) AS fetched_at,
                   nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#@:]+)', 1)), '[.]+$', ''), '') AS host
            FROM pages),
        ranked AS (
            SELECT page_id, list_name, pattern, action, valid_from,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, action = 'allow' DESC, list_name DESC) AS nth
            FROM captures JOIN listed ON (host = pattern OR host LIKE '%.' || pattern) AND fetched_at >= valid_from
                 AND (valid_until IS NULL OR fetched_at < valid_until)
            WHERE strict > 0)
        SELECT page_id, host, fetched_at, list_name, pattern, action, valid_from, coalesce(action <> 'block', true) AS kept
        FROM captures LEFT JOIN (SELECT * FROM ranked WHERE nth = 1) USING (page_id)""",
    "op9_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_NORMALISED}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AND row_number() OVER (PARTITION BY text_sha256, doc_id) = 1 AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op11_lexical_search": rf"""
        WITH words AS (
            SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all({_NORMALISED}, '{lexical_search.TERM}')) AS term FROM documents),
        sizes AS (SELECT row, count(*) AS n FROM words GROUP BY row),
        totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
        counts AS (SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
        weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, totals GROUP BY term, docs),
        wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_NORMALISED}, '{lexical_search.TERM}')) AS term FROM benchmark),
        scores AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
            FROM wanted JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (row), totals GROUP BY item_id, row, doc_id),
        ranked AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
            FROM scores WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 10""",
}
