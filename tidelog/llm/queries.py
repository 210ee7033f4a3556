"""The thin queries over the operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import exact_dedup, language_id, lm_scoring, mixing, ngram_join, piece_codec, quality, suffix_dedup, token_counts, topk_search
from tidelog.llm.common import documents, prepare


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return exact_dedup.deduplicate(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return piece_codec.encode_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language_id.identify(documents(spark, sf_dir))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return lm_scoring.score_documents(documents(spark, sf_dir))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ngram_join.join(documents(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return topk_search.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("k") % 50 == 0)


QUERIES = {
    "op6_topk_search": op6_topk_search,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op1_lm_scoring": op1_lm_scoring,
    "op8_language_id": op8_language_id,
    "op10_quality": op10_quality,
    "op5_token_counts": op5_token_counts,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_exact_dedup": op4_exact_dedup,
    "op9_mixing": op9_mixing,
}

ORACLES = {
    "op6_topk_search": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score
          FROM v AS q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 5
    """,
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY t)
    """,
    "op9_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                 CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS u
          FROM documents),
        s AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                 (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
          FROM d GROUP BY source),
        r AS (
          SELECT *, CAST(3 * source_size AS DOUBLE) / w AS ratio,
                 CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
        l AS (
          SELECT *, CAST(total - (sum(3 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING) - 3 * source_size) AS DOUBLE)
                 / CAST(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
          FROM r),
        t AS (
          SELECT source, source_size,
                 least(CAST(3 * source_size AS DOUBLE),
                       coalesce(w * (SELECT arg_min(level, ratio) FROM l WHERE level < ratio), CAST(3 * source_size AS DOUBLE))) AS target
          FROM r),
        p AS (
          SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size + 1e-9) AS BIGINT)) ELSE 0 END AS base FROM t),
        q AS (
          SELECT *, CASE WHEN base >= 3 THEN 0 ELSE CAST(floor(target + 1e-6) AS BIGINT) - base * source_size END AS gap FROM p),
        x AS (
          SELECT d.doc_id, d.source, d.u, d.size, q.source_size, q.target, q.base, q.gap AS gap0
          FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
        -- Three times: of those that have none and fit into what is missing, as many as fit in the fixed order.
        x0 AS (SELECT *, size <= gap0 AND sum(CASE WHEN size <= gap0 THEN size ELSE 0 END) OVER o <= gap0 AND gap0 > 0 AS t0
               FROM x WINDOW o AS (PARTITION BY source ORDER BY u, doc_id NULLS FIRST)),
        y0 AS (SELECT *, gap0 - sum(CASE WHEN t0 THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap1 FROM x0),
        x1 AS (SELECT *, NOT t0 AND size <= gap1 AND sum(CASE WHEN NOT t0 AND size <= gap1 THEN size ELSE 0 END) OVER o <= gap1 AND gap1 > 0 AS t1
               FROM y0 WINDOW o AS (PARTITION BY source ORDER BY u, doc_id NULLS FIRST)),
        y1 AS (SELECT *, gap1 - sum(CASE WHEN t1 THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap2 FROM x1),
        x2 AS (SELECT *, NOT t0 AND NOT t1 AND size <= gap2
                      AND sum(CASE WHEN NOT t0 AND NOT t1 AND size <= gap2 THEN size ELSE 0 END) OVER o <= gap2 AND gap2 > 0 AS t2
               FROM y1 WINDOW o AS (PARTITION BY source ORDER BY u, doc_id NULLS FIRST)),
        z AS (SELECT *, base + CASE WHEN t0 OR t1 OR t2 THEN 1 ELSE 0 END AS copies FROM x2)
        SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM z
    """,
}
