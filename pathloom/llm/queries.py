"""The queries of this subpackage, each an operator with production parameters over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm.bpe import bpe_encode
from pathloom.llm.compression import compression_rules
from pathloom.llm.html_extract import extract_html
from pathloom.llm.mixing import TOKEN, mix_rates
from pathloom.llm.pairwise_quality import quality_classifier
from pathloom.llm.pivot_index import near_groups
from pathloom.llm.simhash import near_dedup_ids
from pathloom.llm.token_binary import token_shards
from pathloom.llm.token_counts import token_counts
from pathloom.llm.url_filter import url_filter

Query = Callable[[SparkSession, str], DataFrame]
TEMPERATURE = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), columns=["page_id", "url"])


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup_ids(_table(spark, sf_dir, "documents"))


def op5_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules(_table(spark, sf_dir, "documents"), columns=["doc_id"], ratio_col="ratio", outside_col="chunks_outside")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "embeddings"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(_table(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(_table(spark, sf_dir, "pages"))


def op9_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), columns=["doc_id"], score_col="score")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rates(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), temperature=TEMPERATURE).drop("text")


def queries() -> dict[str, Query]:
    every = (
        op1_token_counts,
        op2_token_binary,
        op3_url_filter,
        op4_simhash_dedup,
        op5_compression_rules,
        op6_embedding_dedup,
        op7_bpe,
        op8_html_extract,
        op9_pairwise_quality,
        op10_mix_sources,
    )
    return {f.__name__: f for f in every}


_OP10 = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0)::BIGINT AS n_tokens FROM documents
), s AS (
  SELECT source, sum(n_tokens)::DOUBLE AS t FROM d GROUP BY source
), g AS (
  SELECT sum(t) AS total, sum(CASE WHEN t > 0 THEN pow(t, {TEMPERATURE}) ELSE 0 END) AS whole FROM s
), r AS (
  SELECT source, CASE WHEN t > 0 THEN total * pow(t, {TEMPERATURE}) / whole / t ELSE 1 END AS exact FROM s, g
), q AS (
  SELECT source, round(exact * pow(10.0, 5.0 - floor(log10(exact)))) / pow(10.0, 5.0 - floor(log10(exact))) AS rate FROM r
)
SELECT doc_id, d.source, n_tokens, rate,
  (floor(rate) + CASE WHEN ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0 < rate - floor(rate)
   THEN 1 ELSE 0 END)::INTEGER AS copies
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_mix_sources": _OP10}
