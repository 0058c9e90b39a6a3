"""A training corpus from raw documents: quality rules, quality classifier, near-dedup, mixture, token ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm.bpe import bpe_encode
from pathloom.llm.compression import compression_rules
from pathloom.llm.mixing import mix_copies
from pathloom.llm.pairwise_quality import quality_classifier
from pathloom.llm.queries import TEMPERATURE
from pathloom.llm.simhash import near_dedup
from pathloom.llm.vocab import DEFAULT_PATH

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents within the compression bands.

    Null and empty texts go, those below 64 bytes stay. Rows decide alone: equal rows fare alike, repeated ones stay repeated, ids
    may be null. All columns pass through whatever their names; an empty table stays empty.
    """
    return compression_rules(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents above the score quantile.

    The model learns from the labelled rows of the raw documents, as the stage before has dropped most of the bad ones; the
    quantile and its level come from `docs` alone. Null and empty texts go; rows with a tied score, so all equal rows, fare
    alike and stay at the threshold. Without labels of both kinds all others stay. All columns pass through whatever their
    names; an empty table stays empty.
    """
    return quality_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), training=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal ones, that of the least id; null ids are greatest.

    Null texts stay, all empty texts are one group. Of rows with one id and text one stays; rows of one id with texts that
    differ are two documents. All columns pass through whatever their names; an empty table stays empty.
    """
    return near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture wants it; weights are of the tokens that the next stage makes.

    A null source is a source of its own; null and empty texts count no tokens but have the rate of their source, 1 if that
    has none at all. Rows of one id get equally many copies. All columns pass through whatever their names, without one for
    the copies; an empty table stays empty.
    """
    return mix_copies(docs, temperature=TEMPERATURE, vocab_path=DEFAULT_PATH)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, lang, source, token_ids, n_tokens, decodes_back) of all documents, repeated ones and null ids included.

    A null text has null ids, an empty one none. Other columns are not read; an empty table gives no row.
    """
    return bpe_encode(docs, keep=("lang", "source"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", classifier),
    ("simhash_near_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

ORACLE_SQL = None  # compression, learned scores and fingerprints are beyond SQL; tests hold run() against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
