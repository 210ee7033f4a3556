"""A training-data pipeline over documents: quality, exact copies, near copies, source mix, token ids.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read as the next stage's docs.

All stages: a null text counts as empty, a text of any length is read whole, columns beside doc_id, text and source
pass through whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import exact_dedup, mixing, ngram_join, piece_codec, quality
from tidelog.llm.common import Scratch, documents, prepare

#: Near copies are five-word shingle sets with a similarity of 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects; rows that repeat a text go or stay together, without labels all stay."""
    prepare(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text, that of the largest doc_id; a null doc_id is smaller than any other, and of rows that
    repeat it one stays by a hash."""
    prepare(spark)
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the smallest doc_id; rows without a doc_id or a word
    stay, as do texts that only share a doc_id with a near copy."""
    prepare(spark)
    return ngram_join.keep_one(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their weights; a null source is one of its own, and rows that
    repeat a doc_id in a source are taken alike."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and digests of each row; an empty text has no ids."""
    prepare(spark)
    return piece_codec.encode_ids(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", good_quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: SQL can't express a boosted classifier or a BPE encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over all documents."""
    scratch = Scratch(spark)
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
        scratch.drop(*(before for before, _ in STAGES[:i]))
    return STAGES[-1][1](spark, docs, sf_dir)
