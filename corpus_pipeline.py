"""The corpus pipeline: language, toxicity, near-duplicates, mixing and tokens, each stage over what the one before it kept.

Every stage is written as Parquet in the shared folder and read again, so a lost executor repeats one stage's tasks at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import bpe, language_id, mixing, simhash, toxicity
from gleanery.llm.common import read_table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no determinable language."""
    return language_id.keep_known(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents predicted toxic by a network learnt from labelled documents that came this far."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates by fingerprint."""
    return simhash.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents until sources have their target weights, in the order of training."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return bpe.encode_decode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", known_language),
    ("toxicity", clean),
    ("simhash_dedup", one_of_each),
    ("mixing", mixed_sources),
    ("byte_bpe", tokens),
]

#: Trained models and hashes are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
