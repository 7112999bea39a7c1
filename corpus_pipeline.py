"""A training corpus from ``documents``: five stages, each written and read again.

Toxic documents go, one document of each near-duplicate group stays, secrets are
blanked out, sources are mixed to their target weights, and what is left is
encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pageloom.llm import bpe, mixing, secret_scan, simhash_dedup, toxicity
from pageloom.session import prepare_session, scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the given labels doesn't call toxic."""
    prepare_session(spark)
    return toxicity.without_toxic(docs, toxicity.read_labels(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash: the one of the smallest id."""
    prepare_session(spark)
    return simhash_dedup.keep_one(docs, words=3, bits=2)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in a text replaced by a mark."""
    prepare_session(spark)
    return secret_scan.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of 150 % of all words takes them."""
    prepare_session(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with digests of ids and decoded text."""
    prepare_session(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_decode(docs, path, keep=("ids",))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("secret_scan", blank_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL has neither the shingle hash nor the merges; tests hold a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows go through the shared folder."""
    prepare_session(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
