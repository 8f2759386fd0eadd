"""A training-data pipeline over documents: each stage calls one operator, is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgrules.llm import bpe, lines, minhash, mixing, toxicity
from kgrules.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't reject."""
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of each near-equal line; documents without any line left go."""
    return lines.deduplicate(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return minhash.deduplicate(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A draw of 90 % of the tokens, raked to the target shares of sources, languages and topics."""
    return mixing.sample(docs, keep=0.9)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of the bytes they decode to."""
    import public_tokenizers

    out = bpe.code(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


STAGES = [("toxicity", drop_toxic), ("lines", drop_lines), ("near_copies", drop_copies), ("mixing", mix), ("bpe", tokenize)]

#: Label models, hashed signatures and merges are not for SQL; tests/llm/test_pipeline.py holds each stage's rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
