"""A corpus pipeline of five stages: quality rules, near-duplicates, secrets, mixing, tokens.

Each stage works on all rows that the one before has written, and returns the columns of documents; the last returns each row's tokens.
SQL can't express the decoding of a random field, XXH64 or BPE merges, so there is no ORACLE_SQL; tests hold run() against plain Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioweave.llm import bpe, mixing, quality_rules, secrets, simhash
from folioweave.llm.common import Scratch, table

ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the field is fitted on the labelled documents of sf_dir."""
    field = quality_rules.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.filter_documents(docs, field)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate_documents(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_files(docs, bpe.default_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' rows, in the order that mixing gave them.  Intermediates go as soon as the next stage is written."""
    own = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = list(Scratch.live)
        made = own.written(stage(spark, docs, sf_dir), name)
        for scratch in [s for s in Scratch.live if s not in before]:
            scratch.clear()
        own.drop(docs)
        docs = made
    return docs
