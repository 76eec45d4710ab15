"""Intermediates that several steps of one query read: written once under the shared folder, read from there by each step.

Spark plans a DataFrame anew wherever it is used.  Where a query uses one many times, that would repeat its scans and shuffles as often; a written table costs one
pass, has known sizes for the planner, and is all that a lost executor has to read again.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from .tables import shared_folder

#: What the query that is being built has written, by step and arguments; None outside of such queries.
HELD: ContextVar[dict[tuple, DataFrame] | None] = ContextVar("held", default=None)


def once(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """step(spark, sf_dir, *arguments), written at its first use within a sharing() query; elsewhere it stays a plan."""

    @functools.wraps(step)
    def run(spark: SparkSession, sf_dir: str, *arguments: object) -> DataFrame:
        held, key = HELD.get(), (step.__module__, step.__qualname__, sf_dir, *arguments)
        if held is None:
            return step(spark, sf_dir, *arguments)
        if key not in held:
            made = step(spark, sf_dir, *arguments)
            path = shared_folder(spark, step.__name__)
            made.write.option("compression", "zstd").parquet(path)
            held[key] = spark.read.schema(made.schema).parquet(path)
        return held[key]

    return run


def written(df: DataFrame, name: str) -> DataFrame:
    """df as it comes back from a folder of its own."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sharing(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose once() steps are written; each call writes its own, from the tables as they are then."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if HELD.get() is not None:
            return query(spark, sf_dir)
        token = HELD.set({})
        try:
            return query(spark, sf_dir)
        finally:
            HELD.reset(token)

    return run
