"""The registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import assembly, blocks, layout, markdown, pages, render, structure, translation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**translation.QUERIES, **layout.QUERIES, **markdown.QUERIES, **render.QUERIES, **structure.QUERIES, **blocks.QUERIES, **pages.QUERIES, **assembly.QUERIES}
ORACLES: dict[str, str] = {**translation.ORACLES, **layout.ORACLES, **markdown.ORACLES, **render.ORACLES, **structure.ORACLES, **blocks.ORACLES, **pages.ORACLES, **assembly.ORACLES}
FLAGSHIP = "batch_pack"
