"""Layout to HTML in one job: from spans, rectangles, rules and images to rendered documents, over written intermediates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.operators import assembly as A
from folioweave.operators import blocks as B
from folioweave.operators import layout as L
from folioweave.operators import page_pass as Q
from folioweave.operators import pages as P
from folioweave.operators import render as R
from folioweave.sources import layout_fixtures as G
from folioweave.sources.shared import sharing, written

PAGE = ["doc_id", "page"]
Picture = Callable[[Column, Column, Column, Column, Column, Column], Column]


def named_picture(doc_id: Column, page: Column, *box: Column) -> Column:
    """Stands for the picture of a place: its name, in the form that pictures have.  A rasteriser's table of pictures can be joined instead."""
    return F.base64(F.concat_ws(":", doc_id, page, *(F.format_string("%.1f", c) for c in box)).cast("binary"))


def layout_to_html(spans: DataFrame, rects: DataFrame, rules: DataFrame, images: DataFrame, page_sizes: DataFrame, picture: Picture = named_picture, text_width: float = 475.0, height: float = 842.0) -> DataFrame:
    """(doc_id, html) of every document of spans(doc_id, page, line_id, span_no, text, font, size, color, x0, y0, x1, y1) and the other layout tables.

    Written on the way: pages, spans in their lines, lines of the body, blocks, and their order; each is read by several steps.  Documents without spans have no row.
    """
    sizes = L.document_sizes(page_sizes)
    pages = written(Q.page_structure(spans, images, sizes), "pages")
    placed = written(A.placed_spans(spans, pages), "placed")
    own = written(A.own_lines(placed, pages), "own")
    repeated = written(L.repeated_edge_lines(own, height), "repeated")
    running = written(L.running_lines(own, repeated, height), "running")
    boxes = written(L.box_dedup(L.page_boxes(rects, text_width)), "boxes")
    lines = written(A.page_blocks(L.body_lines(own, running, height), boxes), "lines")
    of_blocks = written(A.block_spans(placed, lines, rules), "block-spans")
    zoned = written(B.line_zones(of_blocks), "zoned")
    profile = written(L.doc_profile(placed, page_sizes), "profile")
    blocks = written(A.described_blocks(lines, of_blocks, zoned, profile), "blocks")
    zones = written(A.boxed_zones(Q.page_zones(pages).select(*PAGE, "zone", *A.BOX), boxes), "zones")
    named = blocks.withColumnRenamed("para", "block")
    ordered = written(A.block_ordinals(P.block_order(named, zones, profile.select("doc_id", "n_pages"))), "ordered")
    refs = A.document_references(ordered, A.formula_references(zoned, blocks, picture), zones, picture)
    final = written(A.document_blocks(ordered, blocks, boxes, rects), "final")
    rendered = written(R.block_html(R.with_parts(R.with_segments(final, refs))), "rendered")
    columns = L.split_columns(placed.join(running.select(*PAGE, "line_id", "region"), [*PAGE, "line_id"])).join(running.select(*PAGE, "line_id", "region"), [*PAGE, "line_id"])
    heads = L.running_blocks(columns).where(~F.col("template").rlike(L.PAGE_NUMBER)).select("doc_id", "region", F.struct("page", "col", "template").alias("ord"), "template")
    edges = R.running_html(L.page_numbers(own, running, columns, height), heads)
    return R.document_html(R.body_html(final, rendered), edges, profile)


def layout_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = G.spans(spark, sf_dir).withColumn("color", F.when((F.col("doc_id") % 3 == 0) & (F.col("size") == 18), 12582912).when(F.col("span_no") % 3 == 1, 255).otherwise(0))
    return layout_to_html(spans, G.rects(spark, sf_dir), G.rules(spark, sf_dir), G.images(spark, sf_dir), G.page_sizes(spark, sf_dir))


QUERIES = {"layout_html": sharing(layout_html)}
ORACLES: dict[str, str] = {}
