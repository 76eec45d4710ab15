"""Layout: document profile, routing, running lines, paragraphs, boxes.  Spans and lines are tables of (doc_id, page)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioweave.functions import text as X

# Fixed values of the layout rules.
BODY_SIZE = 11.0
SCAN_CHARS, SCAN_PIXELS, SCAN_SAMPLE, SCAN_RATIO = 20, 300, 6, 0.6
EDGE_LENGTH, EDGE_TOP, EDGE_BOTTOM, EDGE_SHARE = 140, 0.14, 0.86, 0.6
COLUMN_GAP, PARAGRAPH_GAP = 12.0, 5.5
PAGE_NUMBER = r"^(?U)\s*[-–—.]?\s*\d{1,4}\s*(?:[/|·]\s*\d{1,4}\s*)?[-–—.]?\s*$"
ENUMERATOR = r"^\d{1,2}[.)、](?U)\s"
MATH_FAMILIES = "CMMI|CMSY|CMEX|MSAM|MSBM|CMU|CMR|CMTI|CMBX|CMSS|CMFinite|LMMath|Cambria|STIX|STIXTwo|Asana|XITS|Euler|MnSymbol|MathJax|Symbol"
MATH_CHARS = "≤≥≠≈≡≃≅∼∝∞∂∇±×÷·∈∉⊂⊆⊃⊇∪∩∅∀∃∑∏∫⟨⟩∥⊥∠⩽⩾→←↦⇒⇐⇔↔↑↓"
MATH_RANGES = r"\x{0370}-\x{03FF}\x{1D400}-\x{1D7FF}\x{2190}-\x{21FF}\x{2200}-\x{22FF}\x{27C0}-\x{27EF}\x{2A00}-\x{2AFF}\x{2100}-\x{214F}"
BAND, BANDS = 50.0, 400
IMAGE_SIDE, IMAGE_LEAST, IMAGE_AREA = 40.0, 3000.0, 0.85
UPLOAD_BYTES, UPLOAD_PAGES = 30 * 1024 * 1024, 60


def ordinal() -> Column:
    """The reading order of spans: page, line by height and place, span."""
    return F.struct("page", "y0", "x0", "line_id", "span_no")


def weighted_mode(spans: DataFrame, value: Column, name: str) -> DataFrame:
    """(doc_id, name): the value of most stripped characters; ties go to the one met first."""
    sums = spans.where(X.strip(F.col("text")) != "").groupBy("doc_id", value.alias("v")).agg(F.sum(F.length(X.strip(F.col("text")))).alias("n"), F.min(ordinal()).alias("at"))
    best = sums.groupBy("doc_id").agg(F.array_min(F.collect_list(F.struct((-F.col("n")).alias("n"), "at", "v"))).alias("b"))
    return best.select("doc_id", F.col("b.v").alias(name))


def body_font(spans: DataFrame) -> DataFrame:
    return weighted_mode(spans, X.font_family(F.col("font")), "body_font")


def body_size(spans: DataFrame) -> DataFrame:
    return weighted_mode(spans, F.round("size", 1), "body_size")


def page_extent(spans: DataFrame, sizes: DataFrame | None = None, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """Margins of each document: the extent of its lines that have a non-blank span, within its first page's size.

    sizes(doc_id, page, width, height); documents without a first page there have the given width and height.
    """
    lines = spans.groupBy("doc_id", "page", "line_id").agg(*(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))), F.bool_or(X.strip(F.col("text")) != "").alias("full"))
    e = lines.where("full").groupBy("doc_id").agg(F.min("x0").alias("left"), F.min("y0").alias("top"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    if sizes is None:
        e = e.withColumns({"width": F.lit(width), "height": F.lit(height)})
    else:
        e = e.join(document_sizes(sizes), "doc_id", "left").withColumns({"width": F.coalesce("width", F.lit(width)), "height": F.coalesce("height", F.lit(height))})
    return e.select("doc_id", "left", "top", (F.col("width") - F.col("x1")).alias("right"), (F.col("height") - F.col("y1")).alias("bottom"), "width", "height")


def doc_profile(spans: DataFrame, sizes: DataFrame | None = None, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """(doc_id, n_pages, body_font, body_size, left, top, right, bottom, width, height): body_font(), body_size() and page_extent() in one pass.

    Spans are read once and shuffled once, by page, without their texts.  A page leaves the weights, first places and extents of its styles (family and size), which merge
    map-side, so a document of any length is gathered as its distinct styles.
    """
    own = spans.select(
        "doc_id", "page", "line_id", X.font_family(F.col("font")).alias("family"), F.round("size", 1).alias("points"), "x0", "y0", "x1", "y1",
        F.coalesce(F.length(X.strip(F.col("text"))), F.lit(0)).alias("n"), "span_no",
    ).repartition("doc_id", "page")
    full = F.max(F.col("n") > 0).over(Window.partitionBy("doc_id", "page", "line_id"))
    edges = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}
    of_pages = own.withColumn("full", full).groupBy("doc_id", "page", "family", "points").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("n") > 0, ordinal())).alias("at"), *(f(F.when(F.col("full"), F.col(c))).alias(c) for c, f in edges.items())
    )
    styles = of_pages.groupBy("doc_id", "family", "points").agg(F.sum("n").alias("n"), F.min("at").alias("at"), F.max("page").alias("page"), *(f(c).alias(c) for c, f in edges.items()))
    style = F.struct("family", "points", "n", "at")
    docs = styles.groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages"), F.collect_list(F.when(F.col("n") > 0, style)).alias("styles"), *(f(c).alias(c) for c, f in edges.items()))

    def heaviest(name: str) -> Column:
        """The value of most characters among the styles; ties go to the one met first."""

        def weight(value: Column) -> Column:
            same = F.filter("styles", lambda s: s[name].eqNullSafe(value))
            return F.struct(-F.aggregate(same, F.lit(0).cast("long"), lambda a, s: a + s.n), F.array_min(F.transform(same, lambda s: s["at"])), value.alias("value"))

        return F.array_min(F.transform(F.array_distinct(F.transform("styles", lambda s: s[name])), weight)).value

    if sizes is None:
        docs = docs.withColumns({"width": F.lit(width), "height": F.lit(height)})
    else:
        docs = docs.join(document_sizes(sizes), "doc_id", "left").withColumns({"width": F.coalesce("width", F.lit(width)), "height": F.coalesce("height", F.lit(height))})
    shown = F.size("styles") > 0
    return docs.select(
        "doc_id", "n_pages", heaviest("family").alias("body_font"), F.coalesce(heaviest("points"), F.lit(BODY_SIZE)).alias("body_size"), F.col("x0").alias("left"), F.col("y0").alias("top"),
        (F.col("width") - F.col("x1")).alias("right"), (F.col("height") - F.col("y1")).alias("bottom"), *(F.when(shown, F.col(c)).alias(c) for c in ("width", "height")),
    )


def scanned_pages(page_text: DataFrame, images: DataFrame) -> DataFrame:
    """page_text(doc_id, page, n_text_chars) with scanned: next to no text, and an image of a page's size."""
    large = images.groupBy("doc_id", "page").agg(F.bool_or((F.col("px_w") >= SCAN_PIXELS) & (F.col("px_h") >= SCAN_PIXELS)).alias("large"))
    both = page_text.join(large, ["doc_id", "page"], "left")
    return both.select("doc_id", "page", ((F.col("n_text_chars") < SCAN_CHARS) & F.coalesce("large", F.lit(False))).alias("scanned"))


def scan_ratio(scanned: DataFrame) -> DataFrame:
    """(doc_id, sampled, ratio): share of scanned pages among six spread over the document (all, if no more)."""
    n = scanned.groupBy("doc_id").agg((F.max("page") + 1).alias("n"))
    pages = F.when(F.col("n") <= SCAN_SAMPLE, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(SCAN_SAMPLE - 1)), lambda i: F.floor(i * F.col("n") / SCAN_SAMPLE).cast("int")))
    sample = n.select("doc_id", F.explode(F.array_distinct(pages)).alias("page"))
    return sample.join(scanned, ["doc_id", "page"], "left").groupBy("doc_id").agg(F.count("*").alias("sampled"), F.avg(F.coalesce(F.col("scanned").cast("int"), F.lit(0))).alias("ratio"))


def route(ratios: DataFrame, enabled: bool = True, forced: bool = False) -> DataFrame:
    vision = F.lit(enabled) & (F.lit(forced) | (F.col("ratio") >= SCAN_RATIO))
    return ratios.select("doc_id", F.when(vision, "vision").otherwise("layout").alias("route"))


def formal_font(font: Column, body_font: Column) -> Column:
    """Whether a font is a mathematical one other than the body's."""
    family = X.font_family(font)
    return family.rlike(f"^(?i)(?:{MATH_FAMILIES})") & ~family.eqNullSafe(body_font)


def with_math(spans: DataFrame, fonts: DataFrame) -> DataFrame:
    """spans with is_math: a mathematical character, or a mathematical font other than the body's."""
    both = spans.join(fonts, "doc_id", "left")
    return both.withColumn("is_math", F.col("text").rlike(f"[{MATH_CHARS}{MATH_RANGES}]") | formal_font(F.col("font"), F.col("body_font"))).drop("body_font")


def with_text(lines: DataFrame) -> DataFrame:
    """lines with text and bullet, of s: their spans in order."""
    lines = lines.withColumn("text", F.array_join("s.text", ""))
    lead = F.regexp_replace("text", r"^(?U)\s+", "")
    return lines.withColumn("bullet", lead.rlike(f"^[{X.BULLETS}]") | lead.rlike(ENUMERATOR))


def lines_of(spans: DataFrame) -> DataFrame:
    """(doc_id, page, line_id, x0, y0, x1, y1, text, bullet): spans grouped by line, in order."""
    grouped = spans.groupBy("doc_id", "page", "line_id").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.array_sort(F.collect_list(F.struct("span_no", "x0", "text"))).alias("s")
    )
    return with_text(grouped).drop("s")


def repeated_edge_lines(lines: DataFrame, height: float = 842.0) -> DataFrame:
    """(doc_id, norm, n): texts at page edges that come back on most pages; lines are counted, not pages."""
    n_pages = lines.groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages"))
    edge = (F.length("text") > 0) & (F.length("text") <= EDGE_LENGTH) & ((F.col("y0") < EDGE_TOP * height) | (F.col("y0") > EDGE_BOTTOM * height))
    counts = lines.where(edge).groupBy("doc_id", X.edge_text(F.col("text")).alias("norm")).agg(F.count("*").alias("n"))
    return counts.join(n_pages, "doc_id").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.lit(EDGE_SHARE) * F.col("n_pages")))).select("doc_id", "norm", "n")


def at_edge(height: float = 842.0) -> Column:
    return (F.col("y0") < EDGE_TOP * height) | (F.col("y0") > EDGE_BOTTOM * height)


def running_lines(lines: DataFrame, repeated: DataFrame, height: float = 842.0) -> DataFrame:
    """The lines that run: region header above the middle, footer below."""
    hit = lines.where(at_edge(height)).withColumn("norm", X.edge_text(F.col("text"))).join(repeated.select("doc_id", "norm"), ["doc_id", "norm"], "left_semi")
    return hit.withColumn("region", F.when(F.col("y0") < height / 2, "header").otherwise("footer"))


def split_columns(spans: DataFrame) -> DataFrame:
    """(doc_id, page, line_id, col, text): a line's spans cut where the gap exceeds COLUMN_GAP, folded into three at most."""
    line = Window.partitionBy("doc_id", "page", "line_id")
    order = line.orderBy("x0", "span_no")
    new = (F.col("x0") - F.lag("x1").over(order) > COLUMN_GAP).cast("int")
    grouped = spans.withColumn("g", F.sum(F.coalesce(new, F.lit(0))).over(order)).withColumn("n", F.max("g").over(line) + 1)
    col = F.when(F.col("n") > 3, F.least(F.lit(2), F.floor(F.col("g") * 3 / F.col("n")))).otherwise(F.col("g")).cast("int")
    rows = grouped.groupBy("doc_id", "page", "line_id", col.alias("col")).agg(F.array_sort(F.collect_list(F.struct("x0", "span_no", "text"))).alias("s"))
    return rows.select("doc_id", "page", "line_id", "col", F.array_join("s.text", "").alias("text"))


def edge_numbers(lines: DataFrame, running: DataFrame, height: float = 842.0) -> DataFrame:
    """The lines that aren't running ones, stand near an edge and hold nothing but a page number."""
    own = lines.join(running.select("doc_id", "page", "line_id"), ["doc_id", "page", "line_id"], "left_anti")
    return own.where(F.col("text").rlike(PAGE_NUMBER) & ((F.col("y1") > 0.9 * height) | (F.col("y0") < 0.1 * height)))


def page_numbers(lines: DataFrame, running: DataFrame, columns: DataFrame, height: float = 842.0) -> DataFrame:
    """(doc_id, has_pagenum): some column of a running line is a page number, or some other line near an edge."""
    found = edge_numbers(lines, running, height).select("doc_id").union(columns.where(X.strip(F.col("text")).rlike(PAGE_NUMBER)).select("doc_id"))
    return lines.select("doc_id").distinct().join(found.distinct().withColumn("has_pagenum", F.lit(True)), "doc_id", "left").withColumn("has_pagenum", F.coalesce("has_pagenum", F.lit(False)))


def body_lines(lines: DataFrame, running: DataFrame, height: float = 842.0) -> DataFrame:
    """The lines of the body: neither running ones, nor page numbers near an edge, nor blank."""
    place = ["doc_id", "page", "line_id"]
    out = running.select(*place).union(edge_numbers(lines, running, height).select(*place))
    return lines.where(X.strip(F.col("text")) != "").join(out, place, "left_anti")


def running_blocks(columns: DataFrame) -> DataFrame:
    """columns(doc_id, region, page, line_id, col, text): the first of each text per region, blanks dropped."""
    template = X.strip(F.col("text"))
    first = columns.withColumn("template", template).where("template <> ''").groupBy("doc_id", "region", "template").agg(F.min(F.struct("page", "line_id", "col")).alias("at"))
    return first.select("doc_id", "region", "template", F.col("at.page").alias("page"), F.col("at.col").alias("col"))


def paragraphs(lines: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """lines with para, numbered from 0 in each page.

    places(doc_id, page, line_id, rect_no, pure) holds each line's box (null: none) and whether it is a formula only.  Lines of a box make
    paragraphs of their own, boxes in order of their first lines.  In a box a new paragraph begins where y0 leaves the lowest bottom so far by more
    than PARAGRAPH_GAP, and between formulas and prose.  Without places, or for lines that it lacks, there is no box and all is prose.
    """
    line = ["doc_id", "page", "line_id"]
    if places is None:
        placed = lines.withColumns({"_box": F.lit(None).cast("int"), "_pure": F.lit(False)})
    else:
        placed = lines.join(places.select(*line, F.col("rect_no").alias("_box"), F.col("pure").alias("_pure")), line, "left")
    return numbered_paragraphs(placed).drop("_box", "_pure")


def numbered_paragraphs(placed: DataFrame) -> DataFrame:
    """paragraphs() of lines that have their box and kind themselves, as _box and _pure."""
    box, place = Window.partitionBy("doc_id", "page", "_box"), ("y0", "x0", "line_id")
    order = box.orderBy(*place)
    low = F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    pure = F.coalesce("_pure", F.lit(False))
    new = F.coalesce(F.col("y0") - low > PARAGRAPH_GAP, F.lit(True)) | (F.lag(pure).over(order) != pure)
    marked = placed.withColumns({"_new": F.coalesce(new, F.lit(True)).cast("int"), "_top": F.min(F.struct(*place)).over(box)})
    page = Window.partitionBy("doc_id", "page").orderBy("_top", *place)
    return marked.withColumn("para", (F.sum("_new").over(page) - 1).cast("int")).drop("_new", "_top")


def bullet_segments(paras: DataFrame) -> DataFrame:
    """paras with segment (from 0 in each paragraph) and role: each line with a bullet opens a segment; list if it is a bullet character."""
    order = Window.partitionBy("doc_id", "page", "para").orderBy("y0", "x0", "line_id")
    segment = F.sum(F.col("bullet").cast("int")).over(order)
    whole = Window.partitionBy("doc_id", "page", "para", "segment").orderBy("y0", "x0", "line_id")
    lead = F.regexp_replace(F.first("text").over(whole), r"^(?U)\s+", "")
    return paras.withColumn("segment", segment.cast("int")).withColumn("role", F.when(lead.rlike(f"^[{X.BULLETS}]"), "list").otherwise("body"))


def page_boxes(rects: DataFrame, extent_width: float) -> DataFrame:
    """(doc_id, page, rect_no, y0, y1, fill, style): large filled rectangles that hold another of over 60 % of their area; the largest gives fill and style."""
    big = rects.where((F.col("x1") - F.col("x0") >= 0.3 * extent_width) & (F.col("y1") - F.col("y0") >= 10))
    area = lambda p: (F.col(f"{p}.x1") - F.col(f"{p}.x0")) * (F.col(f"{p}.y1") - F.col(f"{p}.y0"))
    o, i = big.alias("o"), big.alias("i")
    inside = (F.col("i.y0") >= F.col("o.y0") - 2) & (F.col("i.y1") <= F.col("o.y1") + 2) & (F.col("i.x0") >= F.col("o.x0") - 1) & (F.col("i.x1") <= F.col("o.x1") + 1)
    unequal = ~((F.col("i.x0") == F.col("o.x0")) & (F.col("i.y0") == F.col("o.y0")) & (F.col("i.x1") == F.col("o.x1")) & (F.col("i.y1") == F.col("o.y1")))
    same_page = (F.col("o.doc_id") == F.col("i.doc_id")) & (F.col("o.page") == F.col("i.page"))
    pairs = o.join(i, same_page & inside & unequal & (area("i") > 0.6 * area("o")))
    best = pairs.groupBy(F.col("o.doc_id").alias("doc_id"), F.col("o.page").alias("page"), F.col("o.rect_no").alias("rect_no")).agg(
        F.max_by(F.struct("o.x0", "o.y0", "o.x1", "o.y1", F.col("i.x0").alias("ix0"), "i.fill"), F.struct(area("i"), -F.col("i.rect_no"))).alias("b")
    )
    return best.select("doc_id", "page", "rect_no", "b.x0", "b.y0", "b.x1", "b.y1", "b.fill", F.when(F.col("b.ix0") - F.col("b.x0") > 2, "stripe").otherwise("frame").alias("style"))


def box_dedup(boxes: DataFrame) -> DataFrame:
    """Boxes kept in drawing order unless an earlier kept one lies within 3 points in top and bottom."""
    kind = "struct<rect_no:int,x0:double,y0:double,x1:double,y1:double,fill:string,style:string>"
    page = boxes.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("rect_no", "x0", "y0", "x1", "y1", "fill", "style"))).cast(f"array<{kind}>").alias("b"))
    near = lambda kept, x: F.exists(kept, lambda k: (F.abs(k.y0 - x.y0) <= 3) & (F.abs(k.y1 - x.y1) <= 3))
    kept = F.aggregate("b", F.expr(f"cast(array() as array<{kind}>)"), lambda acc, x: F.when(near(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return page.select("doc_id", "page", F.inline(kept))


def containers(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc_id, page, line_id, rect_no): the smallest box around each line, null if none."""
    l, b = lines.alias("l"), boxes.alias("b")  # noqa: E741
    around = (F.col("l.doc_id") == F.col("b.doc_id")) & (F.col("l.page") == F.col("b.page")) & (F.col("l.y0") >= F.col("b.y0") - 6) & (F.col("l.y1") <= F.col("b.y1") + 6) & (F.col("l.x0") >= F.col("b.x0") - 8) & (F.col("l.x1") <= F.col("b.x1") + 8)
    area = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))
    hit = l.join(b, around, "left").groupBy("l.doc_id", "l.page", "l.line_id").agg(F.min(F.when(F.col("b.rect_no").isNotNull(), F.struct(area.alias("area"), F.col("b.rect_no").alias("rect_no")))).alias("s"))
    return hit.select("doc_id", "page", "line_id", F.col("s.rect_no").alias("rect_no"))


def held_containers(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """lines with rect_no: containers() where a page's boxes come to its lines together, so that lines aren't grouped again."""
    page = ["doc_id", "page"]
    of_page = boxes.groupBy(*page).agg(F.collect_list(F.struct("rect_no", "x0", "y0", "x1", "y1")).alias("_boxes"))
    around = lambda b: (F.col("y0") >= b.y0 - 6) & (F.col("y1") <= b.y1 + 6) & (F.col("x0") >= b.x0 - 8) & (F.col("x1") <= b.x1 + 8)
    least = F.array_min(F.transform(F.filter("_boxes", around), lambda b: F.struct(((b.x1 - b.x0) * (b.y1 - b.y0)).alias("area"), b.rect_no.alias("rect_no"))))
    return lines.join(of_page, page, "left").withColumn("rect_no", least.rect_no).drop("_boxes")


def image_zones(images: DataFrame, sizes: DataFrame | None = None, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """Placements worth keeping: the first of each image on a page, neither small nor the whole page.

    sizes(doc_id, width, height) are the documents' measures (document_sizes); the given ones hold for other documents.
    """
    first = images.groupBy("doc_id", "page", "xref").agg(F.min(F.struct("x0", "y0", "x1", "y1")).alias("r")).select("doc_id", "page", "xref", "r.*")
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    area = F.lit(width * height)
    if sizes is not None:
        first = first.join(sizes.select("doc_id", "width", "height"), "doc_id", "left")
        area = F.coalesce("width", F.lit(width)) * F.coalesce("height", F.lit(height))
    return first.where((w >= IMAGE_SIDE) & (h >= IMAGE_SIDE) & (w * h >= IMAGE_LEAST) & (w * h <= IMAGE_AREA * area)).drop("width", "height")


def document_sizes(sizes: DataFrame) -> DataFrame:
    """(doc_id, width, height) of each document: its first page's, of sizes(doc_id, page, width, height)."""
    return sizes.where("page = 0").groupBy("doc_id").agg(F.min("width").alias("width"), F.min("height").alias("height"))


def image_lines(lines: DataFrame, zones: DataFrame) -> DataFrame:
    """(doc_id, page, line_id, xref) of the lines whose centre lies in an image (2 points of tolerance)."""
    l, z = lines.alias("l"), zones.alias("z")  # noqa: E741
    cx, cy = (F.col("l.x0") + F.col("l.x1")) / 2, (F.col("l.y0") + F.col("l.y1")) / 2
    inside = (cx >= F.col("z.x0") - 2) & (cx <= F.col("z.x1") + 2) & (cy >= F.col("z.y0") - 2) & (cy <= F.col("z.y1") + 2)
    same = (F.col("l.doc_id") == F.col("z.doc_id")) & (F.col("l.page") == F.col("z.page"))
    return l.join(z, same & inside).select("l.doc_id", "l.page", "l.line_id", "z.xref")


def outside_images(lines: DataFrame, zones: DataFrame) -> DataFrame:
    """The lines that image_lines() finds in no image."""
    page = ["doc_id", "page"]
    of_page = zones.groupBy(*page).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("_zones"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = lambda z: cx.between(z.x0 - 2, z.x1 + 2) & cy.between(z.y0 - 2, z.y1 + 2)
    return lines.join(of_page, page, "left").where(~F.coalesce(F.exists("_zones", inside), F.lit(False))).drop("_zones")


def banded(df: DataFrame, low: Column, high: Column) -> DataFrame:
    """df with a row for each band of BAND points of the page that low to high meets, as _band; _first is the lowest of them.

    Two intervals that meet share a band.  Rows joined by _band, where _band is the greater of their _first, meet once; candidates are the rows of one band, not
    of the page.  Places outside of the bands count to the outermost ones.
    """
    place = lambda c: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(BAND * BANDS)) / BAND).cast("int")
    ends = df.withColumns({"_first": place(F.least(low, high)), "_last": place(F.greatest(low, high))})
    return ends.withColumn("_band", F.explode(F.sequence("_first", "_last"))).drop("_last")


def same_band(a: str, b: str) -> Column:
    """Of two banded tables: rows of one page and band, in the first band they share."""
    keys = [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in ("doc_id", "page", "_band")]
    return keys[0] & keys[1] & keys[2] & (F.col(f"{a}._band") == F.greatest(f"{a}._first", f"{b}._first"))


def fraction_words(spans: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, page, line_id, span_no) of alphabetic spans under or over a short rule that covers 70 % of their width."""
    words = spans.where(X.strip(F.col("text")).rlike(r"^[\p{L}]+$"))
    s, r = banded(words, F.col("y0") - 4, F.col("y1") + 4).alias("s"), banded(rules, F.col("y0"), F.col("y1")).alias("r")
    w = F.col("s.x1") - F.col("s.x0")
    short = (F.col("r.y1") - F.col("r.y0") <= 2.6) & (F.col("r.x1") - F.col("r.x0") <= 3 * F.greatest(w, F.lit(8.0)))
    cover = F.least("s.x1", "r.x1") - F.greatest("s.x0", "r.x0") >= 0.7 * w
    near = (F.col("r.y0") - F.col("s.y1")).between(-1.5, 4.0) | (F.col("s.y0") - F.col("r.y1")).between(-1.5, 4.0)
    return s.join(r, same_band("s", "r") & short & cover & near, "left_semi").select("doc_id", "page", "line_id", "span_no").distinct()


def accepted_files(files: DataFrame) -> DataFrame:
    """files(path, length, n_pages) with reason: null if accepted."""
    reason = F.when(~F.lower("path").endswith(".pdf"), "type").when(F.col("length") > UPLOAD_BYTES, "size").when(F.col("n_pages") > UPLOAD_PAGES, "pages")
    return files.withColumn("reason", reason)
