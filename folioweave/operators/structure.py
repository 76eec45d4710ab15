"""Structure of pages: baseline bands, kinds of lines, formula zones, styles of paragraphs.

A page's lines are few, so each page is one row with arrays; the two merges whose outcome depends on their order run as Arrow-batched
functions from arrays of numbers to arrays of labels, everything around them is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioweave.functions import text as X

from .layout import ENUMERATOR, banded, same_band

# Fixed values of the formula rules.
FORMULA_WORDS = ("re", "im", "ou", "avec", "si", "pour", "donc", "arg", "cos", "sin", "tan", "ln", "log", "exp", "mod", "min", "max", "sup", "inf", "sh", "ch", "th")
ZONE_WORDS = ("re", "im", "mod", "arg", "cos", "sin", "tan", "cot", "ln", "log", "exp", "sup", "inf", "min", "max", "ch", "sh", "th", "lim", "arccos", "arcsin", "arctan")
PUNCTUATION = r"""^(?U)\s*[,.;:!?·、。，；：！？…'"“”‘’]+\s*$"""
BAND, COVER, TALLER, PROSE, STRAY, EMPHASIS = 0.15, 0.12, 1.7, 6, 6.5, 0.6


def longest_first(words: tuple[str, ...]) -> list[str]:
    """The order in which words are taken out of a text; equal lengths by the alphabet."""
    return sorted(words, key=lambda w: (-len(w), w))


def formula_only(text: Column, words: tuple[str, ...] = FORMULA_WORDS) -> Column:
    """Whether nothing is left once the words are taken out of the text's letters, longest first, again and again."""
    letters = F.regexp_replace(F.lower(text), "[^a-zà-ÿ]", "")
    alphabet = "".join(sorted(set("".join(words))))

    def once(s: Column) -> Column:
        for w in longest_first(words):
            s = F.replace(s, F.lit(w), F.lit(""))
        return s

    def step(acc: Column, _: Column) -> Column:
        return F.when(acc.done, acc).otherwise(X.let(once(acc.s), lambda s: F.struct(s.alias("s"), ((s == acc.s) | (s == "")).alias("done"))))

    def left(s: Column) -> Column:
        passes = F.sequence(F.lit(0), F.floor(F.length(s) / 2).cast("int"))
        return F.aggregate(passes, F.struct(s.alias("s"), (s == "").alias("done")), step, lambda acc: acc.s == "")

    # What can be emptied is empty, or begins as a word begins, ends as one ends, and holds one: few texts go through the passes.
    first, last = ("".join(sorted({w[k] for w in words})) for k in (0, -1))
    hopeful = lambda s: s.rlike(f"^(?:[{first}][{alphabet}]*[{last}])?$") & ((s == "") | s.rlike("|".join(longest_first(words))))
    return X.let(letters, lambda s: F.when(hopeful(s), left(s)).otherwise(False))


def line_kinds(spans: DataFrame) -> DataFrame:
    """(doc_id, page, line_id, x0, y0, x1, y1, has_math, pure, bullet, math_x0, math_x1) of spans with is_math.

    Punctuation in a mathematical font doesn't widen the formula; a line is pure if it has mathematics and next to no other words.
    """
    real = F.col("is_math") & ~F.col("text").rlike(PUNCTUATION)
    rows = spans.groupBy("doc_id", "page", "line_id").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.bool_or("is_math").alias("has_math"),
        F.min(F.when(real, F.col("x0"))).alias("math_x0"), F.max(F.when(real, F.col("x1"))).alias("math_x1"), F.array_sort(F.collect_list(F.struct("span_no", "x0", "text", "is_math"))).alias("s"),
    )
    return kinds_of(rows).select("doc_id", "page", "line_id", *KIND)


KIND = ("x0", "y0", "x1", "y1", "has_math", "pure", "bullet", "math_x0", "math_x1")


def kinds_of(rows: DataFrame) -> DataFrame:
    """rows with pure and bullet, of has_math and s."""
    text = lambda spans: F.array_join(F.transform(spans, lambda x: x.text), "")
    lead = F.regexp_replace(text("s"), r"^(?U)\s+", "")
    rest = X.strip(F.regexp_replace(X.strip(text(F.filter("s", lambda x: ~x.is_math))), f"^[{X.BULLETS}]+", ""))
    pure = F.col("has_math") & X.let(rest, lambda r: (F.length(r) < 3) | formula_only(r))
    return rows.withColumns({"pure": pure, "bullet": X.let(lead, lambda t: (t == "") | t.rlike(f"^[{X.BULLETS}]") | t.rlike(ENUMERATOR))})


def bands_of(x0: list, y0: list, x1: list, y1: list) -> list[int]:
    """Band of each box, boxes in order of (y0, x0): a box joins the last band if its centre lies in the band's tallest box; then neighbours meet."""
    bands: list[tuple[list[float], tuple[float, float], list[int]]] = []
    inside = lambda c, tall: tall[0] - BAND * (tall[1] - tall[0]) <= c <= tall[1] + BAND * (tall[1] - tall[0])
    taller = lambda a, b: b if b[1] - b[0] > a[1] - a[0] else a
    for i, box in enumerate(zip(y0, y1, strict=True)):
        if bands and inside((box[0] + box[1]) / 2, bands[-1][1]):
            extent, tall, members = bands.pop()
            bands.append(([min(extent[0], box[0]), max(extent[1], box[1])], taller(tall, box), [*members, i]))
        else:
            bands.append((list(box), box, [i]))
    k = 0
    while k + 1 < len(bands):
        (a, tall_a, of_a), (b, tall_b, of_b) = bands[k], bands[k + 1]
        if inside((b[0] + b[1]) / 2, tall_a) or inside((a[0] + a[1]) / 2, tall_b):
            bands[k : k + 2] = [([min(a[0], b[0]), max(a[1], b[1])], taller(tall_a, tall_b), of_a + of_b)]
            k = max(k - 1, 0)  # only the pairs at the new band's two sides can have changed
        else:
            k += 1
    label = {i: n for n, band in enumerate(bands) for i in band[2]}
    return [label[i] for i in range(len(y0))]


def closure_of(x0: list, y0: list, x1: list, y1: list) -> list[int]:
    """Zone of each box: the first pair that is near in order (by growing extents) merges, until none is.

    Only pairs of a zone that has grown can be new, and of those the ones with an earlier zone come first.  So the search goes on at the zone that has grown,
    instead of at the start: it looks at all others once for each zone and each merge.
    """
    box = np.array([x0, y0, x1, y1], float)
    n = box.shape[1]
    whole, into, i = np.ones(n, bool), np.arange(n), 0
    while i < n:
        if not whole[i]:
            i += 1
            continue
        a = box[:, i : i + 1]
        x_over, y_over = np.minimum(a[2], box[2]) - np.maximum(a[0], box[0]), np.minimum(a[3], box[3]) - np.maximum(a[1], box[1])
        near = ((y_over > 0) & (-x_over < 12)) | ((-y_over < 8) & (x_over > 0.4 * np.minimum(a[2] - a[0], box[2] - box[0])))
        near[i] = False
        others = np.flatnonzero(near & whole)
        if not len(others):
            i += 1
            continue
        first, second = min(i, int(others[0])), max(i, int(others[0]))
        box[:2, first] = np.minimum(box[:2, first], box[:2, second])
        box[2:, first] = np.maximum(box[2:, first], box[2:, second])
        whole[second], into[second], i = False, first, first
    for k in range(n):  # a zone goes into an earlier one, which may have gone on itself
        into[k] = into[into[k]]
    return (np.cumsum(whole) - 1)[into].tolist()


def labelled(rows: DataFrame, key: str, label: Callable[[list, list, list, list], list[int]], name: str) -> DataFrame:
    """rows(doc_id, page, key, x0, y0, x1, y1) with the label of each, by page, boxes in order of (y0, x0, key)."""

    @F.pandas_udf("array<int>")
    def labels(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([label(*(list(c) for c in page)) for page in zip(x0, y0, x1, y1, strict=True)])

    pages = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", key, "x1", "y1"))).alias("b"))
    column = lambda c: F.transform("b", lambda r: r[c])
    pages = pages.withColumn("n", labels(column("x0"), column("y0"), column("x1"), column("y1")))
    return pages.select("doc_id", "page", F.inline(F.zip_with("b", "n", lambda b, n: F.struct(b[key].alias(key), *(b[c].alias(c) for c in ("x0", "y0", "x1", "y1")), n.alias(name)))))


def baseline_bands(spans: DataFrame) -> DataFrame:
    """(doc_id, page, band, n_lines, x0, y0, x1, y1, text): lines that stand on one baseline together, spans by (x0, y0)."""
    box = [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    lines = spans.groupBy("doc_id", "page", "line_id").agg(*box, F.collect_list(F.struct("x0", "y0", "span_no", "text")).alias("s"))
    bands = labelled(lines.drop("s"), "line_id", bands_of, "band").join(lines.select("doc_id", "page", "line_id", "s"), ["doc_id", "page", "line_id"])
    rows = bands.groupBy("doc_id", "page", "band").agg(*box, F.count("*").alias("n_lines"), F.array_sort(F.flatten(F.collect_list("s"))).alias("s"))
    order = Window.partitionBy("doc_id", "page").orderBy(F.round("y0", 1), F.round("x0", 1), "band")
    return rows.select("doc_id", "page", (F.row_number().over(order) - 1).alias("band"), "n_lines", "x0", "y0", "x1", "y1", F.array_join(F.transform("s", lambda x: x.text), "").alias("text"))


def math_components(kinds: DataFrame) -> DataFrame:
    """(doc_id, page, zone, n_lines, x0, y0, x1, y1): pure lines without bullets that lie near each other, two at least; zone is the least line_id."""
    box = "struct<line_id:int,x0:double,y0:double,x1:double,y1:double>"
    pure = kinds.where("pure AND NOT bullet")
    pages = pure.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(F.col("line_id").cast("int").alias("line_id"), "x0", "y0", "x1", "y1"))).alias("b"))

    def near(a: Column, b: Column) -> Column:
        x_over, y_over = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
        return ((y_over > 0) & (-x_over < 18)) | ((-y_over < 12) & (x_over > 0.25 * F.least(a.x1 - a.x0, b.x1 - b.x0))) | ((-y_over < 6) & (-x_over < 18))

    def add(acc: Column, x: Column) -> Column:
        touches = lambda zone: F.exists(zone, lambda m: near(m, x))
        return F.concat(F.filter(acc, lambda z: ~touches(z)), F.array(F.concat(F.flatten(F.filter(acc, touches)), F.array(x))))

    zones = pages.select("doc_id", "page", F.explode(F.aggregate("b", F.expr(f"cast(array() as array<array<{box}>>)"), add)).alias("z")).where(F.size("z") > 1)
    get = lambda f, c: f(F.transform("z", lambda m: m[c])).alias(c)
    return zones.select("doc_id", "page", F.array_min(F.transform("z", lambda m: m.line_id)).alias("zone"), F.size("z").cast("long").alias("n_lines"), get(F.array_min, "x0"), get(F.array_min, "y0"), get(F.array_max, "x1"), get(F.array_max, "y1"))


def zone_closure(zones: DataFrame) -> DataFrame:
    """zones(doc_id, page, zone, x0, y0, x1, y1), display zones and images, merged while their extents are near; zone is the least of the merged."""
    rows = labelled(zones, "zone", closure_of, "n")
    return rows.groupBy("doc_id", "page", "n").agg(F.min("zone").alias("zone"), F.count("*").alias("n_zones"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).drop("n")


def paragraph_styles(spans: DataFrame) -> DataFrame:
    """(doc_id, page, para, size, color, bold, italic, x0, y0, x1, y1) of spans with para; sizes that tie: the larger; colours: the first met."""
    n = F.greatest(F.length("text"), F.lit(1))
    bold, italic = F.col("font").contains("Bold") | F.lower("font").contains("black"), F.col("font").contains("Italic") | F.col("font").contains("Oblique")
    kinds = spans.groupBy("doc_id", "page", "para", "size", "color").agg(
        F.sum(n).alias("n"), F.sum(F.when(bold, n).otherwise(0)).alias("bold"), F.sum(F.when(italic, n).otherwise(0)).alias("italic"), F.min(F.struct("y0", "line_id", "x0", "span_no")).alias("at"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    whole = kinds.groupBy("doc_id", "page", "para").agg(
        F.collect_list(F.struct("size", "color", "n", "at")).alias("k"), *(F.sum(c).alias(c) for c in ("n", "bold", "italic")), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
    total = lambda v, c: F.aggregate(F.filter("k", lambda x: x[c] == v), F.lit(0).cast("long"), lambda acc, x: acc + x.n)
    values = lambda c: F.array_distinct(F.transform("k", lambda x: x[c]))
    size = F.array_max(F.transform(values("size"), lambda v: F.struct(total(v, "size").alias("n"), v.alias("v")))).v
    first = lambda v: F.array_min(F.transform(F.filter("k", lambda x: x.color == v), lambda x: x.at))
    color = F.array_min(F.transform(values("color"), lambda v: F.struct((-total(v, "color")).alias("n"), first(v).alias("at"), v.alias("v")))).v
    return whole.select("doc_id", "page", "para", size.alias("size"), F.lpad(F.hex(color), 6, "0").alias("color"), (F.col("bold") > EMPHASIS * F.col("n")).alias("bold"), (F.col("italic") > EMPHASIS * F.col("n")).alias("italic"), "x0", "y0", "x1", "y1")


def multiline_math(spans: DataFrame) -> DataFrame:
    """(doc_id, page, para, merged) of spans with para and is_math: whether a paragraph's formulas are one structure over several lines."""
    para = Window.partitionBy("doc_id", "page", "para")
    math = lambda f, c: f(F.when(F.col("is_math"), F.col(c))).over(para)
    boxed = spans.withColumns({"mx0": math(F.min, "x0"), "my0": math(F.min, "y0"), "mx1": math(F.max, "x1"), "my1": math(F.max, "y1")})
    wide, high = F.least("x1", "mx1") - F.greatest("x0", "mx0"), F.least("y1", "my1") - F.greatest("y0", "my0")
    over = F.when(~F.col("is_math") & (wide > 0) & (high > 0), wide * high).otherwise(0.0)
    lines = boxed.groupBy("doc_id", "page", "para", "line_id").agg(
        F.sum(over).alias("cover"), (F.max("y1") - F.min("y0")).alias("h"), *(F.first(c).alias(c) for c in ("mx0", "my0", "mx1", "my1")),
        F.array_sort(F.collect_list(F.when(~F.col("is_math"), F.struct("span_no", "x0", "text")))).alias("s"),
    )
    words = F.regexp_extract_all(F.array_join(F.transform("s", lambda x: x.text), ""), F.lit("([A-Za-zÀ-ÿ]{2,})"), F.lit(1))
    prose = F.length(F.array_join(F.filter(words, lambda w: ~F.lower(w).isin(*ZONE_WORDS)), " ")) >= PROSE
    p = lines.withColumn("prose", prose).groupBy("doc_id", "page", "para").agg(
        F.count("*").alias("n"), F.count_if("prose").alias("n_prose"), F.max("h").alias("h"), F.sum("cover").alias("cover"), *(F.max(c).alias(c) for c in ("mx0", "my0", "mx1", "my1"))
    )
    height = F.col("my1") - F.col("my0")
    area = F.greatest(F.lit(1e-6), (F.col("mx1") - F.col("mx0")) * height)
    merged = (F.col("n") >= 2) & F.col("mx0").isNotNull() & (F.col("n_prose") < F.col("n")) & (height > TALLER * F.when(F.col("h") == 0, 1.0).otherwise(F.col("h"))) & (F.col("cover") / area < COVER)
    return p.select("doc_id", "page", "para", F.coalesce(merged, F.lit(False)).alias("merged"))


def stray_glyphs(spans: DataFrame, zone: list[str]) -> DataFrame:
    """(zone columns, n, stray_x0, x0, y0, x1, y1): zones of spans, without the one span that hangs far below the median centre, if it is just one."""
    s = F.array_sort(F.collect_list(F.struct(((F.col("y0") + F.col("y1")) / 2).alias("c"), "x0", "y0", "x1", "y1", "line_id", "span_no"))).alias("s")
    zones = spans.groupBy(*zone).agg(s).withColumn("middle", F.get("s", F.floor(F.size("s") / 2).cast("int")).c)
    below = F.filter("s", lambda x: x.c > F.col("middle") + STRAY)
    zones = zones.withColumn("below", below).withColumn("lone", (F.size("s") >= 5) & (F.size("below") == 1))
    own = zones.withColumn("own", F.when(F.col("lone"), F.filter("s", lambda x: x.c <= F.col("middle") + STRAY)).otherwise(F.col("s")))
    get = lambda f, c: f(F.transform("own", lambda x: x[c])).alias(c)
    return own.select(*zone, F.size("own").cast("long").alias("n"), F.when(F.col("lone"), F.col("below")[0].x0).alias("stray_x0"), get(F.array_min, "x0"), get(F.array_min, "y0"), get(F.array_max, "x1"), get(F.array_max, "y1"))


def crop_masks(spans: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, page, crop, kind, x0, y0, x1, y1): what doesn't belong to a crop but reaches into it, cut to the crop.

    spans have crop (null: none).  Spans with combining accents reach up by 0.6 of their size; thin rules count unless they lie inside the crop's own core.
    """
    page = ["doc_id", "page"]
    top = F.col("y0") - F.when(F.col("text").rlike(r"[\x{0300}-\x{036F}\x{20D0}-\x{20F0}]"), 0.6 * F.col("size")).otherwise(0.0)
    spans = spans.withColumn("top", top)
    crops = spans.where("crop IS NOT NULL").groupBy(*page, "crop").agg(
        (F.min("x0") - 1.2).alias("cx0"), (F.min("y0") - 1.2).alias("cy0"), (F.max("x1") + 1.2).alias("cx1"), (F.max("y1") + 1.2).alias("cy1"),
        (F.min("x0") - 2.5).alias("kx0"), (F.min("top") - 2.5).alias("ky0"), (F.max("x1") + 2.5).alias("kx1"), (F.max("y1") + 2.5).alias("ky1"),
    )
    c = banded(crops, F.col("cy0"), F.col("cy1")).alias("c")
    cut = lambda p, y0: [F.greatest(f"{p}.x0", "cx0").alias("x0"), F.greatest(y0, F.col("cy0")).alias("y0"), F.least(f"{p}.x1", "cx1").alias("x1"), F.least(f"{p}.y1", "cy1").alias("y1")]
    out = lambda pairs, p, kind, y0: pairs.select("c.doc_id", "c.page", "c.crop", F.lit(kind).alias("kind"), *cut(p, y0))
    foreign = out(c.join(banded(spans, F.col("top"), F.col("y1")).alias("s"), same_band("c", "s") & ~F.col("s.crop").eqNullSafe(F.col("c.crop"))), "s", "span", F.col("s.top")).where("x1 - x0 >= 0.2 AND y1 - y0 >= 0.2")
    thick = lambda a, b: F.when(F.col(b) - F.col(a) < 0.6, 0.5).otherwise(0.0)
    r = rules.select(*page, (F.col("x0") - thick("x0", "x1")).alias("x0"), (F.col("y0") - thick("y0", "y1")).alias("y0"), (F.col("x1") + thick("x0", "x1")).alias("x1"), (F.col("y1") + thick("y0", "y1")).alias("y1"))
    r = r.where(F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) <= 4)
    r = banded(r, F.col("y0"), F.col("y1")).alias("r")
    inside = (F.col("r.x0") >= F.col("kx0")) & (F.col("r.x1") <= F.col("kx1")) & (F.col("r.y0") >= F.col("ky0")) & (F.col("r.y1") <= F.col("ky1"))
    lines = out(c.join(r, same_band("c", "r") & ~inside), "r", "rule", F.col("r.y0")).where("x1 > x0 AND y1 > y0")
    return foreign.unionByName(lines)
