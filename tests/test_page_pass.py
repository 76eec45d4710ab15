"""The pass over pages against the single operators, and against plain loops over random pages."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from folioweave.jobs import structure as J
from folioweave.operators import continuation as C
from folioweave.operators import layout as L
from folioweave.operators import page_pass as P
from folioweave.operators import structure as T
from folioweave.sources import layout_fixtures as G

SF = "/root/testdata/sf0.001"
PAGE = ["doc_id", "page"]
SPAN = "doc_id long, page int, line_id int, span_no int, text string, font string, size double, x0 double, y0 double, x1 double, y1 double"
WORDS = ("x", "y", "=", "αβ", "≤", "cos", "donc", "mot", "prose", "• ", "1) ", ",", " ", "∑", "")


def random_spans(seed: int, pages: int = 40) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for page in range(pages):
        for line in range(r.randint(0, 9)):
            y, x = r.choice((0, 5, 10)) + 11 * line, r.uniform(0, 200)
            for span in range(r.randint(1, 4)):
                w = r.uniform(3, 60)
                rows.append((page % 3, page, line, span, r.choice(WORDS), r.choice(("Helvetica", "ABC+CMMI10", "CMSY7")), 11.0, x, y + r.uniform(-3, 3), x + w, y + r.uniform(6, 14)))
                x += w + r.uniform(-4, 25)
    return rows


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_parts_equal_the_single_operators(spark):
    for spans in (spark.createDataFrame(random_spans(1), SPAN), G.banded_spans(spark, SF)):
        images = G.images(spark, SF).unionByName(spark.createDataFrame([(d, p, 7, 100, 100, 20.0, 15.0, 130.0, 75.0) for d in range(3) for p in range(40)], G.images(spark, SF).schema).where("page % 2 = 0"))
        sizes = spark.createDataFrame([(0, 60.0, 60.0), (1, 595.0, 842.0)], "doc_id long, width double, height double")
        pages = P.page_structure(spans, images, sizes)
        pages = spark.createDataFrame(pages.collect(), pages.schema)
        # lines on one baseline
        math = L.with_math(spans, L.body_font(spans))
        bands = T.labelled(spans.groupBy(*PAGE, "line_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")), "line_id", T.bands_of, "raw")
        places = bands.groupBy(*PAGE, "raw").agg(F.min("y0").alias("y"), F.min("x0").alias("x"))
        order = places.withColumn("band", F.expr("row_number() over (partition by doc_id, page order by round(y, 1), round(x, 1), raw) - 1"))
        of_line = bands.join(order, [*PAGE, "raw"]).select(*PAGE, "line_id", "band")
        assert of_line.select(*PAGE, "band").distinct().count() == T.baseline_bands(spans).count()
        # formulas that go on
        banded = math.join(of_line, [*PAGE, "line_id"]).withColumn("n", F.expr("row_number() over (partition by doc_id, page, band order by x0, y0, span_no, text)").cast("int"))
        merged = C.continuation_merge(banded.withColumn("old", F.col("line_id")).withColumn("line_id", F.col("band").cast("int")).withColumn("span_no", F.col("n")))
        hosts = merged.join(banded.select(*PAGE, F.col("band").cast("int").alias("line_id"), F.col("n").alias("span_no"), F.col("line_id").alias("own"), F.col("span_no").alias("own_no"), "is_math", "text", "x0", "y0", "x1", "y1"), [*PAGE, "line_id", "span_no"])
        assert rows(P.page_spans(pages), *PAGE, "line_id", "span_no", "line", "is_math") == rows(hosts, *PAGE, "own", "own_no", "host", "is_math")
        # kinds of lines
        ordered = hosts.withColumn("ord", F.expr("row_number() over (partition by doc_id, page, host order by x0, y0, span_no, line_id)").cast("int"))
        kinds = T.line_kinds(ordered.select(*PAGE, F.col("host").alias("line_id"), F.col("ord").alias("span_no"), "text", "is_math", "x0", "y0", "x1", "y1"))
        columns = ("x0", "y0", "x1", "y1", "has_math", "pure", "bullet", "math_x0", "math_x1")
        assert rows(P.page_lines(pages), *PAGE, "line", *columns) == rows(kinds, *PAGE, "line_id", *columns)
        # zones of formulas and images, and what they own
        images = L.image_zones(images, sizes)
        parts = T.math_components(kinds)
        box = ("x0", "y0", "x1", "y1")
        zones = parts.select(*PAGE, F.col("zone").cast("int").alias("zone"), *box).unionByName(images.select(*PAGE, (F.col("xref") + P.IMAGES).alias("zone"), *box))
        assert rows(P.page_zones(pages), *PAGE, "zone", "n_zones", *box) == rows(T.zone_closure(zones), *PAGE, "zone", "n_zones", *box)
        inside = L.image_lines(kinds, images).select(*PAGE, "line_id").distinct()
        taken = rows(P.page_lines(pages).where("taken"), *PAGE, "line")
        assert set(rows(inside, *PAGE, "line_id")) <= set(taken)
        assert len(taken) >= parts.agg(F.sum("n_lines")).first()[0]


def test_owners_go_with_merged_zones():
    def span(line, no, text, x0, y0, x1, y1, math=True):
        return {"line_id": line, "span_no": no, "text": text, "symbol": math, "formal": False, "family": "F", "x0": x0, "y0": y0, "x1": x1, "y1": y1}

    formulas = [span(n, 0, "α", 100, 100 + 14 * n, 160, 110 + 14 * n) for n in range(2)] + [span(n, 0, "β", 100, 131 + 14 * n, 160, 141 + 14 * n) for n in range(2, 4)]
    label, words = span(9, 0, "figure", 110, 185, 150, 195, False), span(10, 0, "words beside all that", 300, 300, 500, 310, False)
    image = {"xref": 3, "x0": 90.0, "y0": 188.0, "x1": 190.0, "y1": 260.0}
    found = P.structure_of([*formulas, label, words], [image], "F", 595.0 * 842)
    owned = {z["zone"]: [(o["line_id"], o["span_no"]) for o in z["owned"]] for z in found["zones"]}
    assert owned == {0: [(0, 0), (1, 0)], 2: [(2, 0), (3, 0), (9, 0)]}  # the image met the lower formulas, and its label goes with both
    assert [(z["zone"], z["n_zones"], z["image"]) for z in found["zones"]] == [(0, 1, False), (2, 2, True)]
    assert [k["line"] for k in found["lines"] if not k["taken"]] == [5]
    assert P.structure_of([], [], None, 1.0) == {"lines": [], "zones": [], "spans": []}


def test_spans_are_shuffled_once(spark):
    spark.createDataFrame(random_spans(2), SPAN).write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/pass-spans")
    pages = P.page_structure(spark.read.schema(SPAN).parquet(path), G.images(spark, SF))
    plan = pages._jdf.queryExecution().sparkPlan().toString() and pages._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    wide = [line for line in plan.split("\n") if "Exchange hashpartitioning(doc_id" in line and "page" in line]
    assert plan.count("pass-spans") == 2 and len(wide) <= 4  # spans, pages' families, images; texts go through one of them
    assert sum("partial_collect_list(struct(line_id" in line for line in plan.split("\n")) == 1


def test_pages_with_nulls(spark):
    odd = [(None, 0, 1, 0, "α", "F", 11.0, 0.0, 0.0, 9.0, 9.0), (1, None, 1, 0, None, None, 11.0, 0.0, 0.0, 9.0, 9.0), (1, 0, None, 0, "x", "F", 11.0, 0.0, 0.0, 9.0, 9.0), (1, 0, 2, 0, "x", "F", 11.0, 0.0, 0.0, 9.0, 9.0)] * 2
    pages = P.page_structure(spark.createDataFrame(odd, SPAN), G.images(spark, SF).limit(0))
    assert {(r.doc_id, r.page): len(r.spans) for r in pages.collect()} == {(None, 0): 2, (1, None): 2, (1, 0): 2}
    assert P.page_structure(spark.createDataFrame([], SPAN), G.images(spark, SF).limit(0)).collect() == []


def closure_by_restarts(x0, y0, x1, y1):
    """The rule as it stands: the first near pair merges, and all is looked at again from the start."""
    zones = [[list(b), [i]] for i, b in enumerate(zip(x0, y0, x1, y1, strict=True))]

    def near(a, b):
        x_over, y_over = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        return (y_over > 0 and -x_over < 12) or (-y_over < 8 and x_over > 0.4 * min(a[2] - a[0], b[2] - b[0]))

    while pair := next(((i, j) for i in range(len(zones)) for j in range(i + 1, len(zones)) if near(zones[i][0], zones[j][0])), None):
        b, more = zones.pop(pair[1])
        a, held = zones[pair[0]]
        zones[pair[0]] = [[min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])], held + more]
    label = {i: n for n, zone in enumerate(zones) for i in zone[1]}
    return [label[i] for i in range(len(x0))]


def test_closure_equals_restarts_and_ends_soon():
    r = random.Random(4)
    for _ in range(400):
        n = r.randint(0, 25)
        boxes = sorted((r.uniform(0, 400), r.uniform(0, 300), r.uniform(5, 90), r.uniform(2, 40)) for _ in range(n))
        sides = [[b[1] for b in boxes], [b[0] for b in boxes], [b[1] + b[2] for b in boxes], [b[0] + b[3] for b in boxes]]
        assert T.closure_of(*sides) == closure_by_restarts(*sides)
    many = sorted((r.uniform(0, 9_000), r.uniform(0, 500), r.uniform(5, 20), r.uniform(2, 10)) for _ in range(2_000))
    began = time.time()
    T.closure_of([b[1] for b in many], [b[0] for b in many], [b[1] + b[2] for b in many], [b[0] + b[3] for b in many])
    assert time.time() - began < 1.5


def plain_continuation(lines, body):
    """Lines (host, [(text, math, x0, y0, x1, y1)]) by the rule in words: a formula joins the line above it, else the one below, that holds it in its own formula."""
    words = set(T.FORMULA_WORDS)

    def emptied(text):
        text = "".join(c for c in text.lower() if "a" <= c <= "z" or "à" <= c <= "ÿ")
        while True:
            left = text
            for w in T.longest_first(tuple(words)):
                left = left.replace(w, "")
            if left == text:
                return not left
            text = left

    def kind(spans):
        maths = [s for s in spans if s[1]]
        real = [s for s in maths if not s[0].strip() or any(c not in C.PUNCTUATION for c in s[0].strip())]
        lead = "".join(s[0] for s in spans).lstrip()
        rest = "".join(s[0] for s in spans if not s[1]).strip().lstrip("•·▪‣◦").strip()
        return bool(maths) and (len(rest) < 3 or emptied(rest)), lead == "" or lead[0] in "•·▪‣◦" or lead.startswith("1) "), (min(s[2] for s in real), max(s[4] for s in real)) if real else None

    box = lambda spans: (min(s[2] for s in spans), min(s[3] for s in spans), max(s[4] for s in spans), max(s[5] for s in spans))
    i = 0
    while i < len(lines):
        pure, bullet, _ = kind(lines[i][1])
        own = box(lines[i][1])
        goal = None
        for t in (i - 1, i + 1) if pure and not bullet else ():
            if not 0 <= t < len(lines):
                continue
            _, listed, formula = kind(lines[t][1])
            other = box(lines[t][1])
            if formula is None or min(own[2], formula[1]) - max(own[0], formula[0]) <= 0.8 * (own[2] - own[0]):
                continue
            if any(not s[1] and any(c.isascii() and c.isalpha() or "À" <= c <= "ÿ" for c in s[0]) and min(own[2], s[4]) - max(own[0], s[2]) > 3 for s in lines[t][1]):
                continue
            if (max(own[1] - other[3], other[1] - own[3]) > 12) if listed else (min(own[3], other[3]) - max(own[1], other[1]) <= 1):
                continue
            goal = t
            break
        if goal is None:
            i += 1
            continue
        lines[goal] = (lines[goal][0], sorted(lines[goal][1] + lines[i][1], key=lambda s: (s[2], s[3])))
        del lines[i]
        i = max(0, i - 1)
    return lines


def test_continuations_equal_a_plain_loop(spark):
    made = [r for r in random_spans(6, 400) if r[4] not in ("", " ")]
    math = L.with_math(spark.createDataFrame(made, SPAN), spark.createDataFrame([(d, "Helvetica") for d in range(3)], "doc_id long, body_font string"))
    found = {(r.doc_id, r.page, r.line_id, r.span_no): r.host for r in C.continuation_merge(math).collect()}
    pages: dict = {}
    for r in math.collect():
        pages.setdefault((r.doc_id, r.page), {}).setdefault(r.line_id, []).append((r.text, r.is_math, r.x0, r.y0, r.x1, r.y1, r.span_no, r.line_id))
    wanted = {}
    for page, lines in pages.items():
        ordered = sorted(((n, sorted(s, key=lambda x: x[6])) for n, s in lines.items()), key=lambda k: (min(s[3] for s in k[1]), min(s[2] for s in k[1]), k[0]))
        wanted |= {(*page, s[7], s[6]): host for host, spans in plain_continuation(ordered, "Helvetica") for s in spans}
    assert found == wanted
    assert sum(k[2] != host for k, host in found.items()) > 20


def test_registered_pass_covers_every_page(spark):
    pages = J.page_structure(spark, SF)
    assert pages.select("part").distinct().count() == 3
    body = G.spans(spark, SF, False)
    assert pages.where("part = 'span'").count() == body.count()


def test_banded_joins_keep_their_rows_and_meet_few_candidates(spark):
    r = random.Random(9)
    n = 5_000
    spans = [(0, 0, i, 0, "abc", "F", 11.0, x := r.uniform(0, 2_000), y := r.uniform(-60, 21_000) if i % 2 else r.uniform(100, 9_000), x + r.uniform(5, 30), y + r.uniform(5, 14)) for i in range(n)]
    rules = [(0, 0, x := r.uniform(0, 2_000), y := r.uniform(-60, 21_000) if i % 2 else r.uniform(100, 9_000), x + r.uniform(5, 40), y + r.uniform(0, 3)) for i in range(n)]
    s, u = spark.createDataFrame(spans, SPAN), spark.createDataFrame(rules, "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    found = {x.line_id for x in L.fraction_words(s, u).collect()}
    wanted = set()
    for _, _, i, _, _, _, _, x0, y0, x1, y1 in spans:
        w = x1 - x0
        if any(v1 - v0 <= 2.6 and u1 - u0 <= 3 * max(w, 8) and min(x1, u1) - max(x0, u0) >= 0.7 * w and (-1.5 <= v0 - y1 <= 4 or -1.5 <= y0 - v1 <= 4) for _, _, u0, v0, u1, v1 in rules):
            wanted.add(i)
    assert found == wanted and len(found) > 20
    a, b = (L.banded(df, F.col("y0"), F.col("y1")).groupBy("_band").count().withColumnRenamed("count", c) for df, c in ((s, "a"), (u, "b")))
    assert a.join(b, "_band").agg(F.sum(F.col("a") * F.col("b"))).first()[0] < n * n / 40  # of 25 million pairs on the page
