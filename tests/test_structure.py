"""Page structure that the tables don't hold, and merges against a plain restart-after-each-merge loop."""

from __future__ import annotations

import random

from folioweave.operators import structure as T


def restarted(boxes, near, union):
    """Merges the first near pair and starts again, until there is none."""
    zones = [(b, {i}) for i, b in enumerate(boxes)]
    while True:
        found = [(i, j) for i in range(len(zones)) for j in range(i + 1, len(zones)) if near(zones[i][0], zones[j][0])]
        if not found:
            return {frozenset(m) for _, m in zones}
        i, j = found[0]
        zones[i] = (union(zones[i][0], zones[j][0]), zones[i][1] | zones[j][1])
        del zones[j]


def groups(labels):
    return {frozenset(i for i, n in enumerate(labels) if n == k) for k in labels}


def random_boxes(r, n):
    boxes = []
    for _ in range(n):
        x, y = r.randint(0, 300), r.randint(0, 300)
        boxes.append((float(x), float(y), float(x + r.randint(1, 90)), float(y + r.randint(1, 40))))
    return sorted(boxes, key=lambda b: (b[1], b[0]))


def test_zone_closure_equals_a_restarting_loop():
    r = random.Random(1)
    union = lambda a, b: (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))

    def near(a, b):
        xo, yo = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        return (yo > 0 and xo > -12) or (yo > -8 and xo > 0.4 * min(a[2] - a[0], b[2] - b[0]))

    for _ in range(200):
        boxes = random_boxes(r, r.randint(0, 12))
        assert groups(T.closure_of(*(list(c) for c in zip(*boxes, strict=True)) if boxes else ([], [], [], []))) == restarted(boxes, near, union)


def test_bands_equal_a_restarting_loop():
    r = random.Random(2)
    for _ in range(300):
        boxes = random_boxes(r, r.randint(1, 25))
        bands = []  # extent, tallest, members
        for i, (_, y0, _, y1) in enumerate(boxes):
            if bands:
                (e0, e1), (t0, t1), m = bands[-1]
                if t0 - 0.15 * (t1 - t0) <= (y0 + y1) / 2 <= t1 + 0.15 * (t1 - t0):
                    bands[-1] = ((min(e0, y0), max(e1, y1)), (y0, y1) if y1 - y0 > t1 - t0 else (t0, t1), m | {i})
                    continue
            bands.append(((y0, y1), (y0, y1), {i}))
        merged = True
        while merged:
            merged = False
            for k in range(len(bands) - 1):
                (ea, ta, ma), (eb, tb, mb) = bands[k], bands[k + 1]
                holds = lambda t, e: t[0] - 0.15 * (t[1] - t[0]) <= (e[0] + e[1]) / 2 <= t[1] + 0.15 * (t[1] - t[0])
                if holds(ta, eb) or holds(tb, ea):
                    bands[k : k + 2] = [((min(ea[0], eb[0]), max(ea[1], eb[1])), ta if ta[1] - ta[0] >= tb[1] - tb[0] else tb, ma | mb)]
                    merged = True
                    break
        assert groups(T.bands_of(*(list(c) for c in zip(*boxes, strict=True)))) == {frozenset(m) for _, _, m in bands}


def test_zones_keep_their_least_number(spark):
    rows = [(1, 0, 7, 0.0, 0.0, 10.0, 10.0), (1, 0, 3, 15.0, 5.0, 30.0, 9.0), (1, 0, 9, 200.0, 200.0, 210.0, 210.0), (1, 1, 1, 0.0, 0.0, 1.0, 1.0)]
    df = T.zone_closure(spark.createDataFrame(rows, "doc_id long, page int, zone int, x0 double, y0 double, x1 double, y1 double"))
    assert sorted((r.page, r.zone, r.n_zones, r.x1) for r in df.collect()) == [(0, 3, 2, 30.0), (0, 9, 1, 210.0), (1, 1, 1, 1.0)]


def test_formula_words(spark):
    texts = ["", "Re(z) = 1", "sisinn", "et", "arccos x", "lim", "silnn", None, "cos(3) ou Im"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    rows = df.select("i", T.formula_only(df.t).alias("wide"), T.formula_only(df.t, T.ZONE_WORDS).alias("zone")).orderBy("i").collect()
    assert [r.wide for r in rows][:7] == [True, False, False, False, False, False, False] and rows[8].wide and not rows[8].zone
    assert T.FORMULA_WORDS and rows[5].zone and not rows[4].zone


def test_kinds_of_lines(spark):
    spans = [(1, "f(x)", True, 50.0), (1, ", ", True, 90.0), (2, "• ", False, 50.0), (2, "x", True, 60.0), (3, "word word", False, 50.0), (3, "y", True, 99.0), (4, " ", False, 50.0), (5, "12) ", False, 50.0), (6, "cos", False, 50.0), (6, "z", True, 70.0)]
    df = spark.createDataFrame([(1, 0, line, i, t, m, x, 10.0 * line, x + 5, 10.0 * line + 8) for i, (line, t, m, x) in enumerate(spans)], "doc_id long, page int, line_id int, span_no int, text string, is_math boolean, x0 double, y0 double, x1 double, y1 double")
    rows = {r.line_id: r for r in T.line_kinds(df).collect()}
    assert {k: (r.has_math, r.pure, r.bullet) for k, r in rows.items()} == {1: (True, True, False), 2: (True, True, True), 3: (True, False, False), 4: (False, False, True), 5: (False, False, True), 6: (True, True, False)}
    assert (rows[1].math_x0, rows[1].math_x1) == (50.0, 55.0) and rows[4].math_x0 is None


def test_crop_masks(spark):
    spans = [(1, 5, "x", 0.0, 10.0), (1, None, "a", 10.5, 20.0), (1, None, "é", 2.0, 8.0), (1, 6, "y", 40.0, 50.0)]
    heights = [(100.0, 110.0), (100.0, 110.0), (114.0, 124.0), (100.0, 110.0)]
    df = spark.createDataFrame([(1, 0, crop, t, 10.0, x0, y0, x1, y1) for (_, crop, t, x0, x1), (y0, y1) in zip(spans, heights, strict=True)], "doc_id long, page int, crop int, text string, size double, x0 double, y0 double, x1 double, y1 double")
    rules = spark.createDataFrame([(1, 0, 2.0, 111.0, 8.0, 111.2), (1, 0, -9.0, 105.0, 30.0, 105.1), (1, 0, 0.0, 90.0, 60.0, 120.0)], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    found = sorted((r.crop, r.kind, r.x0, r.y0, r.x1, r.y1) for r in T.crop_masks(df, rules).collect())
    assert [f[:2] for f in found] == [(5, "rule"), (5, "span"), (5, "span")]
    assert found[1][2:] == (2.0, 108.0, 8.0, 111.2) and found[2][2:] == (10.5, 100.0, 11.2, 110.0)
