"""Paragraphs of a page with a box, a formula between prose, and lines side by side."""

from __future__ import annotations

from folioweave.operators import layout as L

LINES = "doc_id long, page int, line_id int, x0 double, y0 double, x1 double, y1 double, text string, extra string"
PLACES = "doc_id long, page int, line_id int, rect_no int, pure boolean"


def line(n, y0, x0=60.0, doc=1, page=0):
    return (doc, page, n, x0, float(y0), x0 + 100, float(y0) + 11, f"line {n}", "x")


def numbered(df):
    return {(r.doc_id, r.page, r.line_id): r.para for r in df.collect()}


def test_paragraphs_break_at_gaps_boxes_and_formulas(spark):
    # 0 and 1 are prose, 2 a formula, 3 prose again; 4 lies in a box beside them, 5 after a gap, 6 in the box after a gap, 7 beside 5
    rows = [line(0, 100), line(1, 115), line(2, 130), line(3, 145), line(4, 120, 300.0), line(5, 165), line(6, 170, 300.0), line(7, 165, 170.0), line(0, 100, page=1)]
    places = [(1, 0, 0, None, False), (1, 0, 1, None, False), (1, 0, 2, None, True), (1, 0, 3, None, False), (1, 0, 4, 7, False), (1, 0, 5, None, False), (1, 0, 6, 7, False), (1, 0, 7, None, False)]
    out = L.paragraphs(spark.createDataFrame(rows, LINES), spark.createDataFrame(places, PLACES))
    assert out.columns == [*(c.split()[0] for c in LINES.split(", ")), "para"]
    page = {k[2]: v for k, v in numbered(out).items() if k[1] == 0}
    assert page == {0: 0, 1: 0, 2: 1, 3: 2, 5: 3, 7: 3, 4: 4, 6: 5}
    assert numbered(out)[(1, 1, 0)] == 0  # a line without a place is prose outside any box


def test_lowest_bottom_of_a_box_holds_across_its_paragraphs(spark):
    tall = (1, 0, 0, 60.0, 100.0, 160.0, 200.0, "tall", "x")
    rows = [tall, line(1, 120), line(2, 204), line(3, 230)]
    places = [(1, 0, 0, None, True), (1, 0, 1, None, False), (1, 0, 2, None, False), (1, 0, 3, None, False)]
    assert [v for _, v in sorted(numbered(L.paragraphs(spark.createDataFrame(rows, LINES), spark.createDataFrame(places, PLACES))).items())] == [0, 1, 1, 2]


def test_paragraphs_without_places_and_without_rows(spark):
    assert numbered(L.paragraphs(spark.createDataFrame([line(0, 100), line(1, 115), line(2, 140)], LINES))) == {(1, 0, 0): 0, (1, 0, 1): 0, (1, 0, 2): 1}
    assert L.paragraphs(spark.createDataFrame([], LINES), spark.createDataFrame([], PLACES)).count() == 0
