"""Formulas that go on in the line above or below."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from folioweave.operators import continuation as C
from folioweave.operators import structure as T

SPANS = "doc_id long, page int, line_id int, span_no int, text string, is_math boolean, x0 double, y0 double, x1 double, y1 double, extra string"


def span(line, no, text, math, x0, x1, y0, h=10, page=0):
    return (1, page, line, no, text, math, float(x0), float(y0), float(x1), float(y0 + h), "x")


def hosts(spark, rows):
    out = C.continuation_merge(spark.createDataFrame(rows, SPANS)).collect()
    assert len(out) == len(rows)
    return {(r.page, r.line_id): r.host for r in out}


def test_cases_and_fractions_join_their_line(spark):
    bullet = [span(0, 0, "• ", False, 50, 55, 100), span(0, 1, "f(x) = ", True, 60, 200, 100), span(0, 2, "where x is real", False, 210, 300, 100)]
    cases = [span(1, 0, "−1", True, 100, 150, 118), span(2, 0, "+1 si", True, 100, 160, 138)]  # each within 12 points of what came before
    assert hosts(spark, bullet + cases) == {(0, 0): 0, (0, 1): 0, (0, 2): 0}
    host, part = [span(1, 0, "so ", False, 20, 40, 105), span(1, 1, "a/b + c", True, 60, 200, 105)], span(0, 0, "x²", True, 80, 120, 98)
    assert hosts(spark, [*host, part]) == {(0, 1): 1, (0, 0): 1}  # the line below, since none is above


def test_what_stays_a_line_of_its_own(spark):
    text = [span(0, 0, "so ", False, 20, 40, 100), span(0, 1, "a + b", True, 60, 200, 100)]
    apart, wide, under_words = span(1, 0, "x", True, 80, 120, 112), span(1, 0, "x", True, 180, 240, 105), span(1, 0, "x", True, 20, 50, 105)
    for other in (apart, wide, under_words):  # no overlap in height; beyond the formula; where the words are
        assert hosts(spark, [*text, other]) == {(0, 0): 0, (0, 1): 1}
    across = [span(0, 0, "a", True, 20, 40, 100), span(0, 1, "words", False, 50, 90, 100), span(0, 2, "b", True, 100, 200, 100)]
    assert hosts(spark, [*across, span(1, 0, "x", True, 60, 110, 105)]) == {(0, 0): 0, (0, 1): 1}
    assert hosts(spark, [span(0, 0, "1. a = b", True, 20, 200, 100), span(1, 0, "2. c", True, 30, 90, 112)]) == {(0, 0): 0, (0, 1): 1}  # numbered lines stay
    stop = [span(0, 0, "words", False, 20, 90, 100), span(0, 1, ".", True, 92, 95, 100)]
    assert hosts(spark, [*stop, span(1, 0, "x", True, 92, 94, 105)]) == {(0, 0): 0, (0, 1): 1}  # a full stop is no formula


def test_pages_apart_nulls_and_no_rows(spark):
    rows = [span(0, 0, None, True, 20, 200, 100), span(1, 0, "x", True, 30, 90, 105), span(1, 0, "x", True, 30, 90, 105), span(0, 0, "x", True, 30, 90, 105, page=1)]
    assert hosts(spark, rows) == {(0, 0): 0, (0, 1): 0, (1, 0): 0}
    assert C.continuation_merge(spark.createDataFrame([], SPANS)).count() == 0


def test_formula_words_are_taken_out_as_in_lines(spark):
    """csios is cos around si, so it goes in two passes; of sisinn an n is left, since sin goes before si."""
    texts = [" ".join(p) for p in itertools.permutations(("avec", "cos", "Re", "si", "ln"), 3)] + ["cos(1) = 2", "cosy", "csios", "sisinn", "", "Été", "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.formula_only(F.col("t")).alias("only")).collect()
    assert {r.t: r.only for r in rows} == {t: C.only_formula_words(t) for t in texts}
    assert C.only_formula_words("csios") and not C.only_formula_words("sisinn") and not C.only_formula_words("cosy")
