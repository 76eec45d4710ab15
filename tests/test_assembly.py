"""Documents from spans alone: one made by hand, whose HTML is known, and the fixtures, of which no word may get lost."""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import functions as F

from folioweave.jobs import assembly as J
from folioweave.operators import assembly as A
from folioweave.operators import layout as L
from folioweave.operators import page_pass as Q
from folioweave.sources import layout_fixtures as G
from folioweave.sources.tables import LAYOUT

SF = "/root/testdata/sf0.001"
PLAIN, MATH = "Helvetica", "ABC+CMMI10"


def line(page, number, y, *pieces, x=80.0, size=11.0, doc=1):
    """Spans of a line: (text, font), each as wide as its characters."""
    rows = []
    for n, (text, font) in enumerate(pieces):
        rows.append((doc, page, number, n, text, font, size, 0, x, float(y), x + 5.0 * len(text), float(y) + 12))
        x += 5.0 * len(text)
    return rows


def by_hand(spark):
    spans = [
        *line(0, 0, 30, ("Course notes", PLAIN)), *line(0, 1, 150, ("Let ", PLAIN), ("α+β", MATH), (" be a real number.", PLAIN)), *line(0, 2, 166, ("It goes on here.", PLAIN)),
        *line(0, 3, 200, ("α=β", MATH), x=200.0), *line(0, 4, 214, ("β=γ", MATH), x=200.0), *line(0, 5, 260, ("• first item", PLAIN)), *line(0, 6, 276, ("• second item", PLAIN)),
        *line(0, 7, 330, ("In a box <now>", PLAIN)), *line(0, 8, 800, ("1 / 2", PLAIN), x=280.0),
        *line(1, 0, 30, ("Course notes", PLAIN)), *line(1, 1, 150, ("The end.", PLAIN)), *line(1, 2, 320, ("label in the figure", PLAIN), x=110.0), *line(1, 8, 800, ("2 / 2", PLAIN), x=280.0),
    ]
    table = lambda rows, name: spark.createDataFrame(rows, LAYOUT[name].replace("bigint", "long"))
    rects = [(1, 0, 0, 60.0, 320.0, 540.0, 350.0, "CC0000"), (1, 0, 1, 62.0, 322.0, 538.0, 348.0, "FFF5F5")]
    return table(spans, "spans"), table(rects, "rects"), table([], "rules"), table([(1, 1, 5, 640, 480, 100.0, 300.0, 260.0, 400.0)], "images"), table([(1, 0, 600.0, 842.0), (1, 1, 300.0, 300.0)], "page_sizes")


def test_a_document_by_hand(spark):
    picture = lambda doc, page, *box: F.concat_ws("/", doc, page, *(c.cast("int") for c in box))
    found = {r.doc_id: r.html for r in J.layout_to_html(*by_hand(spark), picture=picture).collect()}
    assert list(found) == [1]
    body = found[1].split("<body>")[1].removesuffix("</body></html>")
    assert body == (
        '<div class="page" style="width:21.2cm;padding-left:2.82cm;padding-right:10.41cm"><div class="runhead"><span>Course notes</span><span></span></div>\n'
        r"<p >Let \(\alpha+\beta\) be a real number. It goes on here.</p>"
        '<div class="disp"><img class="mmath" src="data:image/png;base64,1/0/200/200/215/226" style="height:34.66px"></div>'
        '<ul class="list"><li>first item</li><li>second item</li></ul>'
        '<div class="box" style="border:1px solid #CC0000;background:#FFF5F5;"><p style="">In a box &lt;now&gt;</p></div>'
        '<div class="pbreak"></div>'
        "<p >The end.</p>"
        '<div class="disp"><img class="mmath" src="data:image/png;base64,1/1/100/300/260/400" style="height:133.30px"></div>'
        '\n<div class="runfoot"><span></span><span></span><span></span></div></div>'
    )


def test_no_tables_no_documents(spark):
    assert J.layout_to_html(*(df.limit(0) for df in by_hand(spark))).collect() == []


def test_no_word_of_the_fixtures_gets_lost(spark):
    found = {r.doc_id: r.html for r in J.layout_html(spark, SF).collect()}
    spans = G.spans(spark, SF)
    pages = J.written(Q.page_structure(spans, G.images(spark, SF), L.document_sizes(G.page_sizes(spark, SF))), "pages")
    placed = A.placed_spans(spans, pages)
    own = A.own_lines(placed, pages)
    body = L.body_lines(own, L.running_lines(own, L.repeated_edge_lines(own)))
    wanted: dict = {}
    for r in placed.join(body.select("doc_id", "page", "line_id"), ["doc_id", "page", "line_id"]).collect():
        wanted.setdefault(r.doc_id, (Counter(), Counter()))[r.is_math].update(re.sub("[•·▪‣◦]", " ", r.text).split())
    zones = {r.doc_id: r.n for r in Q.page_zones(pages).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(found) == {r.doc_id for r in spans.select("doc_id").distinct().collect()}
    pictures = 0
    for doc_id, text in found.items():
        assert "{{" not in text and "[[" not in text and "null" not in text
        inner = text.split("<body>")[1]
        inner = re.sub(r'<div class="run(head|foot)">.*?</div>', "", inner)
        shown = Counter(re.sub("[•·▪‣◦]", " ", html.unescape(re.sub(r"\\\(.*?\\\)|<[^>]*>", " ", inner))).split())
        words, maths = wanted.get(doc_id, (Counter(), Counter()))
        # Formulas may hold words beside them (no letters, formula words), and join what stands next to them in the text.
        left = Counter("".join(sorted("".join((words - shown).elements()))))
        more = Counter("".join(sorted("".join((shown - words).elements()))))
        assert not more - left - Counter("".join(maths.elements())), (doc_id, more - left)
        assert inner.count("<img") >= zones.get(doc_id, 0)
        pictures += zones.get(doc_id, 0)
    assert pictures > 20
