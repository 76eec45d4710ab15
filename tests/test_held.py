"""Lines that hold their spans, against the operators on tables of spans; and that queries deal out no spans."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioweave.jobs import layout, registry
from folioweave.operators import layout as L
from folioweave.operators import structure as T
from folioweave.sources import layout_fixtures as G

TEXTS = [
    "re im cos\n∑ x÷y\n1. avec\nsi donc · pour", "", None, "\xa0word\u2003 \t\n•  12) a", "mod-arg\n\n" + "aaaaaaa " * 30 + "\nbb cc", "é ü ß\n" * 40, "abcdefg hijklm", "…  !?\x1c \x85 z",
    " ".join(["aaaaaaa", "bbbbbb"] * 3),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    rows = [(i, t, "fr", None if i == 6 else "web", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def same(a, b):
    key = lambda r: tuple(str(r[c]) for c in sorted(r))
    rows = lambda df: sorted((r.asDict() for r in df.collect()), key=key)
    assert rows(a.select(*sorted(b.columns))) == rows(b.select(*sorted(b.columns)))
    assert a.count() > 20


def test_kinds_of_lines_are_those_of_their_spans(spark, folder):
    spans = G.spans(spark, folder)
    fonts = L.body_font(spans)
    assert {r.body_font for r in fonts.collect()} == {"CMMI", "Helvetica"}
    same(G.decoded(spark, folder, True, G.KIND.removesuffix(",text:string"), kinds=True), T.line_kinds(L.with_math(spans, fonts)))


@pytest.mark.parametrize("running", [True, False])
def test_lines_are_those_of_their_spans(spark, folder, running):
    same(layout.lines(spark, folder, running), L.lines_of(G.spans(spark, folder, running)))


def test_pages_are_those_with_words(spark, folder):
    same(G.pages(spark, folder).crossJoin(spark.range(4)), G.body_spans(spark, folder).select("doc_id", "page").distinct().crossJoin(spark.range(4)))


@pytest.mark.parametrize("name", ["line_kind", "running_lines"])
def test_lines_are_made_where_documents_are_read(spark, name):
    """Before, each of these dealt out all words: no exchange may stand below the function that makes the lines."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("ArrowEvalPython")[-1] and "Exchange" not in plan.split("ArrowEvalPython")[-1]


def test_a_union_is_not_taken_for_dealt_out(spark, folder):
    G.pages(spark, folder)
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"


def test_columns_are_made_of_spans_at_edges_only(spark, folder):
    spans = layout.edge_spans(spark, folder)
    assert spans.where("y0 BETWEEN 118 AND 724").count() == 0
    same(spans, G.spans(spark, folder).where("line_id < 0"))


def test_spans_bring_their_paragraphs_without_being_dealt_out(spark, folder):
    from folioweave.jobs import structure

    paras = layout.paragraphs(spark, folder).select("doc_id", "page", "line_id", "para")
    spans = G.spans(spark, folder, False).join(paras, ["doc_id", "page", "line_id"])
    same(structure.para_spans(spark, folder).drop("is_math"), spans)
