"""Hand-made cases of the text functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioweave.functions import text as X
from folioweave.operators import units as U
from folioweave.sources import tables


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("source", "out", "expected"),
    [
        ("a {{0}} b {{1}}", "x", "x {{0}} {{1}}"), ("a {{0}}", "{{0}} x {{1}}", "{{0}} x "), ("{{0}} {{1}}", "{{1}} {{0}}", "{{0}} {{1}}"), ("{{0}} {{1}}", "y {{7}} ", "y {{0}} {{1}}"),
        ("a", "[[b]]x", "[[b]]x[[/b]]"), ("a", "x[[/b]]", "[[b]]x[[/b]]"), ("", "{{3}}", "{{3}}"), ("a", "x {{2}}", "x "),
    ],
)
def test_repair(spark, source, out, expected):
    assert value(spark, X.repair(F.lit(source), F.lit(out))) == expected


@pytest.mark.parametrize(("given", "expected"), [("[['b']]x[[ /b ]]", "[[b]]x[[/b]]"), ("a[[x]]b", "ab"), ("[[i]]k[[/i]]", "[[i]]k[[/i]]"), ("{{0}}[[]]", "{{0}}"), ("[[averyverylongtext]]", "[[averyverylongtext]]")])
def test_fix_markers(spark, given, expected):
    assert value(spark, X.fix_markers(F.lit(given))) == expected
    assert value(spark, X.fix_markers(X.fix_markers(F.lit(given)))) == expected


@pytest.mark.parametrize(("given", "expected"), [("中 (E) x", "中 （E） x"), ("a ( ) b", "a b"), ("（（x））", "（x）"), ("x ，y", "x，y"), ("(a) {{0}} (中)", "(a) {{0}} (中)"), ("( {{0}} )", "({{0}})"), ("  a   b ", "a b")])
def test_tidy(spark, given, expected):
    assert value(spark, X.tidy(F.lit(given))) == expected


@pytest.mark.parametrize(("given", "expected"), [("• a", ("a", True)), (" ·  b", ("b", True)), ("c", ("c", False)), ("", ("", False)), (None, ("", False)), ("  ", ("", True))])
def test_strip_bullet(spark, given, expected):
    assert tuple(value(spark, X.strip_bullet(F.lit(given).cast("string")))) == expected


@pytest.mark.parametrize(("given", "expected"), [("a, • b. • c", ["a, ", "• b. ", "• c"]), ("• a", ["", "• a"]), ("a • b", ["a • b"]), ("•• a", ["", "•", "• a"]), ("x", ["x"])])
def test_item_parts(spark, given, expected):
    assert value(spark, X.item_parts(F.lit(given))) == expected


@pytest.mark.parametrize(("given", "expected"), [("ABC+CMMI10", "CMMI"), ("Helvetica-Bold", "Helvetica"), ("12x", "12x"), ("Times", "Times"), ("A+B+Arial", "Arial")])
def test_font_family(spark, given, expected):
    assert value(spark, X.font_family(F.lit(given))) == expected


def test_pack_closes_by_size_and_count(spark):
    sizes = [692, 592, 292, 42, 1492, 2]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "doc_id long, unit_no int, size int")
    assert [r.batch_id for r in U.pack(df).orderBy("unit_no").collect()] == [0, 0, 0, 1, 1, 2]
    many = spark.createDataFrame([(1, i, 0) for i in range(85)], "doc_id long, unit_no int, size int")
    assert [r.n for r in U.pack(many).groupBy("batch_id").agg(F.count("*").alias("n")).orderBy("batch_id").collect()] == [40, 40, 5]


def test_parse_and_align(spark):
    batched = spark.createDataFrame([(1, b, k, k, f"s{k}") for b in range(5) for k in range(2)], "doc_id long, batch_id int, k int, unit_no int, text string")
    raws = ['{"0": "a\\nb", "1": ""}', 'so: {"x": "p", "y": "q"} end', "[{\"0\": 1}]", "broken", '{"1": "only"}']
    responses = spark.createDataFrame([(1, b, r) for b, r in enumerate(raws)], "doc_id long, batch_id int, raw string")
    got = [r["value"] for r in U.align(batched, U.parse_responses(responses)).orderBy("batch_id", "k").collect()]
    assert got == ["a b", "s1", "p", "q", "s0", "s1", "s0", "s1", "s0", "only"]


def test_memory_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    assert tables.load_memory(spark, path).count() == 0
    old = spark.createDataFrame([("k1", "a"), ("k2", "b")], "key string, value string")
    news = spark.createDataFrame([("k2", "c", "s", 1), ("k2", "d", "s", 2), ("k3", "same", "same", 1), ("k4", None, "s", 1)], "key string, value string, source string, version int")
    tables.upsert_memory(old, news).write.parquet(path)
    assert {tuple(r) for r in tables.load_memory(spark, path).collect()} == {("k1", "a"), ("k2", "d")}
