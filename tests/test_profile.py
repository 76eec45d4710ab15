"""The profile in one pass against its single operators, on documents with blank spans, ties and missing values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioweave.operators import layout as L

SPANS = "doc_id bigint, page int, line_id int, span_no int, text string, font string, size double, x0 double, y0 double, x1 double, y1 double, extra string"
SIZES = "doc_id bigint, page int, width double, height double"


def spans(seed):
    pick = random.Random(seed)
    rows = []
    for doc in range(40):
        for page in range(pick.randint(1, 4)):
            for line in range(pick.randint(1, 4)):
                y = pick.choice([10.0, 20.5, 300.0])
                for n in range(pick.randint(1, 3)):
                    x = pick.choice([50.0, 60.25, 200.0])
                    text = pick.choice(["word", "ab ", "  ", "", "　", None, "longer one"]) if doc % 5 else pick.choice([" ", None])
                    rows.append((doc, page, line, n, text, pick.choice(["ABCDEF+Foo-Bold", "Foo", "Bar", None]), pick.choice([11.0, 11.04, 9.5, None]), x, y, x + 30, y + 11, "x"))
    return rows


def separately(given, sizes):
    pages = given.groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages"))
    out = pages.join(L.body_font(given), "doc_id", "left").join(L.body_size(given), "doc_id", "left").join(L.page_extent(given, sizes), "doc_id", "left")
    return out.withColumn("body_size", F.coalesce("body_size", F.lit(L.BODY_SIZE)))


@pytest.mark.parametrize("sized", [True, False])
def test_profile_equals_its_operators(spark, sized):
    given = spark.createDataFrame(spans(3), SPANS)
    sizes = spark.createDataFrame([(d, 0, 612.0, 792.0) for d in range(0, 40, 3)], SIZES) if sized else None
    one, many = L.doc_profile(given, sizes), separately(given, sizes)
    assert one.columns == many.columns
    by_id = lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])
    assert by_id(one) == by_id(many)
    assert len(by_id(one)) == 40


def test_spans_are_read_and_shuffled_once(spark, tmp_path):
    spark.createDataFrame(spans(1), SPANS).write.parquet(str(tmp_path / "spans"))
    plan = L.doc_profile(spark.read.parquet(str(tmp_path / "spans")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    lines = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(lines) == 3 and sum("line_id" in line or "page" in line for line in lines) == 1  # the others carry styles
    assert "text" not in next(line for line in lines if "page" in line)


def test_no_spans(spark):
    assert L.doc_profile(spark.createDataFrame([], SPANS)).collect() == []
