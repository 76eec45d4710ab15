"""Answers of a translation service, as odd as they come."""

from __future__ import annotations

import json
import random
import re

from pyspark.sql import functions as F

from folioweave.operators import units as U

RAW = [
    '{"0": "a"}', '[Note] {"0": "x"}', '[{"0": "x"}]', "Voici: {\"0\": \"y\"} fin", '{"0": "a"} {"1": "b"}', "[]", "12", "", "no json", '{"0": "a", "1": null, "2": 3}', '{bad}', "{}", '1] [2', '[1] {"0": "z"}', '1, {"0": "w"}', None,
]


def parsed(raw):
    """The object of an answer: of the whole text, or else of what lies between its outer braces."""
    try:
        found = json.loads(raw)
    except ValueError:
        inner = re.search(r"\{.*\}", raw, re.S)
        try:
            found = json.loads(inner[0]) if inner else None
        except ValueError:
            found = None
    return found if isinstance(found, dict) else None


def test_answers_are_parsed_as_by_the_json_library(spark):
    rows = U.parse_responses(spark.createDataFrame(list(enumerate(RAW)), "i int, raw string")).collect()
    for r in rows:
        expected = parsed(r.raw) if r.raw is not None else None
        assert (r.obj is None) == (expected is None), r
        assert expected is None or {k: v if v is None else str(v) for k, v in expected.items()} == r.obj


BLOCKS = "doc_id bigint, ord int, region string, template string, extra string"


def test_units_are_numbered_by_region_and_place(spark):
    pick = random.Random(5)
    rows = []
    for doc in (1, 2, None):
        places = pick.sample([*range(20), *range(990, 1010), *range(5000, 5010)], 35)
        rows += [(doc, o, pick.choice(["body", "header", "footer", "margin", None]), pick.choice(["word", "{{0}}", "", None, "[[b]]x[[/b]]"]), "e") for o in places]
    rank = {"body": 0, "header": 1, "footer": 2}
    texted = [r for r in rows if r[3] in ("word", "[[b]]x[[/b]]")]
    wanted = []
    for doc in (1, 2, None):
        own = sorted((r for r in texted if r[0] == doc), key=lambda r: (rank.get(r[2], 3), r[1]))
        wanted += [(*r, n) for n, r in enumerate(own)]
    given = spark.createDataFrame(rows, BLOCKS)
    for part in (None, F.col("ord") % 1, F.floor(F.col("ord") / 7)):
        assert sorted((tuple(r) for r in U.collect_units(given, part).collect()), key=str) == sorted(wanted, key=str)
    assert U.collect_units(spark.createDataFrame([], BLOCKS)).collect() == []


def test_a_document_of_a_million_units(spark):
    """Numbers are those of the places, and no window is over a document's units."""
    n = 1_000_000
    given = spark.range(n).selectExpr("1L AS doc_id", "cast(id * 3 AS int) AS ord", "if(id % 10 = 0, 'header', 'body') AS region", "'word' AS template")
    made = U.collect_units(given)
    right = F.when(F.col("region") == "body", F.col("ord") / 3 - F.floor(F.col("ord") / 30) - 1).otherwise(F.col("ord") / 30 + n * 9 // 10)
    assert made.where(F.col("unit_no") == right).count() == n
    windows = [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line]
    assert len(windows) == 2 and sum("sum(_n" in w for w in windows) == 1 and sum("_part" in w.split("windowspecdefinition")[1].split(" ASC")[0] for w in windows) == 1
