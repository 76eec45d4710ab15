"""Rounds of asking again, against a plain loop over random documents."""

from __future__ import annotations

import json
import random
import re
from functools import partial

import pytest
from pyspark.sql import functions as F

from folioweave.operators import requeue as Q

SCHEMA = "doc_id bigint, unit_no int, template string, value string"


def writer(spark, folder):
    def write(df, name):
        df.write.parquet(f"{folder}/{name}")  # an existing folder would be an error: every name is written once
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return write


def answer(doc_id, unit_no, n):
    return ("", "same", f"new {unit_no} {n}", None)[(doc_id * 7 + unit_no * 3 + n) % 4]


def ask(asked, batches, n):
    """Answers batch by batch; what is asked is noted, and None stands for the source itself."""
    rows = [r.asDict() for r in batches.collect()]
    asked.append((n, sorted((r["doc_id"], r["unit_no"]) for r in rows)))
    raw = {}
    for r in rows:
        value = answer(r["doc_id"], r["unit_no"], n)
        raw.setdefault((r["doc_id"], r["batch_id"]), {})[str(r["k"])] = r["text"] if value is None else value
    return batches.sparkSession.createDataFrame([(*at, json.dumps(o)) for at, o in raw.items()], "doc_id bigint, batch_id int, raw string")


def plain(s):
    return re.sub(r"\{\{\d+\}\}|\[\[/?[bi]\]\]|\s", "", s)


def loop(units, rounds, limit):
    """units: {unit_no: [template, value, asked]} of one document, changed in place."""

    def suspects():
        bad, seen = set(), {}
        for i in sorted(units):
            source, value, _ = units[i]
            if not value:
                continue
            p, src = plain(value), plain(source)
            if p in seen and plain(units[seen[p]][0]) != src:
                bad |= {i, seen[p]}
            seen.setdefault(p, i)
            if len(src) > 6 and len(p) > len(src) * 1.8 + 12:
                bad.add(i)
        return sorted(bad)[:limit]

    def unchanged():
        return [i for i, (t, v, _) in units.items() if v is not None and t.strip() == v.strip() and len(re.sub("[^A-Za-z]", "", t)) > 3]

    for n in range(rounds):
        if not suspects() and not unchanged():
            return n
        for flagged in (suspects, unchanged):
            for i in flagged():
                got = answer(DOC[0], i, n)
                units[i][1] = (got or units[i][0]) if got is not None else units[i][0].strip()
                units[i][2] += 1
    return rounds


DOC = [0]


def documents(seed):
    pick = random.Random(seed)
    rows = []
    for d in range(12):
        for u in range(pick.randint(1, 9)):
            template = pick.choice(["alpha beta", "gamma {{0}} delta", "[[b]]word[[/b]] more", "x y", "{{0}} ab", "longer line of words"]) + pick.choice(["", f" {u}"])
            value = pick.choice([template, "same", "", None, template * 4, f"value {u}", "own"])
            rows.append((d, u, template, value))
    return rows


@pytest.mark.parametrize(("rounds", "limit"), [(1, 40), (3, 2), (4, None)])
def test_rounds_equal_a_plain_loop(spark, tmp_path, rounds, limit):
    rows = documents(rounds)
    asked = []
    got = Q.settled(spark.createDataFrame(rows, SCHEMA), partial(ask, asked), writer(spark, tmp_path), rounds, limit)
    wanted, ran = [], []
    for d in sorted({r[0] for r in rows}):
        DOC[0] = d
        units = {u: [t, v, 0] for doc, u, t, v in rows if doc == d}
        ran.append(loop(units, rounds, limit))
        wanted += [(d, u, t, v, a) for u, (t, v, a) in units.items()]
    assert sorted(tuple(r) for r in got.collect()) == sorted(wanted, key=lambda r: r[:2])
    assert {n for n, _ in asked} == set(range(max(ran)))


def test_nothing_left_asks_nothing(spark, tmp_path):
    asked = []
    rows = [(1, 0, "alpha", "甲"), (1, 1, "{{0}}", "{{0}}"), (2, 0, "alpha", None)]
    got = Q.settled(spark.createDataFrame(rows, SCHEMA), partial(ask, asked), writer(spark, tmp_path / "a"), 5)
    assert sorted(tuple(r) for r in got.collect()) == [(*r, 0) for r in rows]
    empty = Q.settled(spark.createDataFrame([], SCHEMA), partial(ask, asked), writer(spark, tmp_path / "b"), 5)
    assert empty.collect() == [] and asked == []


def test_failed_batches_leave_the_source(spark, tmp_path):
    """A merged pair that gets no JSON keeps its sources, which the second check then asks for."""
    asked = []

    def broken(batches, n):
        asked.append((n, sorted(r.unit_no for r in batches.collect())))
        return batches.select("doc_id", "batch_id", F.lit("no object").alias("raw")).distinct()

    rows = [(1, 0, "alpha", "same"), (1, 1, "gamma", "same"), (1, 2, "delta", "own")]
    got = Q.settled(spark.createDataFrame(rows, SCHEMA), broken, writer(spark, tmp_path), 2)
    assert sorted((r.unit_no, r.value, r.asked) for r in got.collect()) == [(0, "alpha", 3), (1, "gamma", 3), (2, "own", 0)]
    assert asked == [(0, [0, 1]), (0, [0, 1]), (1, []), (1, [0, 1])]
