"""Translations that look wrong are asked for again, round by round, until nothing is left to ask."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import units as U

UNIT = ["doc_id", "unit_no"]

#: Answers to batches(doc_id, batch_id, k, unit_no, text) of a round: responses(doc_id, batch_id, raw).
Ask = Callable[[DataFrame, int], DataFrame]
#: Stores a table under a name, and gives it back as it is read from there.
Write = Callable[[DataFrame, str], DataFrame]


def alone(wanted: DataFrame) -> DataFrame:
    """Each of wanted(doc_id, unit_no, text) in a batch of its own, so that no neighbour can flow into it."""
    return wanted.select("doc_id", F.col("unit_no").cast("int").alias("batch_id"), F.lit(0).alias("k"), F.col("unit_no").cast("int").alias("unit_no"), "text")


def together(wanted: DataFrame) -> DataFrame:
    """wanted(doc_id, unit_no, text) in greedy batches."""
    packs = U.pack(wanted.select(*UNIT, F.length("text").alias("size")))
    return packs.join(wanted.select(*UNIT, "text"), UNIT)


def settled(out: DataFrame, ask: Ask, write: Write, rounds: int = 3, limit: int | None = U.REQUEUE) -> DataFrame:
    """(doc_id, unit_no, template, value, asked) of out(doc_id, unit_no, template, value), asked counting how often a unit was asked for again.

    A round asks for merged suspects one by one (the lowest `limit` of each document), then for what is untranslated after that, in batches.  It ends when no document
    has either, or after `rounds` rounds: a service may never answer well.  With one round this is the rule's own check.  A failed batch or an empty answer leaves
    the source, as the first translation would.

    What goes from round to round is a few bytes of each unit (checks) of the documents in which something is left; texts are brought to the units that are asked for, and
    the last answers to all units at the end.  Checks, batches and answers of each round are written: a lost executor costs a re-read, and no answer is asked for twice.
    Units are unique by (doc_id, unit_no); a null value is never asked for and stays.  Answers to units that weren't asked for are ignored.
    """
    given = write(out.select(*UNIT, "template", "value"), "given")
    state, answers = write(U.checks(given), "checks"), []
    for n in range(rounds):
        of_round = U.lowest(U.merged(state), limit).withColumn("merged", F.lit(True)).unionByName(state.where("unchanged").select(*UNIT, F.lit(False).alias("merged")))
        open_units = write(of_round, f"open-{n}")
        if open_units.isEmpty():
            break
        state = state.join(open_units.select("doc_id").distinct(), "doc_id", "left_semi")
        for name, batch in (("merged", alone), ("unchanged", together)):
            suspects = open_units.where("merged").select(*UNIT) if name == "merged" else state.where("unchanged").select(*UNIT)
            wanted = given.select(*UNIT, F.col("template").alias("text")).join(suspects, UNIT)
            batches = write(batch(wanted), f"{name}-batches-{n}")
            got = U.align(batches, U.parse_responses(ask(batches, n))).select(*UNIT, "value")
            fresh = write(got, f"{name}-answers-{n}")
            answers.append(fresh.withColumn("at", F.lit(len(answers))))
            if (n, name) == (rounds - 1, "unchanged"):
                break  # nothing looks at the checks after the last answers
            new = U.checks(batches.select(*UNIT, F.col("text").alias("template")).join(fresh, UNIT))
            both = state.join(new.select(*UNIT, F.struct("src", "p", "long", "unchanged").alias("new")), UNIT, "left")
            kept = F.coalesce("new", F.struct("src", "p", "long", "unchanged"))
            state = write(both.select(*UNIT, kept.alias("now")).select(*UNIT, "now.*"), f"{name}-checks-{n}")
    if not answers:
        return given.withColumn("asked", F.lit(0))
    last = functools.reduce(DataFrame.unionByName, answers).groupBy(*UNIT).agg(F.max_by("value", "at").alias("answer"), F.count("*").cast("int").alias("times"))
    return given.join(last, UNIT, "left").select(*UNIT, "template", F.coalesce("answer", "value").alias("value"), F.coalesce("times", F.lit(0)).alias("asked"))
