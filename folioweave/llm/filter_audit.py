"""Audit of how filters interact: what each removes, in every order they may be applied in.

Every row gets a mask of the filters it fails.  Per part and label, 2^k signed parity sums (a Walsh-Hadamard transform of the mask counts) are aggregated:
W(s) = sum of n * (-1)^|mask & s|.  They add up over partitions, parts and labels, and are inverted exactly to the number of rows of each mask,
count(m) = 2^-k * sum of W(s) * (-1)^|m & s|.  From these 2^k cells follow all k! orders, step by step, without another look at the rows, and the Shapley
value in closed form: over all orders, a row that fails f filters is removed by each of them in k!/f orders.

Only one row of a group of equal texts passes the filter of repeats, that with the least id.  So rows meet their group's least id by a join on digest and id:
a group of copies is spread by its ids, and equal rows are counted before the join.

Defined cases: a null text is empty; a null part is the empty string; rows with equal ids and texts don't repeat each other, however often they stand in the
table, and each counts; a row without an id never fails the filter of repeats, doesn't make others fail, and has no label; a document with several label rows
has a label if any of them says so; labels of unknown documents count nowhere; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, let, table

#: The audited filters; a filter's place is its bit in the mask.
FILTERS = "ABCDE"
REPEATS = 4
#: Rows without an id are spread over so many keys where ids are joined.
SALTS = 4096


def text_failures(text: Column) -> Column:
    """Mask of filters A to D: few words, few distinct words, many capitals, odd symbols."""

    def mask(words: Column) -> Column:
        n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]", ""))
        fails = (n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals.cast("long") > 3 * F.length(text), text.rlike(r"[#$%&*|]"))
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))

    return let(F.regexp_extract_all(text, F.lit(f"[^{ASCII_SPACE}]+"), F.lit(0)), mask)


def failures(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, mask, n) of documents(doc_id, text, lang) and labels(doc_id, quality, toxic): n rows of a part fail the filters in mask."""
    text = F.coalesce("text", F.lit(""))
    each = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = each.groupBy("doc_id", "digest", "part").agg(F.min("mask").alias("mask"), F.count("*").alias("n"))
    least = each.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    repeats = F.col("doc_id").isNotNull() & F.col("first").isNull()
    rows = rows.join(least, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(repeats, 1 << REPEATS).otherwise(0))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(f"is_{c}") for c in ("quality", "toxic"))).withColumn("salt", F.lit(0))
    salted = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.hash("digest"), F.lit(SALTS))).otherwise(0))
    return salted.join(known, ["doc_id", "salt"], "left").select(
        "part", F.coalesce("is_quality", F.lit(False)).alias("good"), F.coalesce("is_toxic", F.lit(False)).alias("toxic"), "mask", "n"
    )


def sign(a: Column, b: Column) -> Column:
    """(-1)^(number of common bits)."""
    return 1 - 2 * F.pmod(F.bit_count(a.bitwiseAND(b)), F.lit(2))


def parity_sums(masks: DataFrame, k: int) -> DataFrame:
    """(part, every, good, toxic): the 2^k signed parity sums of all rows of a part, of its good and of its toxic ones."""
    size = 1 << k
    by_label = masks.groupBy("part", "good", "toxic").agg(*(F.sum(F.col("n") * sign(F.col("mask"), F.lit(s))).alias(f"w{s}") for s in range(size)))
    chosen = {"every": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    return by_label.groupBy("part").agg(*(F.array(*(F.sum(F.when(c, F.col(f"w{s}")).otherwise(0)) for s in range(size))).alias(name) for name, c in chosen.items()))


def inverted(sums: Column, k: int) -> Column:
    """Rows of each mask, from the parity sums; exact, as the transform is its own inverse up to 2^k."""
    places = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    cell = lambda m: F.aggregate(F.arrays_zip(places.alias("s"), sums.alias("w")), F.lit(0).cast("long"), lambda acc, x: acc + x["w"] * sign(m, x["s"]))
    return F.transform(places, lambda m: F.shiftright(cell(m), k))


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order and step of masks(part string, good boolean, toxic boolean, mask int, n long), whose bit i is the filter filters[i]."""
    k = len(filters)
    cells = parity_sums(masks, k).select("part", *(inverted(F.col(c), k).alias(c) for c in ("every", "good", "toxic")))
    orders = F.split(F.lit(",".join(map("".join, itertools.permutations(filters)))), ",")
    steps = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    places = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    bits = F.create_map(*itertools.chain.from_iterable((F.lit(c), F.lit(1 << i)) for i, c in enumerate(filters)))
    letters = F.transform(F.split("filter_order", ""), lambda c: bits[c])
    steps = steps.withColumn("own", F.element_at(letters, F.col("step"))).withColumn("before", F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a.bitwiseOR(b)))

    def total(counts: str, wanted, weight=lambda m: F.lit(1)) -> Column:  # noqa: ANN001
        return F.aggregate(F.arrays_zip(places.alias("m"), F.col(counts).alias("c")), F.lit(0).cast("long"), lambda acc, x: acc + F.when(wanted(x["m"]), x["c"] * weight(x["m"])).otherwise(0))

    own = lambda m: m.bitwiseAND(F.col("own")) > 0
    early = lambda m: m.bitwiseAND(F.col("before")) > 0
    here = lambda m: own(m) & ~early(m)
    share = lambda m: F.element_at(F.array(*(F.lit(math.factorial(k) // f) for f in range(1, k + 1))), F.bit_count(m))
    return steps.select(
        "part", "filter_order", "step", total("every", lambda m: ~own(m) & ~early(m)).alias("kept"), total("every", here).alias("removed"), total("every", lambda m: own(m) & early(m)).alias("redundant"),
        F.element_at("every", F.col("own") + 1).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), total("every", own, share).alias("shapley"),
    )


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: one row per part, order and step."""
    return audit(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLE = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
least_ AS (SELECT text, min(doc_id) AS least_id FROM d GROUP BY text),
fails AS (SELECT part, {'A': len(words) < 200, 'B': 100 * list_unique(words) < 50 * len(words), 'C': 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text), 'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(doc_id > least_id, false)} AS f,
  EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS toxic FROM d JOIN least_ USING (text)),
cells AS (SELECT part, [c FOR c IN ['A', 'B', 'C', 'D', 'E'] IF CASE c WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END] AS failed, good, toxic, count(*) AS n FROM fails GROUP BY ALL),
orders AS (SELECT '' AS o UNION ALL SELECT o || c FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS u(c) WHERE NOT contains(o, c)),
steps AS (SELECT o AS filter_order, s::INT AS step, o[s] AS own, [o[i] FOR i IN range(1, s)] AS before FROM orders, unnest(range(1, 6)) AS u(s) WHERE len(o) = 5),
seen AS (SELECT *, list_contains(failed, own) AS mine, len(list_intersect(failed, before)) > 0 AS gone FROM steps, cells)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT mine AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mine AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (mine AND gone), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mine AND len(failed) = 1), 0)::BIGINT AS unique_fails, coalesce(sum(n) FILTER (mine AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (mine AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost,
  coalesce(sum(sum(n) FILTER (mine AND NOT gone)) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM seen GROUP BY part, filter_order, step, own
"""
