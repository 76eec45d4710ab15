"""Mixing sources to target weights by Poisson replication.  DataFrame functions only.

A source of size n (characters) with target weight w, among sources of total size N and total weight W, is to be repeated at the
mean rate  epochs * N * w / (W * n).  Each document inverts the Poisson distribution of its source's rate at a number in
[0, 1) that is hashed from seed and doc_id, so a re-run or a lost executor gives the same counts; it is exploded by its count,
and the copies are put in the global order of another hash.  The cumulative distribution is an array of each source, made once.  A rate above
RATE_STEP is cut into equal parts whose counts, each from a hash of its own, are added (a sum of Poisson variables is one again).

Defined cases: a null source is a source of its own; null texts have size 0; a source of size 0 has rate `epochs`; sources that `weights`
doesn't name have weight 0; a null doc_id is hashed as if it were not there; repeated rows get equal counts, each its own copies; empty tables give
no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

SEED = "mix-1"
EPOCHS = 1.0
#: Without explicit weights a source's weight is its size to this power: large sources are damped, small ones repeated.
TEMPERATURE = 0.7
RATE_STEP = 32.0
#: Hashes are below this.
KEYS = 1 << 52
#: Characters of a partition of mixed documents.
PARTITION = 64 << 20
#: So many entries beyond the mean have the rest of the distribution below the resolution of a double.
TAIL_SIGMAS, TAIL = 12.0, 30.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, hashed from the parts."""
    return hashed(*parts) / F.lit(float(KEYS))


def hashed(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 13), 16, 10).cast("bigint")


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS, scratch: Scratch | None = None) -> DataFrame:
    """(source, size, rate, parts, cdf) of every source of docs(source, text)."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(TEMPERATURE))
    else:
        named = [F.lit(x) for kv in weights.items() for x in kv]
        weight = F.coalesce(F.element_at(F.create_map(*named), F.col("source")), F.lit(0.0)) if named else F.lit(0.0)
    sizes = (scratch or Scratch(docs.sparkSession, "mixing")).written(sizes.withColumn("weight", weight), "sizes")
    all_size, all_weight = sizes.agg(F.sum("size"), F.sum("weight")).first()  # two numbers
    share = F.lit(epochs) * F.lit(all_size) * F.col("weight") / (F.lit(all_weight) * F.col("size")) if all_weight else F.lit(0.0)
    rates = sizes.withColumn("rate", F.coalesce(F.when(F.col("size") == 0, F.lit(epochs)).otherwise(share), F.lit(0.0)))
    rates = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / RATE_STEP)).cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    last = F.ceil(F.col("mean") + TAIL_SIGMAS * F.sqrt("mean") + TAIL).cast("int")
    first = F.exp(-F.col("mean"))

    def add(acc: Column, k: Column) -> Column:
        p = acc.p * F.col("mean") / k
        return F.struct(p.alias("p"), (acc.c + p).alias("c"), F.concat(acc.out, F.array(acc.c + p)).alias("out"))

    cdf = F.aggregate(F.sequence(F.lit(1), last), F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("out")), add, lambda acc: acc.out)
    return rates.select("source", "size", "rate", "parts", cdf.alias("cdf"))


def with_copies(docs: DataFrame, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """docs with `copies`, the count of each row, and `rate`."""
    r = rates.select(F.col("source").alias("_of"), "rate", "parts", "cdf")
    joined = docs.join(r, docs["source"].eqNullSafe(r["_of"]))
    one = lambda j: F.size(F.filter("cdf", lambda c: c <= uniform(F.lit(seed), j, docs["doc_id"])))
    parts = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda acc, j: acc + one(j))
    u = uniform(F.lit(seed), F.lit(1), docs["doc_id"])
    joined = joined.withColumn("_u", u)
    single = F.size(F.filter("cdf", lambda c: c <= F.col("_u")))
    return joined.withColumn("copies", F.when(F.col("parts") == 1, single).otherwise(parts)).drop("_u", "_of", "parts", "cdf")


def mixed(docs: DataFrame, rates: DataFrame, seed: str = SEED, partitions: int | None = None) -> DataFrame:
    """docs, each row as often as its count, in the global order of shuffle_key; `copy` numbers the copies from 1.

    The key is a uniform hash, so equal slices of its range are equal partitions: no pass samples the rows to find the bounds.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = with_copies(docs, rates, seed).where("copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    copies = copies.withColumn("shuffle_key", hashed(F.lit(seed), F.lit("order"), F.col("doc_id"), F.col("copy")))
    slice_of = F.least(F.lit(n - 1), F.floor(F.col("shuffle_key") / float(KEYS) * n)).cast("int")
    return copies.repartitionById(n, slice_of).sortWithinPartitions("shuffle_key", "doc_id", "copy")


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: one row per copy."""
    docs = table(spark, sf_dir, "documents")
    rates = source_rates(docs.select("source", "text"))
    return mixed(docs.select("doc_id", "source"), rates).select("doc_id", "source", "copies", "copy", "shuffle_key")


def mix_documents(docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents repeated by their counts, shuffled globally."""
    rates = source_rates(docs.select("source", "text"))
    total = rates.agg(F.sum(F.col("size") * F.col("rate"))).first()[0] or 0.0  # one number
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PARTITION))
    inner = docs.select("doc_id", "source", F.struct("*").alias("_row"))
    return mixed(inner, rates, partitions=partitions).select([F.col(f"_row.`{c}`") for c in docs.columns])


ORACLE = f"""
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0))::BIGINT AS size FROM documents GROUP BY source),
weighted AS (SELECT source, size, pow(size::DOUBLE, {TEMPERATURE}) AS weight FROM sizes),
rated AS (SELECT source, CASE WHEN size = 0 THEN {EPOCHS} ELSE coalesce({EPOCHS} * (SELECT sum(size) FROM weighted)::DOUBLE * weight / ((SELECT sum(weight) FROM weighted) * size), 0) END AS rate FROM weighted),
split AS (SELECT source, rate, greatest(1, ceil(rate / {RATE_STEP}))::INT AS parts FROM rated),
terms AS (SELECT source, parts, rate / parts AS mean, unnest(range(0, ceil(rate / parts + {TAIL_SIGMAS} * sqrt(rate / parts) + {TAIL})::BIGINT + 1)) AS k FROM split),
masses AS (SELECT source, parts, k, exp(-mean + CASE WHEN k = 0 THEN 0 ELSE k * ln(mean) END - lgamma(k + 1)) AS p FROM terms WHERE mean > 0 OR k = 0),
cdf AS (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM masses),
drawn AS (SELECT rowid_, doc_id, d.source, s.parts, unnest(range(1, s.parts + 1)) AS j FROM (SELECT row_number() OVER () AS rowid_, doc_id, source FROM documents) d JOIN split s ON d.source IS NOT DISTINCT FROM s.source),
numbers AS (SELECT *, ('0x' || substr(md5(concat_ws(':', '{SEED}', j::VARCHAR, doc_id::VARCHAR)), 1, 13))::BIGINT / {float(1 << 52)} AS u FROM drawn),
counts AS (SELECT n.rowid_, n.doc_id, n.source, n.j, count(c.k) AS n FROM numbers n LEFT JOIN cdf c ON n.source IS NOT DISTINCT FROM c.source AND c.c <= n.u GROUP BY ALL),
copies AS (SELECT rowid_, doc_id, source, sum(n)::INT AS copies FROM counts GROUP BY ALL)
SELECT doc_id, source, copies, copy, ('0x' || substr(md5(concat_ws(':', '{SEED}', 'order', doc_id::VARCHAR, copy::VARCHAR)), 1, 13))::BIGINT AS shuffle_key
FROM (SELECT doc_id, source, copies, unnest(range(1, copies + 1))::INT AS copy FROM copies WHERE copies > 0)
"""
