"""The bucketed memory: versions, plans without a shuffle of it, and the stream of units that fills it."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from folioweave.functions import text as X
from folioweave.operators import units as U
from folioweave.sources import fixtures as S
from folioweave.sources.memory import Memory
from folioweave.sources.tables import upsert_memory
from folioweave.streaming.events import translated_batches, unit_stream

SF = "/root/testdata/sf0.001"
NEWS = "key string, value string, source string, version long"


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_versions_stay_readable_and_compaction_changes_nothing(spark, tmp_path):
    memory = Memory(spark, f"file://{tmp_path}/memory", 8)
    assert memory.read().collect() == [] and memory.latest() == 0
    news = lambda rows: spark.createDataFrame(rows, NEWS)
    assert memory.upsert(news([("a", "A", "a", 1), ("b", "B", "b", 1), ("b", "B2", "b", 2), ("c", "c", "c", 1), ("d", None, "d", 1), (None, "N", "n", 1)])) == 1
    assert memory.upsert(news([("a", "A3", "a", 1), ("e", "E", None, 1)]), "job/7") == 2
    assert memory.upsert(news([("a", "lost", "a", 1)]), "job/7") == 2  # the same batch again
    first, second = [("a", "A"), ("b", "B2")], [("a", "A3"), ("b", "B2"), ("e", "E")]
    assert (pairs(memory.read(1)), pairs(memory.read())) == (first, second)
    assert memory.compact() == 3
    memory.upsert(news([("f", "F", "f", 1)]))
    again = Memory(spark, f"file://{tmp_path}/memory", 99)
    assert again.buckets == 8 and again.latest() == 4
    assert [pairs(again.read(v)) for v in (0, 1, 2, 3, 4)] == [[], first, second, second, [*second, ("f", "F")]]
    assert not any("version=1/" in f or "version=2/" in f for f in again.read().inputFiles())  # a whole version makes older ones needless


def test_an_unlisted_version_is_written_over(spark, tmp_path):
    memory = Memory(spark, f"file://{tmp_path}/memory", 4)
    spark.sql(f"INSERT OVERWRITE TABLE {memory.name} PARTITION (version = 1) SELECT 'x' AS key, 'left by a failed writer' AS value")
    assert memory.read().collect() == []
    memory.upsert(spark.createDataFrame([("y", "Y", "y", 1)], NEWS))
    assert pairs(memory.read()) == [("y", "Y")]


def test_the_memory_is_not_shuffled(spark, tmp_path):
    memory = Memory(spark, f"file://{tmp_path}/memory")
    known = S.memory(spark, SF).withColumns({"source": F.lit(None).cast("string"), "version": F.lit(1)})
    memory.upsert(known.where("key < '8'"))
    memory.upsert(known.where("key >= '8'"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        units = spark.createDataFrame(S.units(spark, SF).collect())
        for found in (U.lookup(units, memory.read()), U.pending(units, memory.read())):
            plan = found._jdf.queryExecution().sparkPlan().toString() and found._jdf.queryExecution().executedPlan().toString()
            lines = plan.split("== Initial Plan ==")[-1].split("\n")
            at = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and memory.name in line)
            depth = lambda line: len(re.match(r"[\s:+|-]*", line)[0])
            above, low = [], depth(lines[at])
            for line in reversed(lines[:at]):  # what stands over the scan, up to the join
                if depth(line) < low:
                    low = depth(line)
                    above.append(line)
                    if "Join" in line:
                        break
            assert "Join" in above[-1] and not any("Exchange" in line for line in above), plan
        assert pairs(U.lookup(units, memory.read()).select("doc_id", "unit_no", "state", F.coalesce("value", F.lit("-")))) == pairs(
            U.lookup(units, S.memory(spark, SF)).select("doc_id", "unit_no", "state", F.coalesce("value", F.lit("-")))
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_unit_stream_fills_the_memory_as_the_batch_does(spark, tmp_path):
    source, out = f"file://{tmp_path}/units", f"file://{tmp_path}/out"
    known = S.memory(spark, SF)
    paths = {name: f"file://{tmp_path}/{name}" for name in ("memory", "plain")}
    for path in paths.values():
        memory = Memory(spark, path, 8)
        memory.upsert(known.where("key < '4'").withColumns({"source": F.lit(None).cast("string"), "version": F.lit(1)}))
        memory.close()
    units = S.units(spark, SF).select("doc_id", "template", "sig").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")))
    halves = [units.where("doc_id % 2 = 0"), units.where("doc_id % 3 = 1"), units.where("doc_id % 2 = 1")]  # keys come again in later files
    translate = lambda wanted: wanted.select("key", F.when(F.substring("key", -1, 1) == "0", F.col("template")).otherwise(F.concat(F.lit("译 "), "template")).alias("value"))
    for part in halves:
        part.select("template", "sig", "ts").coalesce(1).write.mode("append").parquet(source)
        stream = unit_stream(spark.readStream.schema("template string, sig string, ts timestamp").parquet(source))
        query = stream.writeStream.foreachBatch(translated_batches(paths["memory"], out, translate))
        query.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(300)
    memory = Memory(spark, paths["memory"])
    wanted = units.where(X.has_text(F.col("template"))).select(X.unit_key(F.col("template"), F.col("sig")).alias("key"), "template").distinct()
    before = known.where("key < '4'")
    rest = U.pending(wanted, before)
    emitted = spark.read.parquet(out)
    assert pairs(emitted.select("key", "template")) == pairs(rest)  # each key once, over all batches
    assert emitted.select("epoch").distinct().count() >= 3
    news = translate(rest).join(rest.withColumnRenamed("template", "source"), "key").withColumn("version", F.lit(1))
    assert pairs(memory.read()) == pairs(upsert_memory(before, news))
    # A batch that runs again changes nothing: neither versions nor rows.
    state = (memory.latest(), pairs(memory.read()), pairs(emitted))
    last = emitted.agg(F.max("epoch")).first()[0]
    translated_batches(paths["memory"], out, translate)(wanted.withColumn("ts", F.current_timestamp()), last)
    again = Memory(spark, paths["memory"])
    assert (again.latest(), pairs(again.read()), pairs(spark.read.parquet(out))) == state
