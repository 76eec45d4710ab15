"""Streams give what their batch operators give."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioweave.functions import text as X
from folioweave.operators import units as U
from folioweave.sources import fixtures as S
from folioweave.streaming.events import assemble_stream, pending_batches

SF = "/root/testdata/sf0.001"


def test_assembled_stream_equals_batch(spark, tmp_path):
    source, out = f"file://{tmp_path}/events", f"file://{tmp_path}/out"
    events = S.sse(spark, SF)
    events.write.parquet(source)

    def run():
        stream = spark.readStream.schema(events.schema).parquet(source)
        query = assemble_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True)
        query.start().awaitTermination(180)

    run()
    # Sessions come out once the watermark has passed them: one late row moves it.
    late = spark.createDataFrame([("sentinel", 0, "data: [DONE]")], "request_id string, seq int, line string")
    late.select("request_id", "seq", F.timestamp_seconds(F.lit(4102444800)).alias("ts"), "line").write.mode("append").parquet(source)
    run()
    got = {r.request_id: (r.text, r.finished) for r in spark.read.parquet(out).collect()}
    took = F.max("ts").cast("double") - F.min("ts").cast("double")
    in_time = {r.request_id for r in events.groupBy("request_id").agg(took.alias("took")).where("took <= 150").collect()}
    batch = {r.request_id: (r.text, r.finished and r.request_id in in_time) for r in U.assemble_events(events).collect()}
    assert got == batch


def test_pending_stream_equals_batch(spark, tmp_path):
    units = S.units(spark, SF).where(X.has_text(F.col("template"))).select("key", "template")
    units.write.parquet(f"file://{tmp_path}/units")
    S.memory(spark, SF).write.parquet(f"file://{tmp_path}/memory")
    out = f"file://{tmp_path}/out"
    emit = lambda df, epoch: df.write.mode("append").parquet(out)
    stream = spark.readStream.schema(units.schema).parquet(f"file://{tmp_path}/units")
    stream.writeStream.foreachBatch(pending_batches(f"file://{tmp_path}/memory", emit)).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    expected = {tuple(r) for r in U.pending(units, S.memory(spark, SF)).collect()}
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == expected and expected
