"""Token streams: server-sent events put together per request, and units looked up as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.functions import text as X
from folioweave.operators.units import pending
from folioweave.sources.memory import Memory
from folioweave.sources.tables import load_memory

DEADLINE_SECONDS = 150
#: How long a key is remembered by the stream itself.
UNIT_DELAY = "1 hour"


def assemble_stream(events: DataFrame) -> DataFrame:
    """(request_id, text, finished) of a stream of events(request_id, seq, ts, line), once a request has been idle for the deadline.

    The session gap bounds idle time; a request that took longer in total, or has no [DONE], is not finished: its source text stays.
    """
    data = F.when(F.col("line").startswith("data:"), X.strip(F.substring("line", 6, 1 << 30)))
    delta = F.from_json(data, "choices array<struct<delta:struct<content:string>>>")
    rows = events.select("request_id", "seq", "ts", F.coalesce(data == "[DONE]", F.lit(False)).alias("done"), F.when(data != "[DONE]", F.try_element_at(delta.choices, F.lit(1)).delta.content).alias("piece"))
    sessions = rows.withWatermark("ts", f"{DEADLINE_SECONDS} seconds").groupBy("request_id", F.session_window("ts", f"{DEADLINE_SECONDS} seconds"))
    grouped = sessions.agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("seq", "piece")))).alias("pieces"), F.bool_or("done").alias("done"), (F.max("ts").cast("double") - F.min("ts").cast("double")).alias("took"))
    return grouped.select("request_id", F.array_join(F.transform("pieces", lambda p: p.piece), "").alias("text"), (F.col("done") & (F.col("took") <= DEADLINE_SECONDS)).alias("finished"))


def unit_stream(units: DataFrame, delay: str = UNIT_DELAY) -> DataFrame:
    """(key, template, ts) of a stream of units(template, sig, ts) that have text, each key once while it is younger than the delay.

    The keys seen are state over batches, which the watermark clears; a key that comes again later is for the memory to know.  Null texts and signatures are empty.
    """
    template, sig = F.coalesce("template", F.lit("")), F.coalesce("sig", F.lit(""))
    keyed = units.select(X.unit_key(template, sig).alias("key"), template.alias("template"), "ts").where(X.has_text(F.col("template")))
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key"])


def pending_batches(memory_path: str, emit: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: hands emit the keys of a batch of units that the memory at memory_path lacks at that time."""

    def run(batch: DataFrame, epoch: int) -> None:
        emit(pending(batch, load_memory(batch.sparkSession, memory_path)), epoch)

    return run


def translated_batches(memory_path: str, out: str, translate: Callable[[DataFrame], DataFrame], name: str = "units") -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch over unit_stream(): what the memory lacks is written, translated, and added to the memory, once for each batch.

    The pending rows of a batch stand in `out`/epoch=n, as translate(key, template) found them; its (key, value) become a version of the memory that names the
    stream and the batch.  A batch that runs again after its version was listed changes nothing; one that failed before that finds the memory as it was,
    and writes the same rows again.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        memory = Memory(batch.sparkSession, memory_path)
        try:
            source = f"{name}/{epoch}"
            if memory.written_by(source) is not None:
                return
            place = f"{out.rstrip('/')}/epoch={epoch}"
            pending(batch, memory.read()).write.mode("overwrite").parquet(place)
            wanted = batch.sparkSession.read.schema("key string, template string").parquet(place)
            news = translate(wanted).join(wanted.withColumnRenamed("template", "source"), "key").select("key", "value", "source", F.lit(epoch).cast("long").alias("version"))
            memory.upsert(news, source)
        finally:
            memory.close()

    return run
