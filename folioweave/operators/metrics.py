"""Operational metrics: probes and ranking of models, stale results, expired jobs, quality of translations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioweave.functions import text as X

STALE_SECONDS, JOB_SECONDS, TOP = 15 * 60, 2 * 3600, 6


def probe_stats(probes: DataFrame) -> DataFrame:
    """Per model: counts, sum and mean seconds of its successful probes, the run's wall clock, and whether at least half of them, rounded up, hold Chinese text."""
    good = F.col("sec").isNotNull()
    stats = probes.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(good).alias("n_ok"), F.sum("sec").alias("sum_sec"), F.min("ttft").alias("ttft"), F.bool_or("timed_out").alias("timed_out"), F.max("err").alias("err"), F.max("wall").alias("wall"),
        F.count_if(good & (F.col("zh") >= F.greatest(F.lit(1), F.col("items") - 1))).alias("zh_ok"),
    )
    ok = (F.col("n_ok") > 0) & (F.col("zh_ok") >= F.floor((F.col("n") + 1) / 2)) & ~F.col("timed_out")
    note = F.when(F.col("timed_out"), "timeout").when(F.col("n_ok") == 0, F.col("err")).when(~ok, "failed").otherwise("")
    return stats.withColumns({"sec": F.when(F.col("n_ok") > 0, F.col("sum_sec") / F.col("n_ok")), "ok": ok, "note": note})


def model_ranking(stats: DataFrame) -> DataFrame:
    """(model, ok, place, best, listed): working models first, by mean seconds; the first is the best, the first TOP are listed.

    A handful of models, so one partition is enough.
    """
    w = Window.orderBy((~F.col("ok")).cast("int"), F.coalesce("sec", F.lit(9e9)), "model")
    ranked = stats.select("model", "ok", F.row_number().over(w).alias("place"))
    return ranked.withColumns({"best": F.col("ok") & (F.col("place") == 1), "listed": F.col("ok") & (F.col("place") <= TOP)})


def stale_results(results: DataFrame, now: str) -> DataFrame:
    age = F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp("ts")
    return results.withColumn("stale", age > STALE_SECONDS).withColumn("refresh", F.col("forced") | (F.col("stale") & (F.col("n_results") == 0) & ~F.col("running")))


def expired_jobs(jobs: DataFrame, now: str) -> DataFrame:
    return jobs.where(F.col("done") & (F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp("ts") > JOB_SECONDS))


def quality_report(final: DataFrame) -> DataFrame:
    """Per source and document, with totals (rollup), of final(source, doc_id, state, role, text)."""
    illegal = F.col("text").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]")
    empty = (F.col("role") == "list") & (X.strip(X.strip_bullet(F.col("text")).text) == "")
    leftover = X.without_tokens(F.col("text")).rlike(r"\[\[|\]\]|\{\{|\}\}")
    return final.rollup("source", "doc_id").agg(
        F.count("*").alias("n_units"), F.count_if(illegal).alias("illegal_chars"), F.count_if(empty).alias("empty_items"), F.count_if(leftover).alias("leftover_marks"),
        F.count_if(F.col("state") == "hit").alias("hits"), F.count_if(F.col("role") == "list").alias("list_items"), F.grouping_id().cast("long").alias("level"),
    )


def language_share(rows: DataFrame) -> DataFrame:
    """(doc_id, n, n_chinese) of rows(doc_id, value)."""
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("value").rlike(r"[\x{4e00}-\x{9fff}]")).alias("n_chinese"))


def write_ranking(ranking: DataFrame, path: str, at: str) -> None:
    """Appends a ranking, with the time it was made and its totals, as one version among those at path; readers take the latest `made_at`."""
    whole = Window.partitionBy()  # a handful of models
    totals = {"total": F.count("*").over(whole), "done": F.count_if("ok").over(whole)}
    ranking.withColumns({"made_at": F.lit(at).cast("timestamp"), **totals}).write.mode("append").parquet(path)


def latest_ranking(spark: SparkSession, path: str) -> DataFrame:
    """The ranking at path that was made last."""
    every = spark.read.parquet(path)
    return every.join(F.broadcast(every.agg(F.max("made_at").alias("made_at"))), "made_at")  # one row
