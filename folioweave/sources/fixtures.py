"""Inputs for the translation and metrics jobs, derived from the given tables by fixed recipes (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.functions import text as X

from .shared import once
from .tables import table


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("ln", "base"))


LINES_SQL = """doc_lines AS (SELECT doc_id, (i - 1)::INT AS ln, l[i] AS base FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d, unnest(range(1, len(l) + 1)) AS u(i))"""


@once
def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, unit_no, region, template, sig, key, base), one per document line."""
    ln = F.col("ln")
    t = F.when(ln % 2 == 0, F.regexp_replace("base", "^( *)([^ ]+)", "$1[[b]]$2[[/b]]")).otherwise(F.col("base"))
    t = F.when(ln % 3 == 0, F.concat(t, F.lit(" {{0}} et {{1}}"))).otherwise(t)
    t = F.when(ln % 10 == 7, F.lit("{{0}}")).when(ln % 5 == 4, F.concat(t, F.lit(", • item un. • item deux"))).otherwise(t)
    sig = F.when((ln % 3 == 0) | (ln % 10 == 7), F.concat(F.lit("i:"), F.length("base"), F.lit(":"), F.substring(F.md5(F.col("base").cast("binary")), 1, 12))).otherwise("")
    rows = doc_lines(spark, sf_dir).select("doc_id", ln.alias("unit_no"), F.when(ln == 0, "header").otherwise("body").alias("region"), t.alias("template"), sig.alias("sig"), "base")
    return rows.withColumn("key", X.unit_key(F.col("template"), F.col("sig")))


UNITS_SQL = (
    LINES_SQL
    + r""",
u0 AS (SELECT *, CASE WHEN ln % 2 = 0 THEN regexp_replace(base, '^( *)([^ ]+)', '\1[[b]]\2[[/b]]') ELSE base END AS t0 FROM doc_lines),
u1 AS (SELECT *, CASE WHEN ln % 3 = 0 THEN t0 || ' {{0}} et {{1}}' ELSE t0 END AS t1 FROM u0),
u2 AS (SELECT doc_id, ln AS unit_no, CASE WHEN ln = 0 THEN 'header' ELSE 'body' END AS region, base,
  CASE WHEN ln % 10 = 7 THEN '{{0}}' WHEN ln % 5 = 4 THEN t1 || ', • item un. • item deux' ELSE t1 END AS template,
  CASE WHEN ln % 3 = 0 OR ln % 10 = 7 THEN 'i:' || length(base) || ':' || substr(md5(base), 1, 12) ELSE '' END AS sig FROM u1),
units AS (SELECT *, md5(template || chr(1) || sig) AS key, regexp_matches(regexp_replace(template, '\{\{[0-9]+\}\}|\[\[/?[bi]\]\]', '', 'g'), '[\p{L}\p{N}_]') AS texted FROM u2)"""
)


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, value) of the units of every fourth document."""
    known = units(spark, sf_dir).where((F.col("doc_id") % 4 == 0) & X.has_text(F.col("template")))
    return known.groupBy("key").agg(F.concat(F.lit("译文 "), F.min("template")).alias("value"))


MEMORY_SQL = "tm AS (SELECT key, '译文 ' || min(template) AS value FROM units WHERE doc_id % 4 = 0 AND texted GROUP BY key)"


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """units that have text, with a translation `value` that is wrong in one of several ways."""
    u = units(spark, sf_dir).where(X.has_text(F.col("template")))
    t, m, word = F.col("template"), (F.col("doc_id") + F.col("unit_no")) % 8, F.regexp_extract("base", "([^ ]+)", 1)
    swapped = F.replace(F.replace(F.replace(t, F.lit("{{0}}"), F.lit("\u0001")), F.lit("{{1}}"), F.lit("{{0}}")), F.lit("\u0001"), F.lit("{{1}}"))
    value = F.when(m == 0, t).when(m == 1, "译文同一句").when(m == 2, F.regexp_replace(t, X.PLACEHOLDER, "")).when(m == 3, swapped)
    value = value.when(m == 4, F.concat(F.replace(t, F.lit("[[b]]"), F.lit("[['b']]")), F.lit("[[x]]"))).when(m == 5, F.concat(t, t, t))
    value = value.when(m == 6, F.concat(F.lit("译文（"), word, F.lit("） "), t, F.lit(" ( ) ，"))).otherwise(F.concat(F.lit("中 ("), word, F.lit(") 文 "), t))
    return u.withColumn("value", value)


TRANSLATIONS_SQL = r"""words1 AS (SELECT *, (doc_id + unit_no) % 8 AS m, regexp_extract(base, '([^ ]+)', 1) AS w FROM units WHERE texted),
translations AS (SELECT *, CASE m WHEN 0 THEN template WHEN 1 THEN '译文同一句' WHEN 2 THEN regexp_replace(template, '\{\{[0-9]+\}\}', '', 'g')
  WHEN 3 THEN replace(replace(replace(template, '{{0}}', chr(1)), '{{1}}', '{{0}}'), chr(1), '{{1}}') WHEN 4 THEN replace(template, '[[b]]', '[[''b'']]') || '[[x]]'
  WHEN 5 THEN template || template || template WHEN 6 THEN '译文（' || w || '） ' || template || ' ( ) ，' ELSE '中 (' || w || ') 文 ' || template END AS value FROM words1)"""


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events").withColumn("model", F.concat(F.lit("m"), (F.col("user_id") % 30).cast("string")))
    first = e.withColumn("n", F.row_number().over(Window.partitionBy("model").orderBy("ts", "event_id"))).where("n <= 3")
    good = ~F.col("event_type").isin("signup", "error")
    return first.select(
        "model", (F.col("n") - 1).alias("probe_no"), F.when(good, F.col("value")).alias("sec"), F.when(good, F.col("value") / 2).alias("ttft"),
        F.when(good, F.get_json_object("props", "$.k").cast("int") % 4).alias("zh"), F.lit(3).alias("items"), (F.col("event_type") == "signup").alias("timed_out"), (F.col("value") * 1.25).alias("wall"),
        F.when(F.col("event_type") == "error", "http 400").alias("err"),
    )


PROBES_SQL = """ranked AS (SELECT *, 'm' || (user_id % 30) AS model, row_number() OVER (PARTITION BY user_id % 30 ORDER BY ts, event_id) AS n FROM events),
probes AS (SELECT model, n - 1 AS probe_no, CASE WHEN event_type NOT IN ('signup', 'error') THEN value END AS sec, CASE WHEN event_type NOT IN ('signup', 'error') THEN value / 2 END AS ttft,
  CASE WHEN event_type NOT IN ('signup', 'error') THEN json_extract_string(props, '$.k')::INT % 4 END AS zh, 3 AS items, event_type = 'signup' AS timed_out, value * 1.25::DOUBLE AS wall,
  CASE WHEN event_type = 'error' THEN 'http 400' END AS err FROM ranked WHERE n <= 3)"""


def sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, seq, ts, line): each text as server-sent events of 20 characters."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    n = F.ceil(F.length("text") / 20).cast("int")
    piece = F.when(F.col("seq") < n, F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").substr(F.col("seq") * 20 + 1, F.lit(20)).alias("content")).alias("delta"))).alias("choices")))))
    rows = c.select("conv_id", "turn", "text", F.explode(F.sequence(F.lit(0), n)).alias("seq"))
    rows = rows.select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), "seq", F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 600 + F.col("turn") * 200 + F.col("seq")).alias("ts"), piece.alias("line"), "conv_id")
    return rows.where("line IS NOT NULL OR conv_id % 10 <> 0").select("request_id", "seq", "ts", F.coalesce("line", F.lit("data: [DONE]")).alias("line"))
