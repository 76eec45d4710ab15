"""Translation units: collecting, keys, memory lookup, batches, prompts, checks, write-back.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioweave.functions import text as X

BATCH_CHARS, BATCH_ITEMS, ITEM_EXTRA = 1400, 40, 8
GLOSSARY_TERMS, REQUEUE = 120, 40
PART_ROWS = 1000
REGION_RANK = {"body": 0, "header": 1, "footer": 2}


def collect_units(blocks: DataFrame, part: Column | None = None) -> DataFrame:
    """Paragraphs with text, body before header before footer, numbered from 0 in each document.

    part never falls as ord grows within a document, and holds a bounded number of paragraphs: a page, say, or ord in thousands where ord is a number (the default).
    Paragraphs are numbered in their parts, and a part starts where those before it end, so windows over a document have a row for each part, not for each paragraph.
    """
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in REGION_RANK.items() for x in kv]), F.col("region")), F.lit(len(REGION_RANK)))
    own = blocks.where(X.has_text(F.col("template"))).withColumns({"_rank": rank, "_part": F.floor(F.col("ord") / PART_ROWS) if part is None else part})
    place = ["doc_id", "_rank", "_part"]
    counts = own.groupBy(*place).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("doc_id").orderBy("_rank", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(c).alias(f"{c}_of") for c in place), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in place]
    numbered = own.withColumn("_at", F.row_number().over(Window.partitionBy(*place).orderBy("ord")) - 1)
    return numbered.join(starts, same).select(*blocks.columns, (F.col("_start") + F.col("_at")).cast("int").alias("unit_no"))


def unit_signatures(refs: DataFrame) -> DataFrame:
    """(doc_id, unit_no, sig) of refs(doc_id, unit_no, n, kind, latex, png), in the order of n."""
    png = F.md5(F.substring("png", 1, 8192))
    part = F.when(F.col("kind") == "math", F.concat(F.lit("m:"), F.coalesce("latex", F.lit("")))).otherwise(F.concat(F.lit("i:"), F.octet_length("png").cast("string"), F.lit(":"), F.substring(png, 1, 12)))
    parts = refs.groupBy("doc_id", "unit_no").agg(F.array_sort(F.collect_list(F.struct("n", part.alias("part")))).alias("parts"))
    return parts.select("doc_id", "unit_no", F.array_join(F.transform("parts", lambda p: p.part), "|").alias("sig"))


def lookup(units: DataFrame, memory: DataFrame) -> DataFrame:
    """units with state hit, blank or pending, and value: the memory's, the template itself, or null.

    Distinct keys are joined first, so that a template which many documents share is one row of the join with the memory.
    """
    keys = units.where(X.has_text(F.col("template"))).select("key").distinct()
    found = keys.join(memory, "key")
    both = units.join(found.select("key", F.col("value").alias("hit")), "key", "left")
    texted = X.has_text(F.col("template"))
    return both.withColumn("state", F.when(~texted, "blank").when(F.col("hit").isNotNull(), "hit").otherwise("pending")).withColumn(
        "value", F.when(texted, F.col("hit")).otherwise(F.col("template"))
    ).drop("hit")


def pending(units: DataFrame, memory: DataFrame) -> DataFrame:
    """One row per key that has text and isn't known: (key, template)."""
    wanted = units.where(X.has_text(F.col("template"))).groupBy("key").agg(F.min("template").alias("template"))
    return wanted.join(memory, "key", "left_anti")


def pack(units: DataFrame) -> DataFrame:
    """(doc_id, batch_id, k, unit_no): greedy batches of each document's units(doc_id, unit_no, size), in order.

    A batch closes once it holds more than BATCH_CHARS (with ITEM_EXTRA for each item) or BATCH_ITEMS items.  The fold runs over numbers only.
    """
    rows = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unit_no", F.col("size").cast("int").alias("size")))).alias("items"))
    empty = F.expr("cast(array() as array<struct<batch_id:int,k:int,unit_no:int>>)")
    first = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("held"), F.lit(0).alias("n"), empty.alias("out"))

    def add(acc, item):
        held, n = acc.held + item["size"] + ITEM_EXTRA, acc.n + 1
        full = (held > BATCH_CHARS) | (n >= BATCH_ITEMS)
        one = F.struct(acc.batch.alias("batch_id"), acc.n.alias("k"), item.unit_no.cast("int").alias("unit_no"))
        reset = lambda c, name: F.when(full, F.lit(0)).otherwise(c).alias(name)
        return F.struct(F.when(full, acc.batch + 1).otherwise(acc.batch).alias("batch"), reset(held, "held"), reset(n, "n"), F.concat(acc.out, F.array(one)).alias("out"))

    return rows.select("doc_id", F.inline(F.aggregate("items", first, add, lambda acc: acc.out)))


def prompt_head(source: Column, target: str, known: Column, strict: bool) -> Column:
    """The instructions of a prompt: the language pair, terms whose note has been given already, and demands on lines that came back unchanged."""
    parts = [
        F.lit("Translate each numbered line from "), source, F.lit(f" into {target}. Keep {{{{n}}}} and [[b]] as they are. Answer with one JSON object: number to text."),
        F.coalesce(F.concat(F.lit("\nThese terms have their note already, don't repeat it: "), known), F.lit("")),
    ]
    if strict:
        parts += [F.lit("\nThese lines came back unchanged: translate every one, leave no word of "), source, F.lit(", and don't join it with its neighbours.")]
    return F.concat(*parts)


def prompts(batched: DataFrame, sources: DataFrame, target: str, terms: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, batch_id, n_items, prompt) of batched(doc_id, batch_id, k, text): instructions, then `k TAB text` lines.

    sources(doc_id, lang) gives the language translated from, terms(doc_id, rank, term) the known terms, as glossary() bounds them.
    """
    known = terms.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    known = known.select("doc_id", F.array_join(F.transform("t", lambda x: x.term), "、").alias("known"))
    clean = F.regexp_replace("text", r"[\r\n]", " ")
    lines = batched.groupBy("doc_id", "batch_id").agg(F.array_sort(F.collect_list(F.struct("k", clean.alias("text")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: F.concat(x.k.cast("string"), F.lit("\t"), x.text)), "\n")
    both = lines.join(sources.select("doc_id", "lang"), "doc_id", "left").join(known, "doc_id", "left")
    head = prompt_head(F.coalesce("lang", F.lit("the source language")), target, F.col("known"), strict)
    return both.select("doc_id", "batch_id", F.size("lines").cast("long").alias("n_items"), F.concat(head, F.lit("\n"), body).alias("prompt"))


def parse_responses(responses: DataFrame) -> DataFrame:
    """responses with `obj`, map<string,string>: of the whole raw text if that is JSON, else of its first { to its last }; null if that is no object.

    Text that is JSON as a whole but no object (an array, even one that holds an object) is a failure.
    """

    # A parser may stop after the first value; framed in two ways, text is JSON only if it is one value and nothing else.
    framed = lambda text: F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    is_json = lambda text: framed(text).isNotNull() & F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()

    def as_map(text: Column) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(framed(text), "$.v", "variant"))
        return F.when(is_json(text) & kind.startswith("OBJECT"), F.from_json(text, "map<string,string>"))

    inner = F.regexp_extract("raw", r"(?s)(\{.*\})", 1)
    return responses.withColumn("obj", F.when(is_json(F.col("raw")), as_map(F.col("raw"))).otherwise(as_map(inner)))


def align(batched: DataFrame, parsed: DataFrame) -> DataFrame:
    """batched(doc_id, batch_id, k, unit_no, text) with its value: by number, else by position; empty or failed: the text itself."""
    both = batched.join(parsed.select("doc_id", "batch_id", "obj"), ["doc_id", "batch_id"], "left")
    w = Window.partitionBy("doc_id", "batch_id")
    own = F.try_element_at("obj", F.col("k").cast("string"))
    any_key = F.max(F.coalesce(F.length(own), F.lit(0)) > 0).over(w)
    value = F.when(any_key, own).otherwise(F.get(F.map_values("obj"), F.col("k")))
    clean = X.strip(F.regexp_replace(value, r"[\r\n]", " "))
    return both.select("doc_id", "batch_id", "k", "unit_no", F.coalesce(F.when(clean != "", clean), F.col("text")).alias("value"))


def glossary(texts: DataFrame, limit: int = GLOSSARY_TERMS) -> DataFrame:
    """(doc_id, rank, term): strings in full-width brackets that hold a Latin letter, by first appearance in texts(doc_id, unit_no, value)."""
    low, high = X.GLOSSARY_LENGTH
    found = texts.select("doc_id", "unit_no", F.posexplode(F.regexp_extract_all("value", F.lit(rf"（([^（）]{{{low},{high}}})）"), F.lit(1))).alias("pos", "term"))
    terms = found.withColumn("term", X.strip(F.col("term"))).where(F.col("term").rlike("[A-Za-z]")).groupBy("doc_id", "term").agg(F.min(F.struct("unit_no", "pos")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    return terms.withColumn("rank", rank).where(F.col("rank") <= limit).select("doc_id", F.col("rank").cast("long").alias("rank"), "term")


def is_unchanged() -> Column:
    return (X.strip(F.col("value")) == X.strip(F.col("template"))) & (F.length(F.regexp_replace("template", "[^A-Za-z]", "")) > 3)


def checks(out: DataFrame) -> DataFrame:
    """(doc_id, unit_no, src, p, long, unchanged) of out(doc_id, unit_no, template, value): what its checks look at, with digests of the plain texts; p is null without a value."""
    digest = lambda c: F.unhex(F.md5(c.cast("binary")))
    rows = out.select("doc_id", "unit_no", X.plain(F.col("template")).alias("s"), F.when(F.col("value") != "", X.plain(F.col("value"))).alias("v"), F.coalesce(is_unchanged(), F.lit(False)).alias("unchanged"))
    long = (F.length("s") > 6) & (F.length("v") > F.length("s") * F.lit(1.8) + 12)
    return rows.select("doc_id", "unit_no", digest(F.col("s")).alias("src"), digest(F.col("v")).alias("p"), F.coalesce(long, F.lit(False)).alias("long"), "unchanged")


def merged(checked: DataFrame) -> DataFrame:
    """(doc_id, unit_no) of checks() that look merged: equal output first seen with another source, or too long."""
    w = Window.partitionBy("doc_id", "p").orderBy("unit_no")
    rows = checked.where("p IS NOT NULL").withColumns({"first_src": F.first("src").over(w), "first_no": F.first("unit_no").over(w)})
    clash = F.col("src") != F.col("first_src")
    return rows.select("doc_id", F.explode(F.array_compact(F.array(F.when(clash | F.col("long"), F.col("unit_no")), F.when(clash, F.col("first_no"))))).alias("unit_no")).distinct()


def merged_suspects(out: DataFrame, limit: int | None = REQUEUE) -> DataFrame:
    """The units of out(doc_id, unit_no, template, value) that look merged, as lowest() bounds them."""
    return lowest(merged(checks(out)), limit)


def lowest(flagged: DataFrame, limit: int | None) -> DataFrame:
    """Of flagged(doc_id, unit_no) the lowest numbers of each document, at most limit; all of them if that is None."""
    if limit is None:
        return flagged
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("unit_no"))
    return flagged.withColumn("n", n).where(F.col("n") <= limit).select("doc_id", "unit_no")


def untranslated(out: DataFrame) -> DataFrame:
    return out.where(is_unchanged()).select("doc_id", "unit_no")


def split_items(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, unit_no, part, role, template): a paragraph's lead, then its items as list rows."""
    parts = paragraphs.withColumn("parts", X.item_parts(F.col("template")))
    items = F.filter(F.transform(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), X.strip), lambda s: s != "")
    lead = X.rstrip(F.get("parts", F.lit(0)))
    cut = F.size("parts") > 1
    keep = F.when(~cut, F.array(F.struct(F.lit("lead").alias("role"), F.col("template").alias("template")))).when(
        (X.strip(lead) != "") | (F.size(items) == 0), F.array(F.struct(F.lit("lead").alias("role"), lead.alias("template")))
    ).otherwise(F.expr("cast(array() as array<struct<role:string,template:string>>)"))
    rest = F.transform(items, lambda s: F.struct(F.lit("list").alias("role"), s.alias("template")))
    rows = parts.select("doc_id", "unit_no", F.posexplode(F.concat(keep, rest)).alias("part", "x"))
    return rows.select("doc_id", "unit_no", "part", "x.role", "x.template")


def assign_back(units: DataFrame, values: DataFrame) -> DataFrame:
    """units with the value of (doc_id, unit_no), or their own template."""
    v = values.select("doc_id", "unit_no", F.col("value").alias("new"))
    return units.join(v, ["doc_id", "unit_no"], "left").withColumn("template", F.coalesce("new", "template")).drop("new")


def assemble_events(events: DataFrame) -> DataFrame:
    """(request_id, text, finished, first_ts) of events(request_id, seq, ts, line), the deltas in order."""
    data = F.when(F.col("line").startswith("data:"), X.strip(F.substring("line", 6, 1 << 30)))
    delta = F.from_json(data, "choices array<struct<delta:struct<content:string>>>")
    piece = F.try_element_at(delta.choices, F.lit(1)).delta.content
    rows = events.select("request_id", "seq", "ts", (data == "[DONE]").alias("done"), F.when(data != "[DONE]", piece).alias("piece"))
    grouped = rows.groupBy("request_id").agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("seq", "piece")))).alias("pieces"), F.bool_or(F.coalesce("done", F.lit(False))).alias("finished"), F.min(F.when(F.length("piece") > 0, F.col("ts"))).alias("first_ts"))
    return grouped.select("request_id", F.array_join(F.transform("pieces", lambda p: p.piece), "").alias("text"), "finished", "first_ts")
