"""Corpus-wide translation memory: one registered query per operator, over the units of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.functions import text as X
from folioweave.operators import requeue as Q
from folioweave.operators import units as U
from folioweave.sources import fixtures as S
from folioweave.sources.memory import Memory
from folioweave.sources.tables import load_memory, shared_folder, table, upsert_memory

TARGET = "Simplified Chinese"
TOKEN_SQL = r"\{\{[0-9]+\}\}|\[\[/?[bi]\]\]"
PLAIN_SQL = r"regexp_replace({}, '\{{\{{[0-9]+\}}\}}|\[\[/?[bi]\]\]|\s', '', 'g')"
UNITS, MEMORY, TRANSLATIONS = "WITH RECURSIVE " + S.UNITS_SQL, S.MEMORY_SQL, S.TRANSLATIONS_SQL


def texted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.units(spark, sf_dir).where(X.has_text(F.col("template")))


def collect_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.units(spark, sf_dir).select("doc_id", F.col("unit_no").alias("ord"), "region", "template")
    return U.collect_units(rows).select("doc_id", F.col("unit_no").cast("long").alias("unit_no"), "region", "template")


COLLECT = UNITS + """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE region WHEN 'body' THEN 0 ELSE 1 END, unit_no) - 1 AS unit_no, region, template FROM units WHERE texted"""


def has_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.units(spark, sf_dir).select("doc_id", "unit_no", X.has_text(F.col("template")).alias("has_text"))


def unit_sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.units(spark, sf_dir).where("sig <> ''")
    n = F.explode(F.sequence(F.lit(0), F.when(F.col("unit_no") % 3 == 0, 1).otherwise(0)))
    refs = rows.select("doc_id", "unit_no", n.alias("n"), F.col("base").cast("binary").alias("png")).withColumns({"kind": F.when(F.col("n") == 0, "image").otherwise("math"), "latex": F.concat(F.lit("x^"), "unit_no")})
    return U.unit_signatures(refs)


SIG = UNITS + """
SELECT doc_id, unit_no, 'i:' || strlen(base) || ':' || substr(CASE WHEN strlen(base) <= 8192 THEN md5(base) ELSE md5(encode(base)[1:8192]) END, 1, 12) || CASE WHEN unit_no % 3 = 0 AND unit_no % 10 <> 7 THEN '|m:x^' || unit_no WHEN unit_no % 3 = 0 THEN '|m:x^' || unit_no ELSE '' END AS sig FROM units WHERE sig <> ''"""


def unit_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.units(spark, sf_dir).select("doc_id", "unit_no", X.unit_key(F.col("template"), F.col("sig")).alias("key"))


def tm_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.lookup(S.units(spark, sf_dir), S.memory(spark, sf_dir)).select("doc_id", "unit_no", "state", "value")


LOOKUP = UNITS + f", {MEMORY}" + """
SELECT u.doc_id, u.unit_no, CASE WHEN NOT texted THEN 'blank' WHEN t.key IS NOT NULL THEN 'hit' ELSE 'pending' END AS state, CASE WHEN texted THEN t.value ELSE template END AS value FROM units u LEFT JOIN tm t USING (key)"""


def tm_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = U.lookup(S.units(spark, sf_dir), S.memory(spark, sf_dir))
    return found.groupBy("doc_id").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("hit", "blank", "pending")))


HITS = f"""SELECT doc_id, count(*) FILTER (state = 'hit') AS hit, count(*) FILTER (state = 'blank') AS blank, count(*) FILTER (state = 'pending') AS pending FROM ({LOOKUP}) GROUP BY doc_id"""


def tm_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.pending(S.units(spark, sf_dir), S.memory(spark, sf_dir))


PENDING = UNITS + f", {MEMORY} SELECT key, min(template) AS template FROM units WHERE texted AND key NOT IN (SELECT key FROM tm) GROUP BY key"


def tm_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = S.translations(spark, sf_dir).select("key", "value", F.col("template").alias("source"), F.col("doc_id").alias("version"))
    return upsert_memory(S.memory(spark, sf_dir), news)


UPSERT = UNITS + f", {MEMORY}, {TRANSLATIONS}" + """,
fresh AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY doc_id DESC, value DESC) AS n FROM translations WHERE value <> template)
SELECT key, value FROM fresh WHERE n = 1 UNION ALL SELECT key, value FROM tm WHERE key NOT IN (SELECT key FROM fresh)"""


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.pack(texted(spark, sf_dir).select("doc_id", "unit_no", F.length("template").alias("size")))


BATCHES_SQL = """sized AS (SELECT doc_id, unit_no, template, length(template) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY unit_no) AS n FROM units WHERE texted),
steps AS (SELECT doc_id, n, unit_no, 0 AS batch_id, 0 AS k, size + 8 AS held FROM sized WHERE n = 1
  UNION ALL SELECT s.doc_id, s.n, s.unit_no, CASE WHEN p.held > 1400 OR p.k + 1 >= 40 THEN p.batch_id + 1 ELSE p.batch_id END, CASE WHEN p.held > 1400 OR p.k + 1 >= 40 THEN 0 ELSE p.k + 1 END,
  CASE WHEN p.held > 1400 OR p.k + 1 >= 40 THEN 0 ELSE p.held END + s.size + 8 FROM steps p JOIN sized s ON s.doc_id = p.doc_id AND s.n = p.n + 1)"""
PACK = UNITS + f", {BATCHES_SQL} SELECT doc_id, batch_id, k, unit_no FROM steps"


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).join(texted(spark, sf_dir).select("doc_id", "unit_no", F.col("template").alias("text")), ["doc_id", "unit_no"])


def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.prompts(batches(spark, sf_dir), table(spark, sf_dir, "documents"), TARGET, U.glossary(S.translations(spark, sf_dir)))


def prompt_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict prompts for the units that came back unchanged or merged."""
    out = S.translations(spark, sf_dir)
    again = U.untranslated(out).union(U.merged_suspects(out)).distinct().join(texted(spark, sf_dir), ["doc_id", "unit_no"])
    packs = U.pack(again.select("doc_id", "unit_no", F.length("template").alias("size")))
    batched = packs.join(again.select("doc_id", "unit_no", F.col("template").alias("text")), ["doc_id", "unit_no"])
    return U.prompts(batched, table(spark, sf_dir, "documents"), TARGET, U.glossary(out), strict=True)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batches(spark, sf_dir).join(S.translations(spark, sf_dir).select("doc_id", "unit_no", "value"), ["doc_id", "unit_no"])
    obj = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("k").cast("string").alias("k"), "value")))))
    raw = rows.groupBy("doc_id", "batch_id").agg(obj.alias("obj"))
    m = F.col("batch_id") % 3
    doc = F.col("doc_id") % 5
    wrapped = F.concat(F.when(doc == 0, "[Note] ").otherwise("Voici: "), "obj", F.lit(" fin"))
    failed = F.when(doc == 1, F.concat(F.lit("["), "obj", F.lit("]"))).when(doc == 2, F.concat(F.lit("Voici: "), F.col("obj"), F.lit(" {"), F.lit("}"))).when(doc == 3, "12").otherwise("[]")
    return raw.select("doc_id", "batch_id", F.when(m == 0, F.col("obj")).when(m == 1, wrapped).otherwise(failed).alias("raw"))


def response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.parse_responses(responses(spark, sf_dir)).select("doc_id", "batch_id", F.coalesce(F.size("obj").cast("long"), F.lit(0)).alias("n_values"), F.col("obj").isNull().alias("failed"))


PARSE = UNITS + f", {BATCHES_SQL}, {TRANSLATIONS}" + r""",
objects AS (SELECT s.doc_id, batch_id, json_group_object(k::VARCHAR, t.value)::VARCHAR AS obj FROM steps s JOIN translations t ON s.doc_id = t.doc_id AND s.unit_no = t.unit_no GROUP BY ALL),
answers AS (SELECT doc_id, batch_id, CASE batch_id % 3 WHEN 0 THEN obj WHEN 1 THEN CASE WHEN doc_id % 5 = 0 THEN '[Note] ' ELSE 'Voici: ' END || obj || ' fin'
  ELSE CASE doc_id % 5 WHEN 1 THEN '[' || obj || ']' WHEN 2 THEN 'Voici: ' || obj || ' {}' WHEN 3 THEN '12' ELSE '[]' END END AS raw FROM objects),
found AS (SELECT doc_id, batch_id, CASE WHEN json_valid(raw) THEN raw ELSE regexp_extract(raw, '(?s)\{.*\}') END AS o FROM answers),
parsed AS (SELECT doc_id, batch_id, CASE WHEN json_valid(o) AND json_type(o) = 'OBJECT' THEN len(json_keys(o)) END AS n FROM (SELECT doc_id, batch_id, CASE WHEN json_valid(o) THEN o END AS o FROM found))
SELECT doc_id, batch_id, coalesce(n, 0)::BIGINT AS n_values, n IS NULL AS failed FROM parsed"""


def response_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.align(batches(spark, sf_dir), U.parse_responses(responses(spark, sf_dir)))


ALIGN = UNITS + f", {BATCHES_SQL}, {TRANSLATIONS}" + """
SELECT s.doc_id, batch_id, k, s.unit_no, CASE WHEN batch_id % 3 = 2 OR trim(t.value) = '' THEN t.template ELSE trim(regexp_replace(t.value, '[\\r\\n]', ' ', 'g')) END AS value
FROM steps s JOIN translations t ON s.doc_id = t.doc_id AND s.unit_no = t.unit_no"""


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.glossary(S.translations(spark, sf_dir))


GLOSSARY = UNITS + f", {TRANSLATIONS}" + """,
found AS (SELECT doc_id, unit_no, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT doc_id, unit_no, regexp_extract_all(value, '（([^（）]{2,36})）', 1) AS l FROM translations)),
terms AS (SELECT doc_id, trim(l[pos]) AS term, min(unit_no * 100000 + pos) AS place FROM found WHERE regexp_matches(l[pos], '[A-Za-z]') GROUP BY ALL)
SELECT doc_id, rank, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS rank FROM terms) WHERE rank <= 120"""


def merged_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.merged_suspects(S.translations(spark, sf_dir))


def merged_sql(rows: str) -> str:
    """The CTEs of the merged suspects of rows, and what selects them."""
    return f"""{rows}_flat AS (SELECT doc_id, unit_no, {PLAIN_SQL.format('template')} AS src, {PLAIN_SQL.format('value')} AS p FROM {rows} WHERE value <> ''),
{rows}_firsts AS (SELECT doc_id, p, min(unit_no) AS first_no FROM {rows}_flat GROUP BY ALL),
{rows}_pairs AS (SELECT f.*, first_no, o.src AS first_src FROM {rows}_flat f JOIN {rows}_firsts USING (doc_id, p) JOIN {rows}_flat o ON o.doc_id = f.doc_id AND o.unit_no = first_no),
{rows}_bad AS (SELECT doc_id, unit_no FROM {rows}_pairs WHERE src <> first_src UNION SELECT doc_id, first_no FROM {rows}_pairs WHERE src <> first_src
  UNION SELECT doc_id, unit_no FROM {rows}_pairs WHERE length(src) > 6 AND length(p) > length(src) * 1.8::DOUBLE + 12),
{rows}_merged AS (SELECT doc_id, unit_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit_no) AS n FROM {rows}_bad) WHERE n <= 40)"""


MERGED = UNITS + f", {TRANSLATIONS}, {merged_sql('translations')} SELECT * FROM translations_merged"


def untranslated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.untranslated(S.translations(spark, sf_dir))


UNCHANGED_SQL = "SELECT doc_id, unit_no FROM {} WHERE trim(value) = trim(template) AND length(regexp_replace(template, '[^A-Za-z]', '', 'g')) > 3"
UNTRANSLATED = UNITS + f", {TRANSLATIONS} " + UNCHANGED_SQL.format("translations")

ROUNDS = 3


def recorded(batches: DataFrame, n: int) -> DataFrame:
    """The recorded answers to a round's batches: some units come back unchanged, empty, or like others again."""
    m = (F.col("doc_id") + F.col("unit_no") * 3 + n) % 5
    value = F.when(m == 0, F.col("text")).when(m == 1, "").when(m == 2, "译文同一句").otherwise(F.concat(F.lit("译"), "unit_no", F.lit(f"/{n}")))
    obj = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("k").cast("string").alias("k"), value.alias("v"))))))
    return batches.groupBy("doc_id", "batch_id").agg(obj.alias("raw"))


def requeue_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations after rounds of asking again for those that look merged or came back unchanged, with the recorded answers."""
    base = shared_folder(spark, "requeue")

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    return Q.settled(S.translations(spark, sf_dir), recorded, write, ROUNDS).select("doc_id", "unit_no", "value", "asked")


def rounds_sql() -> str:
    """Every unit in every round, without putting documents aside."""
    parts, rows = ["s0_out AS MATERIALIZED (SELECT doc_id, unit_no, template, value, 0 AS asked FROM translations)"], "s0_out"
    for n in range(ROUNDS):
        given = f"CASE (doc_id + unit_no * 3 + {n}) % 5 WHEN 0 THEN template WHEN 1 THEN '' WHEN 2 THEN '译文同一句' ELSE '译' || unit_no || '/{n}' END"
        for name in ("m", "u"):
            new = f"{name}{n}_out"
            parts.append(merged_sql(rows) if name == "m" else f"{rows}_merged AS ({UNCHANGED_SQL.format(rows)})")
            parts.append(f"""{new} AS MATERIALIZED (SELECT s.doc_id, s.unit_no, template, CASE WHEN q.unit_no IS NULL THEN value ELSE coalesce(nullif(trim(regexp_replace(given, '[\r\n]', ' ', 'g')), ''), template) END AS value,
  asked + (q.unit_no IS NOT NULL)::INT AS asked FROM (SELECT *, {given} AS given FROM {rows}) s LEFT JOIN {rows}_merged q ON q.doc_id = s.doc_id AND q.unit_no = s.unit_no)""")
            rows = new
    return UNITS + f", {TRANSLATIONS}, " + ", ".join(parts) + f" SELECT doc_id, unit_no, value, asked FROM {rows}"


#: SQL of the text functions, as macros of columns: q is the regular expression of placeholders.
FIX_SQL = r"""regexp_replace(regexp_replace({0}, '\[\[\s*[''‘’"“”]?\s*(/?)\s*([bi])\s*[''‘’"“”]?\s*\]\]', '[[\1\2]]', 'g'), '\[\[x\]\]', '', 'g')"""
REPAIR_SQL = r"""parts AS (SELECT *, regexp_extract_all({src}, '\{{\{{[0-9]+\}}\}}') AS s, regexp_extract_all({out}, '\{{\{{[0-9]+\}}\}}') AS t, regexp_split_to_array({out}, '\{{\{{[0-9]+\}}\}}') AS pieces FROM {rows}),
filled AS (SELECT *, array_to_string(list_transform(pieces, lambda p, i: p || CASE WHEN i <= len(t) THEN coalesce(s[i], '') ELSE '' END), '') AS f FROM parts),
whole AS (SELECT *, CASE WHEN s = t THEN {out} WHEN len(s) > len(t) THEN rtrim(f) || ' ' || array_to_string(s[len(t) + 1:], ' ') ELSE f END AS whole_text FROM filled),
counted AS (SELECT *, (length(whole_text) - length(replace(whole_text, '[[b]]', ''))) // 5 AS opens, (length(whole_text) - length(replace(whole_text, '[[/b]]', ''))) // 6 AS closes FROM whole),
repaired AS (SELECT *, repeat('[[b]]', greatest(closes - opens, 0)::INT) || whole_text || repeat('[[/b]]', greatest(opens - closes, 0)::INT) AS r FROM counted)"""
CHUNK_SQL = "c"
for _pattern, _by in (
    (r"[（(]\s*[)）]", ""), (r"[（(][\s,，.。、;；:：·・]{0,6}[)）]", ""), (r"([一-鿿] *)\(([^()]{0,40})\)", r"\1（\2）"), (r"\(([^()]{0,40})\)( *[一-鿿])", r"（\1）\2"),
    *[(r"（\s*（([^（）]*)）\s*）", r"（\1）")] * 3,
):
    CHUNK_SQL = f"regexp_replace({CHUNK_SQL}, '{_pattern}', '{_by}', 'g')"
TIDY_SQL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(regexp_split_to_array({0}, '" + TOKEN_SQL.replace("{", "{{").replace("}", "}}")
    + "'), lambda c, i: " + CHUNK_SQL.replace("{", "{{").replace("}", "}}") + " || coalesce(regexp_extract_all({0}, '" + TOKEN_SQL.replace("{", "{{").replace("}", "}}")
    + r"')[i], '')), ''), '[ \t]{{2,}}', ' ', 'g'), '\s+([，。；：、！？])', '\1', 'g'), '([（(])\s+', '\1', 'g'), '\s+([）)])', '\1', 'g'))"
)


def column(name: str, make):
    """A query of one text column made of each translation."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.translations(spark, sf_dir).select("doc_id", "unit_no", make().alias(name))

    return run


REPAIR = UNITS + f", {TRANSLATIONS}, " + REPAIR_SQL.format(src="template", out="value", rows="translations") + " SELECT doc_id, unit_no, r AS repaired FROM repaired"
FIX = UNITS + f", {TRANSLATIONS} SELECT doc_id, unit_no, " + FIX_SQL.format("value") + " AS fixed FROM translations"
TIDY = UNITS + f", {TRANSLATIONS} SELECT doc_id, unit_no, " + TIDY_SQL.format("value") + " AS tidied FROM translations"
FINAL = (
    UNITS + f", {TRANSLATIONS}, given AS (SELECT doc_id, unit_no, " + FIX_SQL.format("template") + " AS src, CASE WHEN m <> 2 THEN " + FIX_SQL.format("value") + " END AS fixed FROM translations), "
    + REPAIR_SQL.format(src="src", out="fixed", rows="given") + ", ready AS (SELECT doc_id, unit_no, coalesce(r, src) AS x FROM repaired) SELECT doc_id, unit_no, " + TIDY_SQL.format("x") + " AS final FROM ready"
)


def finalize_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.translations(spark, sf_dir)
    given = F.when((F.col("doc_id") + F.col("unit_no")) % 8 != 2, F.col("value"))
    return rows.select("doc_id", "unit_no", X.finalize(F.col("template"), given).alias("final"))


def strip_bullet(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = U.split_items(S.units(spark, sf_dir))
    return items.select("doc_id", "unit_no", "part", X.strip_bullet(F.col("template")).alias("b")).select("doc_id", "unit_no", "part", F.col("b.text").alias("text"), F.col("b.had").alias("had_bullet"))


ITEMS_SQL = r""",
cuts AS (SELECT doc_id, unit_no, string_split(regexp_replace(template, '([,.;:!?])([ \t]*)([•·])', '\1\2' || chr(1) || '\3', 'g'), chr(1)) AS l, template FROM units),
kept AS (SELECT doc_id, unit_no, CASE WHEN len(l) = 1 THEN [template] ELSE list_concat(CASE WHEN trim(l[1]) <> '' THEN [rtrim(l[1])] ELSE [] END, list_filter(list_transform(l[2:], lambda s: trim(s)), lambda s: s <> '')) END AS p, len(l) > 1 AND trim(l[1]) = '' AS bare FROM cuts),
items AS (SELECT doc_id, unit_no, part, CASE WHEN part = 0 AND NOT bare THEN 'lead' ELSE 'list' END AS role, p[part + 1] AS template FROM (SELECT *, unnest(range(0, len(p)))::INT AS part FROM kept))"""
SPLIT = UNITS + ITEMS_SQL + " SELECT * FROM items"
STRIP = UNITS + ITEMS_SQL + r" SELECT doc_id, unit_no, part, CASE WHEN regexp_matches(ltrim(template), '^[•·]') THEN regexp_replace(ltrim(template), '^[•·]\s*', '') ELSE ltrim(template) END AS text, (template <> '' AND ltrim(template) = '') OR regexp_matches(ltrim(template), '^[•·]') AS had_bullet FROM items"


def assign_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.assign_back(S.units(spark, sf_dir), S.translations(spark, sf_dir)).select("doc_id", "unit_no", "template")


ASSIGN = UNITS + f", {TRANSLATIONS} SELECT u.doc_id, u.unit_no, coalesce(t.value, u.template) AS template FROM units u LEFT JOIN translations t ON t.doc_id = u.doc_id AND t.unit_no = u.unit_no"


def sse_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.assemble_events(S.sse(spark, sf_dir)).select("request_id", "text", "finished")


SSE = "SELECT conv_id || '-' || turn AS request_id, coalesce(text, '') AS text, conv_id % 10 <> 0 AS finished FROM conversations WHERE conv_id % 10 <> 0 OR length(text) > 0"

def tm_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bucketed memory after two versions, the second of which adds translations and renews some; as tm_upsert on the whole."""
    memory = Memory(spark, shared_folder(spark, "versions"))
    memory.upsert(S.memory(spark, sf_dir).withColumns({"source": F.lit(None).cast("string"), "version": F.lit(0)}))
    memory.upsert(S.translations(spark, sf_dir).select("key", "value", F.col("template").alias("source"), F.col("doc_id").alias("version")))
    return memory.read()


def tm_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "memory")
    S.memory(spark, sf_dir).write.parquet(path)
    return load_memory(spark, path)


#: Values of terms as glossary() lists them, and the head of a prompt.
KNOWN_SQL = f"""known AS (SELECT doc_id, string_agg(term, '、' ORDER BY rank) AS known FROM ({GLOSSARY}) GROUP BY doc_id)"""
HEAD_SQL = f"""'Translate each numbered line from ' || lang || ' into {TARGET}. Keep {{{{n}}}} and [[b]] as they are. Answer with one JSON object: number to text.'
  || coalesce(chr(10) || 'These terms have their note already, don''t repeat it: ' || known, '')"""
STRICT_SQL = """ || chr(10) || 'These lines came back unchanged: translate every one, leave no word of ' || lang || ', and don''t join it with its neighbours.'"""


def prompt_sql(strict: str) -> str:
    return f"""SELECT s.doc_id, batch_id, count(*) AS n_items, any_value({HEAD_SQL}{strict}) || chr(10) || string_agg(k || chr(9) || regexp_replace(template, '[\\r\\n]', ' ', 'g'), chr(10) ORDER BY k) AS prompt
FROM steps s JOIN sized z ON s.doc_id = z.doc_id AND s.unit_no = z.unit_no JOIN documents d ON d.doc_id = s.doc_id LEFT JOIN known w ON w.doc_id = s.doc_id GROUP BY s.doc_id, batch_id"""


PROMPT = UNITS + f", {BATCHES_SQL}, {KNOWN_SQL} " + prompt_sql("")
REQUEUED = BATCHES_SQL.replace("FROM units WHERE texted", "FROM units JOIN requeued USING (doc_id, unit_no) WHERE texted")
REQUEUE_PROMPT = UNITS + f", requeued AS ((FROM ({UNTRANSLATED})) UNION (FROM ({MERGED}))), {REQUEUED}, {KNOWN_SQL} " + prompt_sql(STRICT_SQL)

QUERIES = {
    "collect_units": collect_units, "has_text": has_text, "unit_sig": unit_sig, "unit_key": unit_key, "tm_lookup": tm_lookup, "tm_hits": tm_hits, "tm_pending": tm_pending, "tm_upsert": tm_upsert,
    "batch_pack": packed, "prompt_build": prompt_build, "prompt_requeue": prompt_requeue, "requeue_rounds": requeue_rounds, "tm_load": tm_load, "tm_versions": tm_versions, "response_parse": response_parse, "response_align": response_align, "glossary": glossary, "merged_suspects": merged_suspects,
    "untranslated": untranslated, "placeholder_repair": column("repaired", lambda: X.repair(F.col("template"), F.col("value"))), "fix_markers": column("fixed", lambda: X.fix_markers(F.col("value"))),
    "tidy_text": column("tidied", lambda: X.tidy(F.col("value"))), "finalize_units": finalize_units, "strip_bullet": strip_bullet, "split_items": lambda s, d: U.split_items(S.units(s, d)),
    "assign_back": assign_back, "sse_assemble": sse_assemble,
}
ORACLES = {
    "collect_units": COLLECT, "has_text": UNITS + " SELECT doc_id, unit_no, texted AS has_text FROM units", "unit_sig": SIG, "unit_key": UNITS + " SELECT doc_id, unit_no, key FROM units", "tm_lookup": LOOKUP,
    "tm_hits": HITS, "tm_pending": PENDING, "tm_upsert": UPSERT, "tm_versions": UPSERT, "batch_pack": PACK, "prompt_build": PROMPT, "prompt_requeue": REQUEUE_PROMPT, "requeue_rounds": rounds_sql(), "tm_load": UNITS + f", {MEMORY} SELECT key, value FROM tm", "response_parse": PARSE, "response_align": ALIGN, "glossary": GLOSSARY,
    "merged_suspects": MERGED, "untranslated": UNTRANSLATED, "placeholder_repair": REPAIR, "fix_markers": FIX, "tidy_text": TIDY, "finalize_units": FINAL, "strip_bullet": STRIP, "split_items": SPLIT,
    "assign_back": ASSIGN, "sse_assemble": SSE,
}
