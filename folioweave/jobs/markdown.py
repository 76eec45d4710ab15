"""The scanned route: Markdown pages to documents; one registered query per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.operators import markdown as M
from folioweave.sources.tables import table


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, md) from conversations: each line marked up by its number, some pages blank or fenced."""
    c = table(spark, sf_dir, "conversations")
    form = lambda s, i: (
        F.when(i % 6 == 0, F.concat(F.lit("## "), s)).when((i % 6 == 1) | (i % 6 == 2), F.concat(F.lit("- "), s)).when(i % 6 == 3, F.concat(F.lit("> "), s)).when(i % 6 == 4, F.concat(s, F.lit(" **gras** $x^2$"))).otherwise("$$a+b$$")
    )
    md = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), form), "\n")
    md = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("```markdown\n"), md, F.lit("\n```"))).otherwise(md)
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.when(F.col("role") == "system", "BLANK").otherwise(md).alias("md"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_pages(spark, sf_dir).withColumn("md", M.clean(F.col("md")))


PAGES = """WITH source AS (SELECT conv_id AS doc_id, turn AS page, role, string_split(coalesce(text, ''), chr(10)) AS l FROM conversations),
md_pages AS (SELECT doc_id, page, CASE WHEN role = 'system' THEN '' ELSE trim(array_to_string(list_transform(l, lambda s, i: CASE (i - 1) % 6 WHEN 0 THEN '## ' || s WHEN 1 THEN '- ' || s WHEN 2 THEN '- ' || s WHEN 3 THEN '> ' || s WHEN 4 THEN s || ' **gras** $x^2$' ELSE '$$a+b$$' END), chr(10))) END AS md, role, l FROM source)"""
INLINE = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
MATHS = r"regexp_replace(regexp_replace(regexp_replace({0}, '\*\*(.+?)\*\*', '<strong>\1</strong>', 'g'), '\$\$(.+?)\$\$', '\\[\1\\]', 'g'), '\$([^$\n]+?)\$', '\\(\1\\)', 'g')"
BLOCKS = PAGES + r""",
md_lines AS (SELECT doc_id, page, i - 1 AS n, trim(l[i]) AS s, len(l) AS total FROM (SELECT * FROM md_pages WHERE role <> 'system'), unnest(range(1, len(l) + 1)) AS u(i)),
md_blocks AS (SELECT doc_id, page, n AS block, CASE n % 6 WHEN 0 THEN 'heading' WHEN 1 THEN 'item' WHEN 2 THEN 'item' WHEN 3 THEN 'caption' WHEN 4 THEN 'para' ELSE 'display' END AS kind, CASE n % 6 WHEN 0 THEN 2 ELSE 0 END AS level,
  CASE n % 6 WHEN 4 THEN s || ' **gras** $x^2$' WHEN 5 THEN 'a+b' ELSE s END AS text, total FROM md_lines)"""
HTML = BLOCKS + f""",
parts AS (SELECT doc_id, page, block, CASE kind WHEN 'heading' THEN '<h2>' || {MATHS.format(INLINE.format('text'))} || '</h2>' WHEN 'item' THEN CASE WHEN block % 6 = 1 THEN '<ul>' || chr(10) ELSE '' END || '<li>' || {MATHS.format(INLINE.format('text'))} || '</li>' || CASE WHEN block % 6 = 2 OR block = total - 1 THEN chr(10) || '</ul>' ELSE '' END
  WHEN 'caption' THEN '<p class="figcap">' || {MATHS.format(INLINE.format('text'))} || '</p>' WHEN 'display' THEN '<div class="disp">\\[' || text || '\\]</div>' ELSE '<p>' || {MATHS.format(INLINE.format('text'))} || '</p>' END AS part FROM md_blocks),
page_html AS (SELECT doc_id, page, string_agg(part, chr(10) ORDER BY block) AS html FROM parts GROUP BY ALL)"""

QUERIES = {
    "clean_md": pages, "md_blocks": lambda s, d: M.blocks(pages(s, d)).drop("place"), "md_inline": lambda s, d: pages(s, d).select("doc_id", "page", M.inline(F.col("md")).alias("html")),
    "md_html": lambda s, d: M.page_html(M.blocks(pages(s, d))), "document_md_html": lambda s, d: M.document_html(pages(s, d)).select("doc_id", F.md5(F.col("html").cast("binary")).alias("html_md5")),
    "strip_md": lambda s, d: pages(s, d).select("doc_id", "page", M.strip_marks(F.col("md")).alias("plain")), "page_yield": lambda s, d: M.page_yield(pages(s, d)),
}
ORACLES = {
    "clean_md": f"{PAGES} SELECT doc_id, page, md FROM md_pages", "md_blocks": f"{BLOCKS} SELECT doc_id, page, block, kind, level, text FROM md_blocks",
    "md_inline": f"{PAGES} SELECT doc_id, page, {MATHS.format(INLINE.format('md'))} AS html FROM md_pages", "md_html": f"{HTML} SELECT * FROM page_html",
    "document_md_html": HTML + """, shown AS (SELECT doc_id, page, html, max(page) OVER (PARTITION BY doc_id) AS last FROM md_pages LEFT JOIN page_html USING (doc_id, page)),
pieces AS (SELECT doc_id, page, 0 AS k, html AS piece FROM shown WHERE html IS NOT NULL UNION ALL SELECT doc_id, page, 1, '<div class="pb"></div>' FROM shown WHERE page < last)
SELECT doc_id, md5('<!DOCTYPE html><html lang="zh-CN"><head><meta charset="utf-8"><title>译文</title></head><body>' || string_agg(piece, chr(10) ORDER BY page, k) || '</body></html>') AS html_md5 FROM pieces GROUP BY doc_id""",
    "strip_md": PAGES + r" SELECT doc_id, page, trim(regexp_replace(replace(regexp_replace(md, '\*\*(.+?)\*\*', '\1', 'g'), '$$', ''), '\s{2,}', ' ', 'g')) AS plain FROM md_pages",
    "page_yield": f"{PAGES} SELECT doc_id, count(*) AS n_pages, count(*) FILTER (md <> '') AS n_full, count(*) FILTER (md <> '') = 0 AS failed FROM md_pages GROUP BY doc_id",
}
