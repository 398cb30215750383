"""Queries over imported pages: blocks, outline, links, plain text, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import export
from ..sources import html, markdown
from .common import table


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return html.blocks(table(spark, d, "pages"), "page_id", "html")


def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).drop("links", "marks")


def html_links(spark: SparkSession, d: str) -> DataFrame:
    links = _blocks(spark, d).select("page_id", "ord", F.posexplode("links").alias("k", "link"))
    n = F.row_number().over(W.partitionBy("page_id").orderBy("ord", "k"))
    return links.select("page_id", n.alias("link_no"), "link.href", "link.text")


def html_outline(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).where("role = 'heading'").select("page_id", "level", "text")


def html_list_items(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).where("list_level is not null").groupBy("page_id", "list_level").agg(F.count("*").alias("items"), F.sum(F.length("text")).alias("chars"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    return export.plain_text(_blocks(spark, d), "page_id")


def html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return export.markdown(_blocks(spark, d), "page_id")


def html_round_trip(spark: SparkSession, d: str) -> DataFrame:
    again = html.blocks(export.html(_blocks(spark, d), "page_id"), "page_id", "content")
    return again.groupBy("page_id").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown: what they hold of it, and paragraphs."""
    return html.blocks(table(spark, d, "documents"), "doc_id", "text", markdown.parse).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


QUERIES = {f.__name__: f for f in (html_blocks, html_links, html_outline, html_list_items, html_text, html_to_markdown, html_round_trip, markdown_blocks)}

_ENT = "replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
_A = "SELECT page_id, i AS link_no, regexp_extract(m[i], 'href=\"([^\"]*)\"', 1) AS href, " + _ENT.format("regexp_extract(m[i], '>([^<]*)<', 1)") + " AS text FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*<') AS m FROM pages), unnest(range(1, len(m) + 1)) AS r(i)"
# every page is of one template: its blocks begin at these tags
_BLOCKS = (
    "b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(html, '<body>(.*)$', 1, 's'), '<!--.*?-->', '', 'gs'), '[ \\t\\r\\n\\f\\v]+', ' ', 'g') AS h FROM pages), "
    "c AS (SELECT page_id, regexp_replace(replace(regexp_replace(replace(replace(replace(replace(h, '<li>', chr(1) || 'L'), '<div class=\"ad\">', chr(1) || 'D'), '<h1>', chr(1) || 'H'), '<footer>', chr(1) || 'P'), '</?(p|li|div|h1|footer|article|ul|nav)>', chr(1) || 'P', 'g'), '<br>', chr(10)), '<[^>]*>', '', 'g') AS h FROM b), "
    "p AS (SELECT page_id, i, left(x, 1) AS k, " + _ENT.format("trim(substr(x, 2), ' ')") + " AS text FROM (SELECT page_id, i, parts[i] AS x FROM (SELECT page_id, string_split(h, chr(1)) AS parts FROM c), unnest(range(1, len(parts) + 1)) AS r(i))), "
    "blk AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS ord, k, text FROM p WHERE trim(text, ' ') <> '')"
)
ORACLE = {
    "html_blocks": f"WITH {_BLOCKS} SELECT page_id, ord, 'paragraph' AS kind, CASE k WHEN 'H' THEN 'heading' ELSE 'body' END AS role, CASE k WHEN 'H' THEN 1 ELSE 0 END AS level, CASE k WHEN 'L' THEN 0 END AS list_level, CASE k WHEN 'L' THEN 'bullet' END AS list_kind, 0 AS task, 0 AS quote_depth, CASE k WHEN 'D' THEN 'ad' END AS div_class, text, NULL AS table_no, NULL AS row_no, NULL AS col_no, NULL AS col_span, NULL AS row_span, NULL AS header FROM blk",
    "html_text": f"WITH {_BLOCKS} SELECT page_id, string_agg(CASE k WHEN 'L' THEN '• ' ELSE '' END || text, chr(10) ORDER BY ord) AS content FROM blk GROUP BY 1",
    "html_to_markdown": f"WITH {_BLOCKS} SELECT page_id, string_agg(CASE k WHEN 'L' THEN '- ' WHEN 'H' THEN '# ' ELSE '' END || replace(regexp_replace(text, '([\\\\`*_\\[\\]<>#|~$])', '\\\\\\1', 'g'), chr(10), '\\' || chr(10)), chr(10) || chr(10) ORDER BY ord) AS content FROM blk GROUP BY 1",
    "html_round_trip": f"WITH {_BLOCKS} SELECT page_id, count(*) AS blocks, sum(length(text)) AS chars FROM blk GROUP BY 1",
    "html_links": _A,
    "html_outline": "SELECT page_id, 1 AS level, " + _ENT.format("trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ' ')") + " AS text FROM pages WHERE regexp_matches(html, '<h1>[^<]+</h1>')",
    "html_list_items": f"SELECT page_id, 0 AS list_level, count(*) AS items, sum(length(text)) AS chars FROM ({_A}) GROUP BY page_id",
}
