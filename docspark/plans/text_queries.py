"""Queries of the text source, detection, units, escapes and reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import detect, text
from ..operators import blocks
from .common import table


def text_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return blocks.paragraphs(table(spark, d, "documents"))


def text_paragraph_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    parts = blocks.paragraphs(docs.select(F.struct("doc_id", "lang").alias("key"), "text"), "key")
    return parts.groupBy(F.col("doc_id.lang").alias("lang")).agg(F.count("*").alias("paragraphs"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(text.utf16_units(F.col("text"))).alias("units"))


def format_detect(spark: SparkSession, d: str) -> DataFrame:
    every = [table(spark, d, t).select(F.lit(t).alias("source_table"), F.col(k).alias("id"), detect.detect_format(F.col(c)).alias("format")) for t, k, c in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("benchmark", "item_id", "text"))]
    return every[0].unionByName(every[1]).unionByName(every[2])


def utf16_units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.utf16_units(F.col("text")).alias("units"), F.octet_length("text").alias("bytes"))


def page_next_paragraph(spark: SparkSession, d: str) -> DataFrame:
    parts = blocks.paragraphs(table(spark, d, "documents")).select("doc_id", "ord")
    return blocks.neighbours(parts, F.col("doc_id"), [F.col("ord")], F.col("ord"))


def edge_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    parts = blocks.paragraphs(table(spark, d, "documents")).where("text <> ''")
    return blocks.edges(parts, "doc_id", "text", "ord")


def text_export(spark: SparkSession, d: str) -> DataFrame:
    return blocks.exported(blocks.paragraphs(table(spark, d, "documents")), "doc_id", "ord", F.col("text"))


def resource_dedupe(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return blocks.deduplicated(docs, F.col("text"), F.col("doc_id")).select("doc_id", "canonical_id")


def text_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "conversations").select("conv_id", "turn", "text")
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    pairs = docs.withColumn("before", before).where("before is not null")
    return pairs.select("conv_id", "turn", blocks.text_diff(F.col("before"), F.col("text")).alias("x")).select("conv_id", "turn", "x.*")


def collapse_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.collapsed(F.col("html")).alias("text"))


def reference_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", text.reference_label(F.col("text")).alias("label"))


def markup_escapes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.html_escaped(F.col("text")).alias("html"), text.markdown_escaped(F.col("text")).alias("markdown"), text.latex_escaped(F.col("text")).alias("latex"))


def rtl_prefilter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.may_be_rtl(F.col("text")).alias("may_be_rtl"))


def font_classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.font_class(F.concat_ws(" ", "p_name", "p_type")).alias("x")).select("p_partkey", "x.class", "x.sure")


def date_pictures(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", text.date_picture(at, "dddd, d MMMM yyyy").alias("long"), text.date_picture(at, "M/d/yyyy").alias("short"), text.date_picture(at, "ddd dd.MM.yy 'at' HH:mm:ss").alias("stamp"))


def invalid_utf8(spark: SparkSession, d: str) -> DataFrame:
    # half of the rows cut within a character or written in one byte each
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1")).alias("raw"))
    return docs.select("doc_id", detect.utf8_or_latin(F.col("raw")).alias("text"))


def checksums(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(t).alias("md5"), F.sha2(t, 256).alias("sha256"), F.octet_length(t).alias("bytes"))


def base64_streams(spark: SparkSession, d: str) -> DataFrame:
    coded = F.regexp_replace(F.base64(F.col("text").cast("binary")), "[^A-Za-z0-9+/=]", "")
    return table(spark, d, "documents").select("doc_id", coded.alias("data"), F.unbase64(coded).cast("string").alias("text"))


_PARAS = """
p AS (SELECT doc_id, lang, string_split_regex(regexp_replace(text, '(\\r\\n|\\n|\\r)$', ''), '\\r\\n|\\n|\\r') AS ls FROM documents),
para AS (SELECT doc_id, lang, i - 1 AS ord, regexp_replace(ls[i], '[\\x00-\\x08\\x0B-\\x1F\\x{FFFC}]', '', 'g') AS text FROM p, unnest(range(1, len(ls) + 1)) AS r(i))
"""

_MD = r"(?s)(?:\A|\n)(?:#[ #].|```.|[-*+] .|> .|\|(?:..+\||.\|.|\|..))|\*\*..|\]\(.."


def _detect(t: str, key: str, col: str) -> str:
    s = f"regexp_replace({col}, '\\A\\x{{FEFF}}?[ \\t\\n\\x0B\\f\\r]*', '')"
    return f"""SELECT '{t}' AS source_table, {key} AS id, CASE
      WHEN starts_with({col}, 'PK' || chr(3) || chr(4)) THEN CASE WHEN contains({col}, 'ppt/presentation.xml') THEN 'pptx' ELSE 'docx' END
      WHEN starts_with({s}, '{{\\rtf') THEN 'rtf'
      WHEN starts_with({s}, '{{') AND strpos({s}[1:209], '_DataInfo_') > 0 AND length({s}) > greatest(12, strpos({s}[1:209], '_DataInfo_') + 9) THEN 'jdata'
      WHEN starts_with({s}, '<') THEN 'html'
      WHEN regexp_matches({s}, '{_MD}') THEN 'markdown' ELSE 'text' END AS format FROM {t}"""


_RTL = "[\\x{0590}-\\x{08FF}\\x{200F}\\x{202B}\\x{202E}\\x{2067}\\x{FB1D}-\\x{FDFF}\\x{FE70}-\\x{FEFF}\\x{10800}-\\x{10FFF}\\x{1E800}-\\x{1EFFF}]"
_LOW = "lower(p_name || ' ' || p_type)"

QUERIES = {f.__name__: f for f in (text_paragraphs, text_paragraph_stats, format_detect, utf16_units, page_next_paragraph, edge_paragraphs, text_export, resource_dedupe, text_diff, collapse_whitespace, reference_labels, markup_escapes, rtl_prefilter, font_classes, date_pictures, invalid_utf8, checksums, base64_streams)}

ORACLE = {
    "text_paragraphs": f"WITH {_PARAS} SELECT doc_id, ord, text FROM para",
    "text_paragraph_stats": f"WITH {_PARAS} SELECT lang, count(*) AS paragraphs, sum(strlen(text)) AS bytes, sum(length(text) + len(regexp_extract_all(text, '[\\x{{10000}}-\\x{{10FFFF}}]'))) AS units FROM para GROUP BY lang",
    "format_detect": " UNION ALL ".join(_detect(*x) for x in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("benchmark", "item_id", "text"))),
    "utf16_units": "SELECT doc_id, length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS units, strlen(text) AS bytes FROM documents",
    "page_next_paragraph": f"WITH {_PARAS} SELECT doc_id, ord, lag(ord) OVER w AS prev_id, lead(ord) OVER w AS next_id FROM para WINDOW w AS (PARTITION BY doc_id ORDER BY ord)",
    "edge_paragraphs": f"WITH {_PARAS} SELECT doc_id, arg_min(text, ord) AS first_id, arg_max(text, ord) AS last_id FROM para WHERE text <> '' GROUP BY doc_id",
    "text_export": f"WITH {_PARAS} SELECT doc_id, string_agg(text, chr(10) ORDER BY ord) AS text FROM para GROUP BY doc_id",
    "resource_dedupe": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical_id FROM documents",
    "text_diff": """
WITH p AS (SELECT conv_id, turn, text AS b, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations),
h AS (SELECT *, (SELECT coalesce(max(k), 0) FROM unnest(range(1, least(length(a), length(b)) + 1)) AS r(k) WHERE left(a, k) = left(b, k)) AS h FROM p WHERE a IS NOT NULL),
t AS (SELECT *, (SELECT coalesce(max(k), 0) FROM unnest(range(1, least(length(a), length(b)) - h + 1)) AS r(k) WHERE right(a, k) = right(b, k)) AS t FROM h)
SELECT conv_id, turn, h AS at, substr(a, h + 1, length(a) - h - t) AS removed, substr(b, h + 1, length(b) - h - t) AS inserted FROM t""",
    "collapse_whitespace": "SELECT page_id, trim(regexp_replace(html, '[ \\t\\n\\x0B\\f\\r\\x00]+', ' ', 'g'), ' ') AS text FROM pages",
    "reference_labels": "SELECT item_id, trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')[1:127] AS label FROM benchmark",
    "markup_escapes": r"""SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html,
      regexp_replace(text, '([\\`*_\[\]<>#|~$])', '\\\1', 'g') AS markdown,
      replace(replace(replace(regexp_replace(replace(text, '\', chr(1)), '([#$%&_{}])', '\\\1', 'g'), '~', '\textasciitilde{}'), '^', '\textasciicircum{}'), chr(1), '\textbackslash{}') AS latex FROM documents""",
    "rtl_prefilter": f"SELECT doc_id, regexp_matches(text, '{_RTL}') AS may_be_rtl FROM documents",
    "font_classes": f"""SELECT p_partkey, CASE WHEN regexp_matches({_LOW}, '{"|".join(text.MONO)}') THEN 'mono' WHEN regexp_matches({_LOW}, '{"|".join(text.SANS)}') OR contains({_LOW}, 'sans') AND NOT contains({_LOW}, 'serif') THEN 'sans' ELSE 'serif' END AS class,
      regexp_matches({_LOW}, '{"|".join([*text.MONO, *text.SANS, *text.SERIF])}') OR contains({_LOW}, 'sans') AND NOT contains({_LOW}, 'serif') AS sure FROM part""",
    "date_pictures": "SELECT o_orderkey, strftime(o_orderdate, '%A, %-d %B %Y') AS long, strftime(o_orderdate, '%-m/%-d/%Y') AS short, strftime(o_orderdate, '%a %d.%m.%y at %H:%M:%S') AS stamp FROM orders",
    "invalid_utf8": "SELECT doc_id, text FROM documents",
    "checksums": "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, strlen(text) AS bytes FROM documents",
    "base64_streams": "SELECT doc_id, to_base64(encode(text)) AS data, text FROM documents",
}
