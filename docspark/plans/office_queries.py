"""Queries of Office, RTF and LaTeX sources, edits, markers, pictures and colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media
from ..functions.text import latex_escaped, rtf_escaped
from ..operators import edits
from ..sources import office
from .common import table


def _turns(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", "\\s+", " ").alias("text"))
    rows = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("r"))
    return rows.select("conv_id", F.transform("r", lambda x: x["text"]).alias("texts"))


def docx_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return office.paragraphs(office.write_docx(_turns(spark, d), "conv_id", "texts"), "conv_id", "content", "docx").select("conv_id", "ord", "role", "text")


def rtf_import(spark: SparkSession, d: str) -> DataFrame:
    body = F.array_join(F.transform("texts", lambda t: F.concat(rtf_escaped(t), F.lit("\\par\n"))), "")
    files = _turns(spark, d).select("conv_id", F.concat(F.lit("{\\rtf1{\\fonttbl{\\f0 Times;}}\\f0\\fs24 "), body, F.lit("}")).cast("binary").alias("content"))
    return office.paragraphs(files, "conv_id", "content", "rtf").select("conv_id", "ord", "text")


def latex_import(spark: SparkSession, d: str) -> DataFrame:
    # all but what LaTeX joins to other characters, or has no escape for
    text = lambda t: latex_escaped(F.regexp_replace(t, "[\\\\{}^~\"'`\\-]", ""))
    body = F.array_join(F.transform("texts", lambda t: F.concat(F.lit("\\section{"), text(t), F.lit("}\n"))), "")
    files = _turns(spark, d).select("conv_id", F.concat(F.lit("\\documentclass{article}\n% no\n\\begin{document}\n"), body, F.lit("\\end{document}")).cast("binary").alias("content"))
    return office.paragraphs(files, "conv_id", "content", "latex").select("conv_id", "ord", "role", "level", F.regexp_replace("text", " +", " ").alias("text"))


def edit_insert_delete(spark: SparkSession, d: str) -> DataFrame:
    t, n = F.col("text"), F.octet_length(F.substring("text", 1, 3))
    return table(spark, d, "documents").select("doc_id", edits.inserted(t, n, F.lit("[new]")).alias("inserted"), edits.deleted(t, F.lit(0), n).alias("deleted"))


def edit_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", F.lit("heading").alias("role"))
    return edits.split(docs, "text", F.octet_length(F.substring("text", 1, 5))).select("doc_id", "half", "role", "text")


def markers(spark: SparkSession, d: str) -> DataFrame:
    o, right = F.col("l_linenumber").cast("int"), F.col("l_returnflag") == "R"
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", edits.marker_after_insert(o, right, F.lit(3), F.lit(10)).alias("after_insert"), edits.marker_after_delete(o, F.lit(2), F.lit(5)).alias("after_delete"), edits.runs_after_insert(o, o + 1, F.lit(3), F.lit(10)).alias("run")).select("l_orderkey", "l_linenumber", "l_partkey", "after_insert", "after_delete", "run.start", "run.end")


def image_info(spark: SparkSession, d: str) -> DataFrame:
    be = lambda v: F.unhex(F.lpad(F.hex(v), 8, "0"))
    w, h = F.col("p_partkey"), F.col("p_size").cast("long")
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), be(w), be(h))
    gif = F.concat(F.unhex(F.lit("474946383961")), F.unhex(F.concat(F.lpad(F.hex(h), 2, "0"), F.lit("000100"))))
    return table(spark, d, "part").select("p_partkey", media.image_info(F.when(F.col("p_partkey") % 3 == 0, gif).when(F.col("p_partkey") % 3 == 1, png).otherwise(F.lit("none").cast("binary"))).alias("x")).select("p_partkey", "x.*")


def theme_colours(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("p_partkey").cast("int") % 16_777_216
    return table(spark, d, "part").select("p_partkey", media.lum_adjusted(c, F.lit(100_000), F.lit(0)).alias("same"), media.lum_adjusted(c, F.lit(0), F.lit(50_000)).alias("half"))


QUERIES = {f.__name__: f for f in (docx_round_trip, rtf_import, latex_import, edit_insert_delete, edit_split, markers, image_info, theme_colours)}

_T = "t AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS ord, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM conversations)"
ORACLE = {
    "docx_round_trip": f"WITH {_T} SELECT conv_id, ord, 'body' AS role, text FROM t",
    "rtf_import": f"WITH {_T} SELECT conv_id, ord, text FROM t",
    "latex_import": f"WITH {_T}, p AS (SELECT conv_id, ord, trim(regexp_replace(regexp_replace(text, '[\\\\{{}}^~\"''`\\-]', '', 'g'), ' +', ' ', 'g')) AS text FROM t) SELECT conv_id, ord, 'heading' AS role, 1 AS level, text FROM p",
    "theme_colours": """WITH p AS (SELECT p_partkey, p_partkey::INT % 16777216 AS c FROM part), h AS (SELECT *, c // 65536 / 255 AS r, c // 256 % 256 / 255 AS g, c % 256 / 255 AS b FROM p),
s AS (SELECT *, greatest(r, g, b) AS t, least(r, g, b) AS l FROM h), z AS (SELECT *, CASE WHEN t - l < 1e-9 THEN 0 WHEN t + l > 1 THEN (t - l) / (2 - t - l) ELSE (t - l) / (t + l) END AS sat FROM s),
k AS (SELECT p_partkey, c, CASE WHEN t - l < 1e-9 THEN [128, 128, 128] ELSE list_transform([r, g, b], lambda x: floor((0.5 - sat / 2 + sat * (x - l) / (t - l)) * 255 + 0.5)::INT) END AS v FROM z)
SELECT p_partkey, c AS same, v[1] * 65536 + v[2] * 256 + v[3] AS half FROM k""",
    "edit_insert_delete": "SELECT doc_id, left(text, 3) || '[new]' || substr(text, 4) AS inserted, substr(text, 4) AS deleted FROM documents",
    "edit_split": "SELECT doc_id, 0 AS half, 'heading' AS role, left(text, 5) AS text FROM documents UNION ALL SELECT doc_id, 1, 'body', substr(text, 6) FROM documents",
    "markers": """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber > 3 OR l_linenumber = 3 AND l_returnflag = 'R' THEN l_linenumber + 10 ELSE l_linenumber END AS after_insert,
  CASE WHEN l_linenumber >= 5 THEN l_linenumber - 3 WHEN l_linenumber > 2 THEN 2 ELSE l_linenumber END AS after_delete, CASE WHEN l_linenumber >= 3 THEN l_linenumber + 10 ELSE l_linenumber END AS start, CASE WHEN l_linenumber + 1 >= 3 THEN l_linenumber + 11 ELSE l_linenumber + 1 END AS "end" FROM lineitem""",
    "image_info": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'image/gif' WHEN 1 THEN 'image/png' END AS mime, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_partkey END AS w, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN p_size END AS h FROM part",
}
