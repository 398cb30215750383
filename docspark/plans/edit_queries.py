"""Queries of edits over ranges, tracked changes, and the direction of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bidi, segment
from ..functions.text import may_be_rtl
from ..operators import breaking, edits, lookups
from .common import dealt, table


def edit_delete_range(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    blocks = table(spark, d, "orders").select("o_custkey", n.alias("ord"), F.concat(F.lit("é"), "o_orderpriority").alias("text"))
    ranges = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("first"), F.lit(3).alias("at"), F.lit(3).alias("last"), F.lit(5).alias("to"))
    return edits.deleted_across(blocks, ranges.where("o_custkey % 3 > 0"), "o_custkey", "ord", "text")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Each customer a block of three runs: plain, put in by A, deleted by B."""
    r = F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(a + 5).alias("end"), F.lit(k).cast("string").alias("kind"), F.lit(w).cast("string").alias("author")) for a, k, w in ((0, None, None), (5, "insert", "A"), (10, "delete", "B"))]))
    return table(spark, d, "customer").select("c_custkey", r.alias("r")).select("c_custkey", "r.*")


def tracked_delete(spark: SparkSession, d: str) -> DataFrame:
    ranges = table(spark, d, "customer").where("c_custkey % 4 < 3").select("c_custkey", F.lit(3).alias("from"), F.lit(12).alias("to"), F.when(F.col("c_custkey") % 2 == 0, "A").otherwise("C").alias("by"))
    return edits.tracked_delete(_runs(spark, d), ranges, "c_custkey")


def resolve_range(spark: SparkSession, d: str) -> DataFrame:
    ranges = table(spark, d, "customer").where("c_custkey % 4 < 3").select("c_custkey", F.lit(7).alias("from"), F.lit(12).alias("to"), (F.col("c_custkey") % 2 == 0).alias("accept"))
    return edits.resolved_range(_runs(spark, d), ranges, "c_custkey")


def next_revision(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    marks = o.where("o_orderstatus = 'P'").select("o_custkey", F.col("o_orderkey").alias("start"))
    return lookups.next_mark(o.select("o_custkey", F.col("o_orderkey").alias("pos")), marks, "o_custkey")


def page_totals(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    c = table(spark, d, "conversations").select("conv_id", F.size(breaking.first_fit_starts(F.col("text"), 400)).alias("n"), F.size(words).alias("w"), F.size(F.filter(words, lambda w: F.length(w) > 40)).alias("over"))
    return c.groupBy("conv_id").agg(F.count("*").alias("paragraphs"), F.sum("n").alias("lines"), F.sum("w").alias("words"), F.sum("over").alias("overfull"))


HEBREW = "אבג"


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    return dealt(table(spark, d, "part"), "p_partkey").select("p_partkey", F.concat("p_name", F.lit(f" {HEBREW} "), "p_partkey").alias("text"))


def bidi_levels(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).select("p_partkey", bidi.bidi_levels("text").alias("levels"))


def visual_order(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).select("p_partkey", bidi.visual_order("text").alias("seen"))


def mixed_direction(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.lit(f"{HEBREW} 12")).otherwise(F.concat("p_name", F.lit(HEBREW)))
    p = dealt(table(spark, d, "part"), "p_partkey").select("p_partkey", text.alias("text"))
    return p.select("p_partkey", segment.direction(F.when(may_be_rtl(F.col("text")), F.col("text"))).alias("direction"))


QUERIES = {f.__name__: f for f in (edit_delete_range, tracked_delete, resolve_range, next_revision, page_totals, bidi_levels, visual_order, mixed_direction)}

_RANGES = "WITH r(k, s, e, kind, author) AS (VALUES {}), c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 0 ELSE 1 + c_custkey % 2 END AS k FROM customer) SELECT c_custkey, s AS start, e AS \"end\", kind, author FROM c JOIN r USING (k)"
_WHOLE = "(0, 0, 5, NULL, NULL), (0, 5, 10, 'insert', 'A'), (0, 10, 15, 'delete', 'B'), "
ORACLE = {
    "edit_delete_range": """WITH o AS (SELECT o_custkey, row_number() OVER w - 1 AS ord, 'é' || o_orderpriority AS text, 'é' || lead(o_orderpriority, 2) OVER w AS tail, count(*) OVER (PARTITION BY o_custkey) > 3 AND o_custkey % 3 > 0 AS cut FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, ord, CASE WHEN cut AND ord = 1 THEN left(text, 2) || substr(tail, 5) ELSE text END AS text FROM o WHERE NOT (cut AND ord IN (2, 3))""",
    "tracked_delete": _RANGES.format(_WHOLE + "(1, 0, 3, NULL, NULL), (1, 3, 5, 'delete', 'A'), (1, 10, 12, 'delete', 'B'), (1, 12, 15, 'delete', 'B'), (2, 0, 3, NULL, NULL), (2, 3, 5, 'delete', 'C'), (2, 5, 10, 'delete', 'C'), (2, 10, 12, 'delete', 'B'), (2, 12, 15, 'delete', 'B')"),
    "resolve_range": _RANGES.format(_WHOLE + "(1, 0, 5, NULL, NULL), (1, 5, 7, 'insert', 'A'), (1, 7, 10, NULL, NULL), (1, 12, 15, 'delete', 'B'), (2, 0, 5, NULL, NULL), (2, 5, 7, 'insert', 'A'), (2, 10, 12, NULL, NULL), (2, 12, 15, 'delete', 'B')"),
    "next_revision": "SELECT o_custkey, o_orderkey AS pos, min(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_start, max(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_start FROM orders",
    "page_totals": """WITH RECURSIVE w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM conversations),
s AS (SELECT conv_id, turn, ws, 1 AS i, length(ws[1]) * 10 AS x, 1 AS line FROM w WHERE len(ws) > 0
  UNION ALL SELECT conv_id, turn, ws, i + 1, CASE WHEN x + 10 + length(ws[i + 1]) * 10 <= 400 THEN x + 10 + length(ws[i + 1]) * 10 ELSE length(ws[i + 1]) * 10 END, CASE WHEN x + 10 + length(ws[i + 1]) * 10 <= 400 THEN line ELSE line + 1 END FROM s WHERE i < len(ws)),
l AS (SELECT conv_id, turn, max(line) AS n, count(*) AS words, count(*) FILTER (length(ws[i]) > 40) AS over FROM s GROUP BY 1, 2)
SELECT conv_id, count(*) AS paragraphs, coalesce(sum(n), 0) AS lines, coalesce(sum(words), 0) AS words, coalesce(sum(over), 0) AS overfull FROM conversations LEFT JOIN l USING (conv_id, turn) GROUP BY 1""",
    "bidi_levels": "SELECT p_partkey, list_concat(list_transform(range(0, length(p_name) + 1), lambda i: 0), list_concat([1, 1, 1, 1], list_transform(range(0, length(p_partkey::VARCHAR)), lambda i: 2))) AS levels FROM part",
    "visual_order": f"SELECT p_partkey, p_name || ' ' || p_partkey || ' {HEBREW[::-1]}' AS seen FROM part",
    "mixed_direction": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS direction FROM part",
}
