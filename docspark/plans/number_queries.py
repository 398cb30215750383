"""Queries of number formats, counters, labels, cross-references and headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import numbering
from .common import table


def _numbers(spark: SparkSession, d: str, formats: list[str]) -> DataFrame:
    v = (F.col("p_partkey") - 3).cast("int")
    return table(spark, d, "part").select("p_partkey", *[numbers.format_number(v, f).alias(f) for f in formats])


def number_roman(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(spark, d, ["lowerroman", "upperroman"])


def number_alpha(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(spark, d, ["loweralpha", "upperalpha"])


def number_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(spark, d, ["ordinal", "decimalzero", "decimal", "none"])


def number_words(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(spark, d, ["cardinaltext", "ordinaltext"])


def number_cjk(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(spark, d, ["cjkcounting", "cjktraditional", "fullwidth"])


def number_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(spark, d, ["symbol", "circled"])


def chart_number_format(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", numbers.chart_number(v, "#,##0.00").alias("grouped"), numbers.chart_number(v / 10_000, "0.0000%;-0.0%").alias("percent"), numbers.chart_number(v, "0").alias("whole"))


def seq_counter(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return numbering.sequence_numbers(orders, [F.col("o_custkey")], F.col("o_orderpriority"), [F.col("o_orderkey")])


#: An order of lines that leaves no ties: a line's keys may be repeated.
TOTAL_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag"]


def note_restart(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumn("endnote", F.col("l_returnflag") == "R")
    return numbering.note_numbers(lines, [F.col("l_suppkey")], F.col("endnote"), [F.col(c) for c in TOTAL_ORDER], [F.floor(F.col("l_orderkey") / 100)], 5).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "note_no_export", "note_no_layout")


_LEVEL = "(l_partkey % 3)"


_READ = ["l_orderkey", "l_linenumber", "l_partkey"]


def _items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr(_LEVEL).cast("int").alias("level"))
    return items.withColumn("seq", F.row_number().over(W.partitionBy("l_suppkey").orderBy(*_READ)))


def list_labels(spark: SparkSession, d: str) -> DataFrame:
    counted = numbering.list_counters(_items(spark, d), [F.col("l_suppkey")], F.col("level"), [F.col(c) for c in _READ], 3, [1, 1, 4])
    shown = [numbers.format_number(F.col(f"c{k}"), f) for k, f in enumerate(("decimal", "loweralpha", "lowerroman"))]
    label = F.when(F.col("list_lv") == 0, numbering.list_label("%1.", shown)).when(F.col("list_lv") == 1, numbering.list_label("%1.%2)", shown)).otherwise(numbering.list_label("(%3)", shown))
    return counted.select("l_suppkey", "seq", "level", label.alias("label"))


def list_labels_general(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d).select("l_suppkey", "seq", "level")
    counted = numbering.folded_counters(items, ["l_suppkey"], ["seq"], "level", [(1, 0), (1, 0), (4, 0)])
    return counted.select("l_suppkey", "seq", F.get("counters", F.col("level")).alias("value"))


def task_labels(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("l_linenumber").cast("int")
    label = numbering.list_label("%1.", [numbers.format_number(v, "decimal")])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", numbers.task_label(label, F.col("l_partkey") % 3, F.col("l_suppkey") % 2 == 0).alias("label"))


def cross_references(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "customer").select("c_custkey")
    targets = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderpriority").alias("value"))
    return numbering.reference_numbers(refs, targets, ["c_custkey"], "value", ["o_orderkey"])


def running_heading(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", (F.col("event_id") % 3).alias("level"))
    return numbering.running_heading(rows, [F.col("user_id")], [F.col("ts"), F.col("event_id")], F.col("level"), F.col("event_type"), 1).select("event_id", "running")


def line_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_linestatus") == "O").alias("body"))
    return numbering.line_numbers(rows, [F.col("l_suppkey")], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 5, F.col("body")).select("l_orderkey", "l_linenumber", "l_partkey", "line_no", "shown")


_V = "(p_partkey - 3)"
_ROMAN = "[" + ", ".join("['" + "', '".join(r) + "']" for r in numbers.ROMAN) + "]"
_LR = f"CASE WHEN v <= 0 THEN v::VARCHAR WHEN v >= 4000 THEN '' ELSE r[1][v // 1000 + 1] || r[2][v // 100 % 10 + 1] || r[3][v // 10 % 10 + 1] || r[4][v % 10 + 1] END"


def _list(values: list[str]) -> str:
    return "['" + "', '".join(values) + "']"


def _word(small: list[str], tens: list[str]) -> str:
    return f"CASE WHEN v <= 0 OR v >= 100 THEN v::VARCHAR WHEN v < 20 THEN {_list(small)}[v + 1] WHEN v % 10 = 0 THEN {_list(tens)}[v // 10 + 1] ELSE {_list(numbers.TENS)}[v // 10 + 1] || '-' || lower({_list(small)}[v % 10 + 1]) END"


# counting: spell every digit with its unit, join gaps to one zero, trim
_HAN = f"""CASE WHEN v <= 0 OR v >= 100000 THEN v::VARCHAR ELSE
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(range(0, length(v::VARCHAR)), lambda i: CASE WHEN substr(v::VARCHAR, i + 1, 1) = '0' THEN '零' ELSE {_list(list(numbers.HAN))}[substr(v::VARCHAR, i + 1, 1)::INT + 1] || ['', '十', '百', '千', '万'][length(v::VARCHAR) - i] END), ''), '零+', '零', 'g'), '零$', ''), '^一十', '十'), '^零', '') END"""
_ITEMS = f"""it AS (SELECT l_suppkey, {_LEVEL} AS level, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS seq FROM lineitem),
s AS (SELECT *, coalesce(max(CASE WHEN level < 1 THEN seq END) OVER w, 0) AS b1, coalesce(max(CASE WHEN level < 2 THEN seq END) OVER w, 0) AS b2 FROM it WINDOW w AS (PARTITION BY l_suppkey ORDER BY seq)),
c AS (SELECT *, count(CASE WHEN level = 0 THEN 1 END) OVER (PARTITION BY l_suppkey ORDER BY seq) AS c0,
      count(CASE WHEN level = 1 THEN 1 END) OVER (PARTITION BY l_suppkey, b1 ORDER BY seq) AS c1,
      count(CASE WHEN level = 2 THEN 1 END) OVER (PARTITION BY l_suppkey, b2 ORDER BY seq) AS n2 FROM s)"""

QUERIES = {f.__name__: f for f in (number_roman, number_alpha, number_ordinal, number_words, number_cjk, number_symbols, chart_number_format, seq_counter, note_restart, list_labels, list_labels_general, task_labels, cross_references, running_heading, line_numbers)}

ORACLE = {
    "number_roman": f"SELECT p_partkey, {_LR} AS lowerroman, CASE WHEN v <= 0 THEN v::VARCHAR ELSE upper({_LR}) END AS upperroman FROM (SELECT p_partkey, {_V} AS v, {_ROMAN} AS r FROM part)",
    "number_alpha": f"SELECT p_partkey, CASE WHEN v <= 0 THEN v::VARCHAR ELSE s END AS loweralpha, CASE WHEN v <= 0 THEN v::VARCHAR ELSE upper(s) END AS upperalpha FROM (SELECT p_partkey, {_V} AS v, CASE WHEN {_V} > 18278 THEN chr((97 + ({_V} - 18279) // 17576 % 26)::INT) ELSE '' END || CASE WHEN {_V} > 702 THEN chr((97 + ({_V} - 703) // 676 % 26)::INT) ELSE '' END || CASE WHEN {_V} > 26 THEN chr((97 + ({_V} - 27) // 26 % 26)::INT) ELSE '' END || chr((97 + greatest(0, {_V} - 1) % 26)::INT) AS s FROM part)",
    "number_ordinal": f"""SELECT p_partkey, CASE WHEN v <= 0 THEN v::VARCHAR ELSE v::VARCHAR || CASE WHEN v % 100 IN (11, 12, 13) THEN 'th' WHEN v % 10 = 1 THEN 'st' WHEN v % 10 = 2 THEN 'nd' WHEN v % 10 = 3 THEN 'rd' ELSE 'th' END END AS ordinal,
      CASE WHEN v BETWEEN 1 AND 9 THEN '0' ELSE '' END || v::VARCHAR AS decimalzero, v::VARCHAR AS decimal, CASE WHEN v <= 0 THEN v::VARCHAR ELSE '' END AS none FROM (SELECT p_partkey, {_V} AS v FROM part)""",
    "number_words": f"SELECT p_partkey, {_word(numbers.CARDINAL, numbers.TENS)} AS cardinaltext, {_word(numbers.ORDINAL, numbers.TENTHS)} AS ordinaltext FROM (SELECT p_partkey, {_V} AS v FROM part)",
    "number_cjk": f"""SELECT p_partkey, {_HAN} AS cjkcounting, CASE WHEN v BETWEEN 1 AND 10 THEN substr('{numbers.STEMS}', v, 1) ELSE v::VARCHAR END AS cjktraditional,
      CASE WHEN v <= 0 THEN v::VARCHAR ELSE translate(v::VARCHAR, '0123456789', '０１２３４５６７８９') END AS fullwidth FROM (SELECT p_partkey, {_V} AS v FROM part)""",
    "number_symbols": f"SELECT p_partkey, CASE WHEN v <= 0 THEN v::VARCHAR ELSE repeat(substr('{numbers.SYMBOLS}', (v - 1) % 4 + 1, 1), least(8, (v - 1) // 4 + 1)::INT) END AS symbol, CASE WHEN v BETWEEN 1 AND 20 THEN chr((9311 + v)::INT) ELSE v::VARCHAR END AS circled FROM (SELECT p_partkey, {_V} AS v FROM part)",
    "chart_number_format": "SELECT p_partkey, format('{:,.2f}', p_retailprice) AS grouped, printf('%.4f', p_retailprice / 10000 * 100) || '%' AS percent, printf('%.0f', p_retailprice) AS whole FROM part",
    "seq_counter": "SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS seq_no FROM orders",
    "note_restart": "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY " + ", ".join(TOTAL_ORDER) + ") AS note_no_export, 4 + row_number() OVER (PARTITION BY l_suppkey, l_returnflag = 'R', l_orderkey // 100 ORDER BY " + ", ".join(TOTAL_ORDER) + ") AS note_no_layout FROM lineitem",
    "list_labels": f"""WITH {_ITEMS}, f AS (SELECT *, CASE WHEN n2 > 0 THEN n2 + 3 ELSE 0 END AS c2, {_ROMAN} AS r FROM c)
SELECT l_suppkey, seq, level, CASE level WHEN 0 THEN c0::VARCHAR || '.' WHEN 1 THEN c0::VARCHAR || '.' || CASE WHEN c1 = 0 THEN '0' ELSE CASE WHEN c1 > 702 THEN chr((97 + (c1 - 703) // 676 % 26)::INT) ELSE '' END || CASE WHEN c1 > 26 THEN chr((97 + (c1 - 27) // 26 % 26)::INT) ELSE '' END || chr((97 + (c1 - 1) % 26)::INT) END || ')'
  ELSE '(' || r[3][c2 // 10 % 10 + 1] || r[4][c2 % 10 + 1] || ')' END AS label FROM f""",
    "list_labels_general": f"WITH {_ITEMS} SELECT l_suppkey, seq, CASE level WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE n2 + 3 END AS value FROM c",
    "task_labels": "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN l_linenumber::VARCHAR || '.' WHEN l_suppkey % 2 = 0 THEN b ELSE l_linenumber::VARCHAR || '. ' || b END AS label FROM (SELECT *, CASE WHEN l_partkey % 3 = 2 THEN '☑' ELSE '☐' END AS b FROM lineitem)",
    "cross_references": "SELECT c_custkey, coalesce(v, '??') AS ref_text FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "running_heading": """SELECT event_id, coalesce(last_value(CASE WHEN event_id % 3 = 1 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id, ch ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), '') AS running
FROM (SELECT *, count(CASE WHEN event_id % 3 < 1 THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ch FROM events)""",
    "line_numbers": "SELECT l_orderkey, l_linenumber, l_partkey, n AS line_no, CASE WHEN n % 5 = 0 THEN n END AS shown FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN row_number() OVER (PARTITION BY l_suppkey, l_linestatus = 'O' ORDER BY l_orderkey, l_linenumber, l_partkey) END AS n FROM lineitem)",
}
