"""Queries of page text, line breaking, hyphenation and bibliographies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import purified
from ..operators import breaking, lookups, pagetext
from ..sources import bibtex
from .common import table


def _chars(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation set on one page, 80 characters of 6 points to a line, a
    first turn in a larger size; spaces are not set, so that gaps must tell."""
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("page"), "turn", F.posexplode(F.split("text", "")).alias("j", "c"))
    size = F.when(F.col("turn") == 0, 10.0).otherwise(8.0)
    x = (F.col("j") % 80) * 6.0
    y = F.col("turn") * 400.0 + F.floor(F.col("j") / 80) * 11.0
    rows = t.where("c <> ' ' and c <> ''").select("page", (F.col("turn") * 1_000_000 + F.col("j")).alias("idx"), F.ascii("c").alias("cp"), x.alias("x0"), y.alias("y0"), (x + 6).alias("x1"), (y + size).alias("y1"), size.alias("size"))
    return rows


def pdf_lines(spark: SparkSession, d: str) -> DataFrame:
    return pagetext.lines(_chars(spark, d), ["page"])


def pdf_blocks(spark: SparkSession, d: str) -> DataFrame:
    return pagetext.blocks(pagetext.lines(_chars(spark, d), ["page"]), ["page"])


def first_fit_lines(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", F.posexplode(breaking.first_fit_starts(F.col("text"), 400)).alias("line", "first_word"))


def knuth_plass_lines(spark: SparkSession, d: str) -> DataFrame:
    return breaking.fitted(table(spark, d, "conversations"), ["conv_id", "turn"], "text", 400)


def loose_lines(spark: SparkSession, d: str) -> DataFrame:
    return breaking.fitted(table(spark, d, "conversations"), ["conv_id", "turn"], "text", 400, looseness=1)


def fit_demerits(spark: SparkSession, d: str) -> DataFrame:
    """The least demerits of each paragraph, which its SQL finds by the same program."""
    return breaking.fitted(table(spark, d, "conversations"), ["conv_id", "turn"], "text", 400).select("conv_id", "turn", "demerits")


#: Patterns of a few syllables, as letters and the digits around them.
PATTERNS = [("th", [0, 0, 0]), ("on", [1, 0, 0]), ("er", [0, 0, 1]), ("an", [0, 2, 1]), (".th", [0, 0, 0, 2]), ("nt", [0, 3, 0]), ("he", [0, 0, 1]), ("in.", [2, 0, 0, 0])]


def hyphen_points(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "conversations").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w"))
    patterns = spark.createDataFrame(PATTERNS, "letters string, digits array<int>")
    return breaking.hyphen_points(words, "w", F.broadcast(patterns), longest=3)


def bib_sort(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").select("p_partkey", F.concat(purified(F.col("p_name")), F.lit("\x01"), F.col("p_size").cast("string"), F.lit("\x01"), purified(F.col("p_type"))).alias("sortkey"))
    return lookups.ranked(c, ["sortkey", "p_partkey"], "ord")


def _bib(spark: SparkSession, d: str) -> DataFrame:
    """A bibliography file for each region: its own entry, then the nations', which cross-refer to it."""
    n = table(spark, d, "nation")
    entry = F.concat(F.lit("@InBook{n"), "n_nationkey", F.lit(", title = {"), "n_name", F.lit('},\n crossref = "R'), "n_regionkey", F.lit('", year = 19 # "'), F.col("n_nationkey") + 60, F.lit('", journaltitle = pub # { Press}, month = jan}\n'))
    per = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", entry.alias("e")))), lambda x: x["e"]), "").alias("e"))
    r = table(spark, d, "region")
    head = F.concat(F.lit('@string{pub = "The"}\n@comment{x}\n@book(r'), "r_regionkey", F.lit(", title = {{"), "r_name", F.lit("} {All}}, publisher = pub # { House})\n"))
    return r.join(per, r.r_regionkey == per.n_regionkey).select("r_regionkey", F.concat(head, "e").alias("text"))


def bib_entries(spark: SparkSession, d: str) -> DataFrame:
    e = bibtex.entries(_bib(spark, d), "r_regionkey", "text")
    return e.select("r_regionkey", "ord", "type", "key", F.explode("fields").alias("field", "value"))


def crossref_inherit(spark: SparkSession, d: str) -> DataFrame:
    e = bibtex.crossrefs(bibtex.entries(_bib(spark, d), "r_regionkey", "text"), ["r_regionkey"])
    return e.select("r_regionkey", "ord", "type", "key", F.explode("fields").alias("field", "value"))


_BIB = """n AS (SELECT n_regionkey AS r_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS ord, 'inbook' AS type, 'n' || n_nationkey AS key, n_name, n_nationkey FROM nation),
r AS (SELECT r_regionkey, 0 AS ord, 'book' AS type, 'r' || r_regionkey AS key, r_name FROM region),
f AS (SELECT r_regionkey, ord, type, key, 'title' AS field, n_name AS value FROM n UNION ALL SELECT r_regionkey, ord, type, key, 'crossref', 'R' || r_regionkey FROM n
  UNION ALL SELECT r_regionkey, ord, type, key, 'year', '19' || (n_nationkey + 60) FROM n UNION ALL SELECT r_regionkey, ord, type, key, 'journal', 'The Press' FROM n UNION ALL SELECT r_regionkey, ord, type, key, 'month', 'January' FROM n
  UNION ALL SELECT r_regionkey, ord, type, key, 'title', '{' || r_name || '} {All}' FROM r UNION ALL SELECT r_regionkey, ord, type, key, 'publisher', 'The House' FROM r)"""
_CHARS = """t AS (SELECT conv_id AS page, turn, j - 1 AS j, text[j] AS c FROM conversations, unnest(range(1, length(text) + 1)) AS r(j)),
ch AS (SELECT page, turn * 1000000 + j AS idx, turn, j // 80 AS row, j % 80 AS k, ascii(c) AS cp, CASE WHEN turn = 0 THEN 10.0 ELSE 8.0 END AS size FROM t WHERE c <> ' '),
ln AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY turn, row) AS line_no, min(k) * 6.0 AS x0, turn * 400.0 + row * 11.0 AS y0, max(k) * 6.0 + 6 AS x1, turn * 400.0 + row * 11.0 + max(size) AS y1, max(size) AS size, count(*) AS n, arg_min(cp, idx) AS first_cp, turn FROM ch GROUP BY page, turn, row)"""

QUERIES = {f.__name__: f for f in (pdf_lines, pdf_blocks, first_fit_lines, knuth_plass_lines, loose_lines, fit_demerits, hyphen_points, bib_sort, bib_entries, crossref_inherit)}

ORACLE = {
    "pdf_lines": f"WITH {_CHARS} SELECT page, line_no, x0, y0, x1, y1, size, n, first_cp FROM ln",
    "pdf_blocks": f"""WITH {_CHARS}, k AS (SELECT *, sum(CASE WHEN line_no = 1 OR turn <> was OR least(x1, w1) - greatest(x0, w0) <= 0 OR first_cp IN ({", ".join(map(str, pagetext.BULLETS))}) THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line_no) AS block_no FROM (SELECT *, lag(turn) OVER o AS was, lag(x0) OVER o AS w0, lag(x1) OVER o AS w1 FROM ln WINDOW o AS (PARTITION BY page ORDER BY line_no))),
b AS (SELECT page, block_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(size) AS size, count(*) AS lines, max(x0) - min(x0) AS l, max((x0 + x1) / 2) - min((x0 + x1) / 2) AS m, max(x1) - min(x1) AS r FROM k GROUP BY 1, 2)
SELECT page, block_no, x0, y0, x1, y1, size, lines, CASE WHEN lines < 2 OR l <= size / 2 THEN 0 WHEN m <= size / 2 THEN 1 WHEN r <= size / 2 THEN 2 ELSE 0 END AS align FROM b""",
    "first_fit_lines": """WITH RECURSIVE w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM conversations),
s AS (SELECT conv_id, turn, ws, 1 AS i, length(ws[1]) * 10 AS x, 0 AS line FROM w WHERE len(ws) > 0
  UNION ALL SELECT conv_id, turn, ws, i + 1, CASE WHEN x + 10 + length(ws[i + 1]) * 10 <= 400 THEN x + 10 + length(ws[i + 1]) * 10 ELSE length(ws[i + 1]) * 10 END, CASE WHEN x + 10 + length(ws[i + 1]) * 10 <= 400 THEN line ELSE line + 1 END FROM s WHERE i < len(ws))
SELECT conv_id, turn, line, min(i) - 1 AS first_word FROM s GROUP BY conv_id, turn, line""",
    "fit_demerits": """WITH RECURSIVE w AS (SELECT conv_id, turn, list_transform(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''), lambda x: length(x) * 10) AS ws FROM conversations),
s AS (SELECT conv_id, turn, list_transform(range(0, len(ws) + 1), lambda i: CASE WHEN i = 0 THEN 0 ELSE list_sum(ws[1:i]) + 10 * i END::BIGINT) AS pre, len(ws) AS n, 0::BIGINT AS b, [[NULL, NULL, 0::HUGEINT, NULL]] AS best FROM w
UNION ALL SELECT conv_id, turn, pre, n, b + 1, list_concat(best[-23:], [CASE WHEN len(e) = 0 THEN [NULL, NULL, list_min(best[-1]) + 1125899906842624, NULL]
    ELSE list_transform([0, 1, 2, 3], lambda g: list_min(list_transform(list_filter(e, lambda c: c.fit = g), lambda c: c.t))) END])
  FROM (SELECT conv_id, turn, pre, n, b, best, list_transform(f, lambda c: {'fit': c.fit, 't': (10 + c.cost) * (10 + c.cost) + list_min(list_transform([0, 1, 2, 3], lambda g: c.pv[g + 1] + CASE WHEN c.a > 0 AND abs(g - c.fit) > 1 THEN 10000 ELSE 0 END))}) AS e
    FROM (SELECT conv_id, turn, pre, n, b, best, list_transform(k, lambda c: {'a': c.a, 'pv': c.pv, 'cost': c.cost, 'fit': CASE WHEN c.nat > 400 THEN CASE WHEN c.cost > 12 THEN 3 ELSE 2 END WHEN c.cost > 99 THEN 0 WHEN c.cost > 12 THEN 1 ELSE 2 END}) AS f
      FROM (SELECT conv_id, turn, pre, n, b, best, list_transform(list_filter(list_transform(range(1, least(24, b + 1) + 1), lambda w: {'w': w, 'a': b + 1 - w, 'nat': pre[b + 2] - 10 - pre[b + 2 - w], 'pv': best[len(best) + 1 - w]}), lambda c: c.nat - 3 * (c.w - 1) <= 400),
          lambda c: {'a': c.a, 'pv': c.pv, 'nat': c.nat, 'cost': CASE WHEN c.nat = 400 OR (c.nat < 400 AND b + 1 = n) THEN 0::HUGEINT WHEN c.w = 1 THEN 1000000000::HUGEINT
            ELSE least(1000000000::HUGEINT, least(100000, abs(400 - c.nat) * 1000 // ((c.w - 1) * CASE WHEN c.nat < 400 THEN 5 ELSE 3 END))::HUGEINT * least(100000, abs(400 - c.nat) * 1000 // ((c.w - 1) * CASE WHEN c.nat < 400 THEN 5 ELSE 3 END)) * least(100000, abs(400 - c.nat) * 1000 // ((c.w - 1) * CASE WHEN c.nat < 400 THEN 5 ELSE 3 END)) // 10000000) END}) AS k FROM s WHERE b < n))))
SELECT conv_id, turn, list_min(best[-1]) AS demerits FROM s WHERE b = n""",
    "hyphen_points": f"""WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM conversations) WHERE length(word) BETWEEN 5 AND 250),
p(letters, digits) AS (VALUES {", ".join(f"('{a}', {b})" for a, b in PATTERNS)}),
m AS (SELECT word, i + k - 3 AS p, max(digits[k]) AS d FROM w, p, unnest(range(1, length(word) + 3)) AS a(i), unnest(range(1, 5)) AS b(k)
  WHERE substr('.' || word || '.', i, length(letters)) = letters AND i + length(letters) - 1 <= length(word) + 2 AND k <= len(digits) GROUP BY 1, 2)
SELECT word, list(p ORDER BY p) AS points FROM m WHERE d % 2 = 1 AND p BETWEEN 2 AND length(word) - 3 GROUP BY word""",
    "bib_sort": "SELECT p_partkey, sortkey, row_number() OVER (ORDER BY sortkey, p_partkey) AS ord FROM (SELECT p_partkey, lower(regexp_replace(replace(p_name, ',', ' '), '[^A-Za-z0-9 ]', '', 'g')) || chr(1) || p_size || chr(1) || lower(regexp_replace(replace(p_type, ',', ' '), '[^A-Za-z0-9 ]', '', 'g')) AS sortkey FROM part)",
    "bib_entries": f"WITH {_BIB} SELECT * FROM f",
    "crossref_inherit": f"""WITH {_BIB} SELECT * FROM f UNION ALL SELECT n.r_regionkey, n.ord, n.type, n.key, 'booktitle', '{{' || r_name || '}} {{All}}' FROM n JOIN r USING (r_regionkey) UNION ALL SELECT n.r_regionkey, n.ord, n.type, n.key, 'publisher', 'The House' FROM n""",
}
