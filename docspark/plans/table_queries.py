"""Queries of charts, table grids and styles over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import nice_axis
from ..operators import charts, grid, styles
from .common import table


def _points(spark: SparkSession, d: str) -> DataFrame:
    """A chart for each line status: series are return flags, categories months of the
    year, values whole numbers of either sign, so that sums are exact."""
    v = F.when(F.col("l_suppkey") % 3 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("chart"), F.col("l_returnflag").alias("ser"), F.month("l_shipdate").alias("idx")).agg(F.sum(v).alias("v"))


def chart_percent_stack(spark: SparkSession, d: str) -> DataFrame:
    return charts.percent_stack(_points(spark, d), ["chart"], "idx", "v").withColumn("share", F.round("share", 6))


def chart_stack_bands(spark: SparkSession, d: str) -> DataFrame:
    return charts.stack_bands(_points(spark, d), ["chart"], "idx", "ser", "v")


def chart_axis(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    both = [charts.value_axis(p, ["chart"], "idx", "v", stacked).withColumn("stacked", F.lit(stacked)) for stacked in (False, True)]
    return both[0].unionByName(both[1])


def chart_trend(spark: SparkSession, d: str) -> DataFrame:
    return charts.trend(_points(spark, d), ["chart", "ser"], F.col("idx"), "v").select("chart", "ser", F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept"))


def chart_pie(spark: SparkSession, d: str) -> DataFrame:
    got = charts.pie(_points(spark, d), ["chart", "ser"], "idx", "v", 30.0)
    return got.select("chart", "ser", "idx", *[F.round(c, 6).alias(c) for c in ("share", "angle_from", "angle_to")])


def nice_steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", nice_axis(F.least("c_acctbal", F.lit(0.0)), F.greatest("c_acctbal", F.lit(0.0))).alias("x")).select("c_custkey", F.round("x.a", 6).alias("a"), F.round("x.b", 6).alias("b"), F.round("x.step", 6).alias("step"))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as the rows of a table: three cells a line, one spanning."""
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("tab"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("row"), "l_partkey", "l_suppkey", "l_quantity")
    three = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("span"), (F.col(c).cast("int") % m + 10).alias("least")) for k, s, c, m in ((0, 1, "l_partkey", 37), (1, 2, "l_suppkey", 11), (2, 1, "l_quantity", 23))]))
    return lines.distinct().select("tab", "row", three.alias("x")).select("tab", "row", "x.*").withColumn("most", F.col("least") * 3)


def grid_columns(spark: SparkSession, d: str) -> DataFrame:
    cells = grid.placed(_cells(spark, d), "tab", "row", "k", "span")
    return cells.select("tab", "row", "k", "col")


def grid_widths(spark: SparkSession, d: str) -> DataFrame:
    return grid.column_widths(_needs(spark, d), "tab", "col", 170)


def _needs(spark: SparkSession, d: str) -> DataFrame:
    return grid.column_needs(grid.placed(_cells(spark, d), "tab", "row", "k", "span"), "tab", "col", "span", ["row", "k"], "least", "most")


def grid_fixed_widths(spark: SparkSession, d: str) -> DataFrame:
    needs = _needs(spark, d).withColumns({"fixed": F.when((F.col("tab") % 2 == 0) & (F.col("col") == 0), 60), "pref": F.when((F.col("tab") % 3 == 0) & (F.col("col") == 3), 25)})
    return grid.column_widths(needs, "tab", "col", 400, stretch=True).select("tab", "col", "mn", "mx", "width", "x")


def grid_width(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d).withColumn("free", F.col("tab") % 3)
    return grid.grid_width(cells, "tab", "row", "span", F.col("free"))


def cell_parts(spark: SparkSession, d: str) -> DataFrame:
    row, col = F.col("l_linenumber").cast("int") - 1, (F.col("l_partkey") % 4).cast("int")
    parts = styles.cell_parts(row, col, F.lit(7), col == 3, row_band=2)
    shading = {"whole": "white", "band1_v": "grey", "band2_h": "blue", "first_row": "black", "last_col": "red", "se": "green"}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(parts, " ").alias("parts"), styles.merged(parts, shading).alias("shading"))


def table_parts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    rows = n.select((F.col("l_linenumber") - 1).alias("r"), (F.col("l_partkey") % 4).alias("c"), "l_orderkey", "l_linenumber", "l_partkey")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", styles.table_part(F.col("r"), F.col("c"), F.lit(7), F.lit(4)).alias("part"))


def style_inherit(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as one chain of styles; properties are set here and there."""
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("font"), F.lit(10.0).alias("size"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).alias("font"), F.lit(None).cast("double").alias("size"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).alias("font"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("size"))
    return styles.inherited(r.unionByName(n).unionByName(c), "id", "parent", ["font", "size"])


def adopt_styles(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("name")).agg(F.lit("paragraph").alias("kind"), F.max("c_mktsegment").alias("font"))
    template = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("name")).agg(F.lit("paragraph").alias("kind"), F.max("s_name").alias("font"))
    kind = F.when(F.col("name") % 4 == 0, "table").otherwise(F.col("kind"))
    return styles.adopted(own, template.withColumn("kind", kind), "name", "kind", ["font"])


_P = "p AS (SELECT l_linestatus AS chart, l_returnflag AS ser, month(l_shipdate) AS idx, sum(CASE WHEN l_suppkey % 3 = 0 THEN -l_quantity ELSE l_quantity END) AS v FROM lineitem GROUP BY 1, 2, 3)"
_NICE = """, x AS (SELECT *, CASE WHEN hi0 <= lo THEN lo + CASE WHEN lo = 0 THEN 1 ELSE abs(lo) END ELSE hi0 END AS hi1 FROM e),
y AS (SELECT *, pow(10, floor(log10((hi1 - lo) / 8))) AS m FROM x), z AS (SELECT *, CASE WHEN (hi1 - lo) / 8 / m < 1.5 THEN 1 WHEN (hi1 - lo) / 8 / m < 3 THEN 2 WHEN (hi1 - lo) / 8 / m < 7 THEN 5 ELSE 10 END * m AS step FROM y),
w AS (SELECT *, floor(lo / step + 1e-9) * step AS a, ceil(hi1 / step - 1e-9) * step AS b0 FROM z)"""
_CELLS = """cells AS (SELECT tab, row, k, span, m AS least, 3 * m AS most FROM (SELECT DISTINCT l_orderkey % 500 AS tab, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT) AS row, l_partkey, l_suppkey, l_quantity FROM lineitem) q,
  LATERAL (VALUES (0, 1, q.l_partkey::INT % 37 + 10), (1, 2, q.l_suppkey::INT % 11 + 10), (2, 1, q.l_quantity::INT % 23 + 10)) AS v(k, span, m))"""
_NEEDS = """one AS (SELECT tab, CASE k WHEN 0 THEN 0 ELSE 3 END AS col, max(least) AS mn, max(most) AS mx FROM cells WHERE span = 1 GROUP BY 1, 2),
two AS (SELECT tab, max(least) // 2 AS mn, max(most) // 2 AS mx FROM cells WHERE span = 2 GROUP BY 1), n AS (SELECT * FROM one UNION ALL SELECT tab, 1, mn, mx FROM two UNION ALL SELECT tab, 2, mn, mx FROM two)"""

QUERIES = {f.__name__: f for f in (chart_percent_stack, chart_stack_bands, chart_axis, chart_trend, chart_pie, nice_steps, grid_columns, grid_widths, grid_fixed_widths, grid_width, cell_parts, table_parts, style_inherit, adopt_styles)}

ORACLE = {
    "chart_percent_stack": f"WITH {_P} SELECT chart, ser, idx, v, round(CASE WHEN t > 0 THEN v / t ELSE v END, 6) AS share FROM (SELECT *, sum(abs(v)) OVER (PARTITION BY chart, idx) AS t FROM p)",
    "chart_stack_bands": f"WITH {_P} SELECT chart, ser, idx, v, s - v AS v0, s AS v1 FROM (SELECT *, sum(v) OVER (PARTITION BY chart, idx, v >= 0 ORDER BY ser) AS s FROM p)",
    "chart_axis": f"""WITH {_P}, c AS (SELECT chart, idx, sum(greatest(v, 0)) AS up, sum(least(v, 0)) AS dn FROM p GROUP BY 1, 2),
e AS (SELECT chart, least(min(v), 0) AS lo, greatest(max(v), 0) AS hi0, false AS stacked FROM p GROUP BY 1 UNION ALL SELECT chart, least(min(dn), 0), greatest(max(up), 0), true FROM c GROUP BY 1){_NICE}
SELECT chart, lo, hi0 AS hi, a, CASE WHEN b0 <= a THEN a + step ELSE b0 END AS b, step, stacked FROM w""",
    "chart_trend": f"WITH {_P} SELECT chart, ser, round(regr_slope(v, idx), 3) AS slope, round(regr_intercept(v, idx), 3) AS intercept FROM p GROUP BY 1, 2",
    "chart_pie": f"WITH {_P}, s AS (SELECT *, sum(v) OVER (PARTITION BY chart, ser) AS t, sum(v) OVER (PARTITION BY chart, ser ORDER BY idx) AS c FROM p WHERE v > 0) SELECT chart, ser, idx, round(v / t, 6) AS share, round(c / t * 360 + 30 - v / t * 360, 6) AS angle_from, round(c / t * 360 + 30, 6) AS angle_to FROM s",
    "nice_steps": f"WITH e AS (SELECT c_custkey, least(c_acctbal, 0) AS lo, greatest(c_acctbal, 0) AS hi0 FROM customer){_NICE} SELECT c_custkey, round(a, 6) AS a, round(CASE WHEN b0 <= a THEN a + step ELSE b0 END, 6) AS b, round(step, 6) AS step FROM w",
    "grid_columns": f"WITH {_CELLS} SELECT tab, row, k, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS col FROM cells",
    "grid_fixed_widths": f"""WITH {_CELLS}, {_NEEDS},
o AS (SELECT *, CASE WHEN tab % 2 = 0 AND col = 0 THEN 60 WHEN tab % 3 = 0 AND col = 3 THEN greatest(25, mn) END AS own FROM n),
s AS (SELECT *, 400 - coalesce(sum(own) OVER w, 0) AS rest, sum(mx) FILTER (own IS NULL) OVER w AS smx, sum(mn) FILTER (own IS NULL) OVER w AS smn FROM o WINDOW w AS (PARTITION BY tab)),
w AS (SELECT tab, col, mn, mx, CASE WHEN own IS NOT NULL THEN own WHEN smx <= rest THEN mx + (rest - smx) * mx // smx WHEN smn >= rest THEN mn ELSE mn + (mx - mn) * (rest - smn) // (smx - smn) END AS width FROM s)
SELECT *, sum(width) OVER (PARTITION BY tab ORDER BY col) - width AS x FROM w""",
    "grid_widths": f"""WITH {_CELLS}, {_NEEDS},
s AS (SELECT *, sum(mn) OVER (PARTITION BY tab) AS smn, sum(mx) OVER (PARTITION BY tab) AS smx FROM n),
w AS (SELECT tab, col, mn, mx, CASE WHEN smx <= 170 THEN mx WHEN smn >= 170 THEN mn ELSE mn + (mx - mn) * (170 - smn) // (smx - smn) END AS width FROM s)
SELECT *, sum(width) OVER (PARTITION BY tab ORDER BY col) - width AS x FROM w""",
    "grid_width": f"WITH {_CELLS} SELECT tab, max(n) AS n_cols FROM (SELECT tab, row, sum(span) + tab % 3 AS n FROM cells GROUP BY 1, 2) GROUP BY 1",
    "cell_parts": """WITH c AS (SELECT *, l_linenumber - 1 AS r, l_partkey % 4 AS c FROM lineitem),
p AS (SELECT l_orderkey, l_linenumber, l_partkey, list_filter(['whole', CASE WHEN c >= 1 THEN CASE WHEN (c - 1) % 2 = 1 THEN 'band2_v' ELSE 'band1_v' END END, CASE WHEN r >= 1 THEN CASE WHEN (r - 1) // 2 % 2 = 1 THEN 'band2_h' ELSE 'band1_h' END END,
  CASE WHEN c = 0 THEN 'first_col' END, CASE WHEN c = 3 THEN 'last_col' END, CASE WHEN r = 0 THEN 'first_row' END, CASE WHEN r = 6 THEN 'last_row' END, CASE WHEN r = 0 AND c = 0 THEN 'nw' END, CASE WHEN r = 0 AND c = 3 THEN 'ne' END, CASE WHEN r = 6 AND c = 0 THEN 'sw' END, CASE WHEN r = 6 AND c = 3 THEN 'se' END], lambda x: x IS NOT NULL) AS ps FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(ps, ' ') AS parts, CASE WHEN list_contains(ps, 'se') THEN 'green' WHEN list_contains(ps, 'first_row') THEN 'black' WHEN list_contains(ps, 'last_col') THEN 'red' WHEN list_contains(ps, 'band2_h') THEN 'blue' WHEN list_contains(ps, 'band1_v') THEN 'grey' ELSE 'white' END AS shading FROM p""",
    "table_parts": """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN r IN (0, 6) AND c IN (0, 3) THEN 'corner' WHEN r = 6 THEN 'last_row' WHEN r = 0 THEN 'first_row' WHEN c = 3 THEN 'last_col' WHEN c = 0 THEN 'first_col' WHEN r % 2 = 0 THEN 'band_row' WHEN c % 2 = 0 THEN 'band_col' ELSE 'whole' END AS part
FROM (SELECT *, l_linenumber - 1 AS r, l_partkey % 4 AS c FROM lineitem)""",
    "style_inherit": """WITH RECURSIVE s AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS font, 10.0::DOUBLE AS size FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name END, NULL FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN c_name END, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END FROM customer),
t AS (SELECT id, font, size FROM s WHERE parent IS NULL UNION ALL SELECT s.id, coalesce(s.font, t.font), coalesce(s.size, t.size) FROM s JOIN t ON s.parent = t.id)
SELECT id, font, size FROM t""",
    "adopt_styles": """WITH o AS (SELECT c_nationkey AS name, max(c_mktsegment) AS font FROM customer GROUP BY 1), t AS (SELECT s_nationkey AS name, CASE WHEN s_nationkey % 4 = 0 THEN 'table' ELSE 'paragraph' END AS kind, max(s_name) AS font FROM supplier GROUP BY 1, 2)
SELECT coalesce(o.name, t.name) AS name, CASE WHEN o.name IS NULL THEN t.kind ELSE 'paragraph' END AS kind, CASE WHEN o.name IS NULL OR t.kind = 'paragraph' THEN t.font ELSE o.font END AS font,
  CASE WHEN o.name IS NULL THEN 'template' WHEN t.name IS NULL THEN 'own' WHEN t.kind = 'paragraph' THEN 'both' ELSE 'own' END AS "from" FROM o FULL JOIN t ON o.name = t.name""",
}
