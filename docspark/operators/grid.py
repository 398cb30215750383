"""Table grids: widths of columns from their cells, and where they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def placed(cells: DataFrame, table: str, row: str, order: str, span: str) -> DataFrame:
    """Adds col: the grid column at which a cell begins."""
    w = W.partitionBy(table, row).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return cells.withColumn("col", F.coalesce(F.sum(F.greatest(F.col(span), F.lit(1))).over(w), F.lit(0)))


def grid_width(cells: DataFrame, table: str, row: str, span: str, outside: F.Column | None = None) -> DataFrame:
    """table, n_cols: the widest row with the columns that it leaves free before and after
    (outside), at most 4096."""
    rows = cells.groupBy(table, row).agg((F.sum(F.greatest(F.col(span), F.lit(1))) + (F.max(outside) if outside is not None else F.lit(0))).alias("n"))
    return rows.groupBy(table).agg(F.least(F.max("n"), F.lit(4096)).alias("n_cols"))


def _widened(widths: F.Column, col: F.Column, span: F.Column, need: F.Column) -> F.Column:
    """The columns under a spanning cell, widened alike by what it lacks there."""
    have = F.aggregate(F.slice(widths, col + 1, span), F.lit(0).cast("long"), lambda n, w: n + w)
    more = F.floor(F.greatest(need - have, F.lit(0)) / span)
    return F.transform(widths, lambda w, i: F.when((i >= col) & (i < col + span), w + more).otherwise(w))


def column_needs(cells: DataFrame, table: str, col: str, span: str, order: list[str], least: str, most: str) -> DataFrame:
    """Each column's least and most width: from cells of one column first; then cells that
    span columns widen those they cover, in order, each place by its widest cell."""
    cells = cells.select(table, *dict.fromkeys(order), F.col(col).cast("int").alias("_c"), F.col(span).cast("int").alias("_s"), F.col(least).cast("long").alias("_a"), F.col(most).cast("long").alias("_b"))
    places = cells.groupBy(table, "_c", "_s").agg(F.max("_a").alias("a"), F.max("_b").alias("b"), F.min(F.struct(*order)).alias("at"))
    one = F.struct(F.col("_c").alias("k"), F.struct("a", "b").alias("v"))
    wide = F.struct("at", F.col("_c").alias("c"), F.col("_s").alias("s"), "a", "b")
    # a row for each place of the grid, so a table's are as few as its columns allow
    tables = places.groupBy(table).agg(F.max(F.col("_c") + F.col("_s")).alias("n"), F.map_from_entries(F.collect_list(F.when(F.col("_s") == 1, one))).alias("one"), F.array_sort(F.collect_list(F.when(F.col("_s") > 1, wide))).alias("wide"))
    first = lambda name: F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("one", i)[name], F.lit(0).cast("long")))
    start = F.struct(first("a").alias("mn"), first("b").alias("mx"))
    solved = tables.select(table, F.aggregate("wide", start, lambda w, x: F.struct(_widened(w["mn"], x["c"], x["s"], x["a"]).alias("mn"), _widened(w["mx"], x["c"], x["s"], x["b"]).alias("mx"))).alias("w"))
    rows = solved.select(table, F.posexplode(F.arrays_zip("w.mn", "w.mx")).alias(col, "_w"))
    return rows.select(table, col, F.col("_w.mn").alias("mn"), F.greatest("_w.mn", "_w.mx").alias("mx"))


def column_widths(needs: DataFrame, table: str, col: str, available: int, stretch: bool = False) -> DataFrame:
    """Widths in whole units. A column with a fixed width (column fixed) has that; one that
    is preferred so wide (column pref) has that or what its content needs. The others
    share the rest: as wide as wanted where all fit (stretched if asked), least widths
    where not even those do, else in between by one share for all. Adds width and x,
    where the column begins."""
    names = needs.columns
    null = F.lit(None).cast("long")
    fixed, pref = (F.col(c) if c in names else null for c in ("fixed", "pref"))
    own = F.when(fixed > 0, fixed).when(pref > 0, F.greatest(pref, F.col("mn"))).cast("long")
    all_ = W.partitionBy(table)
    auto = F.col("_own").isNull()
    sums = needs.withColumn("_own", own).withColumns({"_mn": F.sum(F.when(auto, F.col("mn"))).over(all_), "_mx": F.sum(F.when(auto, F.col("mx"))).over(all_), "_n": F.count(F.when(auto, 1)).over(all_), "_rest": F.lit(available).cast("long") - F.coalesce(F.sum("_own").over(all_), F.lit(0))})
    extra = F.expr("CASE WHEN _mx > 0 THEN (_rest - _mx) * mx div _mx ELSE (_rest - _mx) div _n END") if stretch else F.lit(0)
    width = F.when(~auto, F.col("_own")).when(F.col("_mx") <= F.col("_rest"), F.col("mx") + extra).when(F.col("_mn") >= F.col("_rest"), F.col("mn")).otherwise(F.col("mn") + F.expr("(mx - mn) * (_rest - _mn) div nullif(_mx - _mn, 0)"))
    solved = sums.withColumn("width", width.cast("long")).drop("_own", "_mn", "_mx", "_n", "_rest")
    before = all_.orderBy(col).rowsBetween(W.unboundedPreceding, -1)
    return solved.withColumn("x", F.coalesce(F.sum("width").over(before), F.lit(0)))
