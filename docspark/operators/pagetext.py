"""Lines and blocks from a page's characters (page, idx, cp, x0, y0, x1, y1, size), as
windows over one sort by place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Marks that begin a list item (fixed values).
BULLETS = [0x2022, 0x25AA, 0x25CF, 0x25E6, 0x25A0, 0x25A1, 0x2023, 0x2043, 0x2013, 0x2014, 0x27A2, 0x2713, 0xB7, 0xF0B7, 0xF0A7, 0xF0D8, 0xF076, 0xF0FC, 0xF06E, 0xF071]


def gaps(chars: DataFrame, by: list[str]) -> DataFrame:
    """Adds gap: newline, space or null, for what is missing before a character."""
    w = W.partitionBy(*by).orderBy("idx")
    prev = {c: F.lag(c).over(w) for c in ("cp", "x0", "x1", "y0", "y1")}
    seen = chars.withColumns({f"_{c}": v for c, v in prev.items()})
    h, ph = F.col("y1") - F.col("y0"), F.col("_y1") - F.col("_y0")
    apart = F.abs((F.col("y0") + F.col("y1")) / 2 - (F.col("_y0") + F.col("_y1")) / 2)
    tall = F.greatest(h, ph)
    space, was = F.col("cp") == 32, F.col("_cp") == 32
    both = ~space & ~was
    gap = (
        F.when(F.col("_cp").isNull(), F.lit(None))
        .when(both & ((apart > tall * 0.6) | (F.col("x1") < F.col("_x0") - tall * 0.5)), "newline")
        .when(both & (F.col("x0") - F.col("_x1") > tall * 0.18), "space")
        .when(space & (apart > ph * 0.6), "newline")
        .when(was & ~space & (apart > h * 0.6), "newline")
    )
    return seen.withColumn("gap", gap).drop(*[f"_{c}" for c in prev])


def lines(chars: DataFrame, by: list[str]) -> DataFrame:
    """by, line_no, x0, y0, x1, y1, size (the mean), n, first_cp of each line. A line
    ends at a missing newline, and at a gap of over 1.5 sizes that spaces fill. All windows
    are over one sort: one by segments would sort the characters again and hold both."""
    w = W.partitionBy(*by).orderBy("idx")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    real = F.col("cp") != 32
    place = F.when(real, F.struct("idx", "x1", F.when(F.col("size") > 0, F.col("size")).otherwise(F.col("y1") - F.col("y0")).alias("size")))
    last = F.last(place, ignorenulls=True).over(before)
    g = gaps(chars, by).withColumn("_last", last)
    size = F.when(F.col("_last.size") > 0, F.col("_last.size")).otherwise(10)
    # something stands between: a space of the file's, or one put in
    filled = (F.col("_last.idx") < F.col("idx") - 1) | (F.col("gap") == "space")
    gutter = real & filled & (F.col("x0") - F.col("_last.x1") > 1.5 * size)
    begins = F.when((F.col("gap") == "newline") | gutter, 1).otherwise(0)
    # a line begins at the first real character of a segment, and a stretch of spaces
    # alone belongs to the line before it: counts so far, all in the one order
    seen = F.sum(F.when(real, 1).otherwise(0)).over(before)
    counted = g.withColumns({"_begins": begins, "_seen": F.coalesce(seen, F.lit(0))})
    counted = counted.withColumn("_base", F.coalesce(F.max(F.when(F.col("_begins") == 1, F.col("_seen"))).over(upto), F.lit(0)))
    numbered = counted.withColumn("line_no", F.sum(F.when(real & (F.col("_seen") == F.col("_base")), 1).otherwise(0)).over(upto))
    r = numbered.where(real)
    return r.groupBy(*by, "line_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("size").alias("size"), F.count("*").alias("n"), F.min_by("cp", "idx").alias("first_cp"))


def blocks(page_lines: DataFrame, by: list[str]) -> DataFrame:
    """by, block_no, box, size, lines, align. A line goes on the block above if it is
    just under it, of about its size, across the same stretch, and no list item."""
    w = W.partitionBy(*by).orderBy("line_no")
    p = {c: F.lag(c).over(w) for c in ("x0", "x1", "y0", "y1", "size")}
    seen = page_lines.withColumns({f"_{c}": v for c, v in p.items()})
    size = F.greatest("size", "_size")
    ratio = F.col("size") / F.col("_size")
    joins = (
        ~F.col("first_cp").isin(BULLETS)
        & (F.col("size") > 0) & (F.col("_size") > 0) & (ratio >= 0.92) & (ratio <= 1.087)
        & (F.col("y0") >= F.col("_y0") + 0.3 * size) & (F.col("y0") - F.col("_y1") <= 0.75 * size)
        & (F.least("x1", "_x1") - F.greatest("x0", "_x0") > 0)
    )
    starts = F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)
    numbered = seen.withColumn("block_no", F.sum(starts).over(w.rowsBetween(W.unboundedPreceding, 0)))
    mid = (F.col("x0") + F.col("x1")) / 2
    got = numbered.groupBy(*by, "block_no").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min_by("size", "line_no").alias("size"), F.count("*").alias("lines"),
        (F.max("x0") - F.min("x0")).alias("_l"), (F.max(mid) - F.min(mid)).alias("_m"), (F.max("x1") - F.min("x1")).alias("_r"),
    )
    near = 0.5 * F.when(F.col("size") > 0, F.col("size")).otherwise(10)
    align = F.when((F.col("lines") < 2) | (F.col("_l") <= near), 0).when(F.col("_m") <= near, 1).when(F.col("_r") <= near, 2).otherwise(0)
    return got.withColumn("align", align).drop("_l", "_m", "_r")
