"""Edits of paragraphs as column operations over byte offsets, and the shift of
markers that follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bytes(text: Column, start: Column, n: Column | None = None) -> Column:
    raw = text.cast("binary")
    return (F.substr(raw, start + 1) if n is None else F.substr(raw, start + 1, n)).cast("string")


def inserted(text: Column, at: Column, new: Column) -> Column:
    return F.concat(_bytes(text, F.lit(0), at), new, _bytes(text, at))


def deleted(text: Column, start: Column, end: Column) -> Column:
    return F.concat(_bytes(text, F.lit(0), start), _bytes(text, end))


def split(blocks: DataFrame, text: str, at: Column) -> DataFrame:
    """Each block as two rows (half 0 and 1) cut at a byte offset; a heading's second
    half is body, and a done task is open again there."""
    t = F.col(text)
    halves = F.posexplode(F.array(_bytes(t, F.lit(0), at), _bytes(t, at))).alias("half", "_t")
    out = blocks.select("*", halves).drop(text).withColumnRenamed("_t", text)
    if "role" in blocks.columns:
        out = out.withColumn("role", F.when((F.col("half") == 1) & F.col("role").isin("heading", "title"), "body").otherwise(F.col("role")))
    if "task" in blocks.columns:
        out = out.withColumn("task", F.when((F.col("half") == 1) & (F.col("task") == 2), 1).otherwise(F.col("task")))
    return out


def marker_after_insert(offset: Column, right: Column, at: Column, size: Column) -> Column:
    """Markers behind the point move; at the point, those with right gravity do."""
    return F.when((offset > at) | ((offset == at) & right), offset + size).otherwise(offset)


def marker_after_delete(offset: Column, start: Column, end: Column) -> Column:
    return F.when(offset >= end, offset - (end - start)).when(offset > start, start).otherwise(offset)


def runs_after_insert(start: Column, end: Column, at: Column, size: Column) -> Column:
    """A run's new range: the run that ends at the point takes the text in, so it has
    the format to its left; the first run does at the very beginning."""
    s = F.when((start >= at) & ~((start == 0) & (at == 0)), start + size).otherwise(start)
    e = F.when(end >= at, end + size).otherwise(end)
    return F.struct(s.alias("start"), e.alias("end"))


def renumbered(blocks: DataFrame, parent: list[str], order: list[Column]) -> DataFrame:
    """ord again from 0 after blocks were put in, taken out or moved."""
    from pyspark.sql import Window as W

    return blocks.withColumn("ord", F.row_number().over(W.partitionBy(*parent).orderBy(*order)) - 1)


def deleted_across(blocks: DataFrame, ranges: DataFrame, parent: str, ord_: str, text: str) -> DataFrame:
    """A range deleted across the paragraphs of one parent: ranges (parent, first, at, last,
    to; offsets in bytes). The first paragraph keeps its beginning and its properties and
    takes the rest of the last; those between and the last go. A range whose last
    paragraph isn't there changes nothing."""
    t = F.col(text)
    tails = blocks.select(parent, F.col(ord_).alias("last"), t.alias("_tail"))
    found = ranges.join(tails, [parent, "last"])
    both = blocks.join(found, parent, "left")
    inside = F.coalesce((F.col(ord_) > F.col("first")) & (F.col(ord_) <= F.col("last")), F.lit(False))
    joined = F.concat(_bytes(t, F.lit(0), F.col("at")), _bytes(F.col("_tail"), F.col("to")))
    return both.where(~inside).withColumn(text, F.when(F.col(ord_) == F.col("first"), joined).otherwise(t)).select(*blocks.columns)


def _cut(runs: DataFrame, ranges: DataFrame, block: str) -> DataFrame:
    """Runs cut at both ends of their block's range (from, to), with inside."""
    both = runs.join(ranges, block, "left")
    clip = lambda c: F.least(F.greatest(F.coalesce(F.col(c), F.col("start")), F.col("start")), F.col("end"))
    marks = F.array_sort(F.array_distinct(F.array("start", clip("from"), clip("to"), "end")))
    parts = both.withColumn("_marks", marks).select("*", F.posexplode("_marks").alias("_i", "_s")).where(F.col("_i") < F.size("_marks") - 1)
    cut = parts.withColumn("_e", F.get("_marks", F.col("_i") + 1)).drop("start", "end").withColumnsRenamed({"_s": "start", "_e": "end"})
    return cut.withColumn("inside", F.coalesce((F.col("start") >= F.col("from")) & (F.col("end") <= F.col("to")), F.lit(False)))


def tracked_delete(runs: DataFrame, ranges: DataFrame, block: str) -> DataFrame:
    """A deletion while changes are tracked: runs (start, end, kind, author) under ranges
    (from, to, by), one a block. What its author has put in and nobody has accepted goes
    outright, what is deleted already stays as it is, all else is marked."""
    cut = _cut(runs, ranges, block)
    own = (F.col("kind") == "insert") & (F.col("author") == F.col("by"))
    left = cut.where(~F.coalesce(F.col("inside") & own, F.lit(False)))
    marks = F.col("inside") & ~F.coalesce(F.col("kind") == "delete", F.lit(False))
    return left.withColumns({"kind": F.when(marks, "delete").otherwise(F.col("kind")), "author": F.when(marks, F.col("by")).otherwise(F.col("author"))}).select(*runs.columns)


def resolved_range(runs: DataFrame, ranges: DataFrame, block: str) -> DataFrame:
    """Changes within ranges (from, to, accept) decided: a deletion accepted and an insertion
    rejected go, all others there lose their mark; outside nothing changes."""
    cut = _cut(runs, ranges, block)
    gone = F.col("inside") & F.when(F.col("accept"), F.col("kind") == "delete").otherwise(F.col("kind") == "insert")
    left = cut.where(~F.coalesce(gone, F.lit(False)))
    return left.withColumns({c: F.when(~F.col("inside"), F.col(c)) for c in ("kind", "author")}).select(*runs.columns)
