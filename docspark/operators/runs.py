"""Run algebra and tracked changes. A run is a stretch [start, end) of a block's
text with one format; the runs of a block tile its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lookups import ranked


def islands(rows: DataFrame, by: list[Column], order: list[Column], starts: Column, as_: str = "island") -> DataFrame:
    """Numbers stretches of rows; a row begins one where starts is true or unknown."""
    w = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_new", F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).withColumn(as_, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def coalesced(runs: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Neighbouring rows with one value become one (run_no, value, first, last, n)."""
    w = W.partitionBy(*by).orderBy(*order)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    marked = runs.withColumn("_changed", changed)
    numbered = islands(marked, [F.col(c) for c in by], [F.col(c) for c in order], F.col("_changed"), "run_no")
    return numbered.groupBy(*by, "run_no", value).agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"), F.count("*").alias("n"))


def split_at(runs: DataFrame, ranges: DataFrame, block: str, fmt: str = "format") -> DataFrame:
    """Runs cut at both ends of the ranges (block, from, to, set) that meet them, with
    set in place of the format inside one; ranges of a block don't overlap. One join with
    a block's ranges as an array: a task sorts its runs once."""
    own = ranges.groupBy(block).agg(F.collect_list(F.struct("from", "to", "set")).alias("_r"))
    ends = F.array_distinct(F.flatten(F.transform("_r", lambda r: F.array(r["from"], r["to"]))))
    inner = F.filter(ends, lambda c: (c > F.col("start")) & (c < F.col("end")))
    marks = F.array_sort(F.concat(F.array("start", "end"), F.coalesce(inner, F.array().cast("array<int>"))))
    marked = runs.join(own, block, "left").select(block, fmt, "_r", marks.alias("_m"))
    parts = marked.select(block, fmt, "_r", "_m", F.explode(F.sequence(F.lit(1), F.size("_m") - 1)).alias("_i"))
    parts = parts.select(block, fmt, "_r", F.get("_m", F.col("_i") - 1).alias("start"), F.get("_m", F.col("_i")).alias("end"))
    hit = F.get(F.filter("_r", lambda r: (F.col("start") >= r["from"]) & (F.col("end") <= r["to"])), F.lit(0))
    return parts.select(block, "start", "end", F.coalesce(hit["set"], fmt).alias(fmt))


def resolved(runs: DataFrame, kind: Column, accept: Column) -> DataFrame:
    """Tracked changes decided: a deletion accepted or an insertion rejected takes its
    run away; all other runs stay and lose the change."""
    gone = (kind == "delete") & accept | (kind == "insert") & ~accept
    return runs.where(~F.coalesce(gone, F.lit(False)))


def view_text(runs: DataFrame, doc: list[str], order: str, text: str, kind: str, view: str) -> DataFrame:
    """The text of a view: final (as accepted), original (as rejected), inline (all)."""
    shown = runs if view == "inline" else resolved(runs, F.col(kind), F.lit(view == "final"))
    rows = shown.groupBy(*doc).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("r"))
    return rows.select(*doc, F.array_join(F.transform("r", lambda x: x["t"]), "").alias("text"))


def spans(runs: DataFrame, block: str, text: str) -> DataFrame:
    """Runs that are not deleted, split where an inline object (U+FFFC) stands."""
    live = runs.where("coalesce(kind, '') <> 'delete'")
    parts = F.split(text, "(?<=\\x{FFFC})|(?=\\x{FFFC})")
    return live.select(block, "start", F.posexplode(parts).alias("part", "span")).where("span <> ''")


def typing_sessions(ops: DataFrame, by: list[str], order: list[str], at: str, length: str) -> DataFrame:
    """Edits that continue where the last one ended are one undo step: adds step."""
    w = W.partitionBy(*by).orderBy(*order)
    end = F.lag(F.col(at) + F.col(length)).over(w)
    return islands(ops.withColumn("_joins", F.col(at) == end), [F.col(c) for c in by], [F.col(c) for c in order], ~F.col("_joins"), "step").drop("_joins")


def author_index(marks: DataFrame, author: str, order: list[str]) -> DataFrame:
    """Authors by first appearance, and the colour number of each (eight in turn).
    The rank runs over distinct authors, not over marks."""
    first = marks.groupBy(author).agg(F.min(F.struct(*order)).alias("first"))
    spread = first.select(author, "first", *[F.col(f"first.{c}").alias(f"_{c}") for c in order])
    numbered = ranked(spread, [*[f"_{c}" for c in order], author], "author_no").drop(*[f"_{c}" for c in order])
    return numbered.withColumn("author_no", F.col("author_no") - 1).withColumn("colour", F.col("author_no") % 8)


def last_steps(ops: DataFrame, by: list[str], order: Column, keep: int) -> DataFrame:
    """The undo limit: the last steps of each key."""
    return ops.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(order.desc()))).where(F.col("_r") <= keep).drop("_r")


def threads(comments: DataFrame, id_: str, parent: str, removed: Column) -> DataFrame:
    """Comments without the removed ones and their replies."""
    gone = comments.where(removed).select(F.col(id_).alias("_gone"))
    first = comments.join(gone, F.col(id_) == F.col("_gone"), "left_anti")
    return first.join(gone, F.col(parent) == F.col("_gone"), "left_anti")
