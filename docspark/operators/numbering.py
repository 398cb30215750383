"""Counters in reading order: sequences, notes, list labels, lines, headings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sequence_numbers(fields: DataFrame, doc: list[Column], name: Column, order: list[Column], as_: str = "seq_no") -> DataFrame:
    """A counter of its own for each name, in document order."""
    return fields.withColumn(as_, F.row_number().over(W.partitionBy(*doc, name).orderBy(*order)))


def note_numbers(notes: DataFrame, doc: list[Column], endnote: Column, order: list[Column], restart: list[Column] | None = None, start: Column | int = 1) -> DataFrame:
    """note_no_export counts foot- and endnotes together; note_no_layout counts them
    apart, from start, again after each restart key."""
    start = F.lit(start) if isinstance(start, int) else start
    one = W.partitionBy(*doc).orderBy(*order)
    own = W.partitionBy(*doc, endnote, *(restart or [])).orderBy(*order)
    return notes.withColumns({"note_no_export": F.row_number().over(one), "note_no_layout": F.row_number().over(own) + start - 1})


def line_numbers(lines: DataFrame, restart: list[Column], order: list[Column], every: int, body: Column) -> DataFrame:
    """Numbers of body lines within a restart key; shown is the number at every
    every-th line and null elsewhere."""
    w = W.partitionBy(*restart, body).orderBy(*order)
    n = F.when(body, F.row_number().over(w))
    return lines.withColumn("line_no", n).withColumn("shown", F.when(F.col("line_no") % every == 0, F.col("line_no")))


def running_heading(blocks: DataFrame, doc: list[Column], order: list[Column], level: Column, text: Column, k: int) -> DataFrame:
    """The last heading of exactly level k so far; a heading above it clears it. An
    as-of look-up as two windows over one sort."""
    upto = W.partitionBy(*doc).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    chapter = blocks.withColumn("_chapter", F.sum(F.when(level < k, 1).otherwise(0)).over(upto))
    within = W.partitionBy(*doc, "_chapter").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return chapter.withColumn("running", F.coalesce(F.last(F.when(level == k, text), ignorenulls=True).over(within), F.lit(""))).drop("_chapter")


def list_counters(items: DataFrame, flow: list[Column], level: Column, order: list[Column], levels: int, starts: list[int]) -> DataFrame:
    """Counters c0.. of all levels at each item, for lists in which a deeper level
    starts anew after any shallower item. Each is a count so far less what it was at the
    last shallower item, so all are windows over one sort; a window over a key of its own
    would sort the rows once more and hold both."""
    upto = W.partitionBy(*flow).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = items.withColumn("_lv", F.least(level, F.lit(levels - 1)))
    out = out.withColumns({f"_c{k}": F.count_if(F.col("_lv") == k).over(upto) for k in range(levels)})
    # a count never falls: the last at a shallower item is the greatest
    left = {k: F.coalesce(F.max(F.when(F.col("_lv") < k, F.col(f"_c{k}"))).over(upto), F.lit(0)) if k else F.lit(0) for k in range(levels)}
    out = out.withColumns({f"_n{k}": F.col(f"_c{k}") - left[k] for k in range(levels)})
    counters = [
        # a level that a deeper item left behind keeps its count until an item clears it
        F.when(F.col(f"_n{k}") > 0, F.col(f"_n{k}") + starts[k] - 1).otherwise(F.lit(0)).cast("int").alias(f"c{k}")
        for k in range(levels)
    ]
    return out.select(*items.columns, F.col("_lv").alias("list_lv"), *counters)


def list_label(template: str, counters: list[Column]) -> Column:
    """A label by its template: %1..%9 stand for the counters as they print."""
    parts, i = [], 0
    while i < len(template):
        if template[i] == "%" and template[i + 1 : i + 2] in tuple("123456789"):
            k = int(template[i + 1]) - 1
            parts.append(counters[k] if k < len(counters) else F.lit("0"))
            i += 2
        else:
            j = template.find("%", i + 1)
            j = len(template) if j < 0 else j
            parts.append(F.lit(template[i:j]))
            i = j
    return F.concat(*parts) if parts else F.lit("")


def folded_counters(items: DataFrame, flow: list[str], order: list[str], level: str, rules: list[tuple[int, int]]) -> DataFrame:
    """The general case, rules being (start, restart_after) of each level: a level is
    counted anew after an item above it (restart_after 0), only after one above level
    restart_after (> 0), or never (< 0). A fold over one flow at a time, for rules
    that no window expresses; adds counters, an array."""
    width = len(rules)

    def whole(flow_items: pd.DataFrame) -> pd.DataFrame:
        flow_items = flow_items.sort_values(order)
        count, running, rows = [0] * width, [False] * width, []
        for lv in flow_items[level]:
            at = min(int(lv), width - 1)
            count[at] = count[at] + 1 if running[at] else rules[at][0]
            running[at] = True
            for deeper in range(at + 1, width):
                after = rules[deeper][1]
                if after == 0 or at < after:
                    running[deeper] = False
            rows.append(list(count))
        return flow_items.assign(counters=rows)

    return items.groupBy(*flow).applyInPandas(whole, items.select("*").schema.add("counters", T.ArrayType(T.IntegerType())))


def reference_numbers(refs: DataFrame, targets: DataFrame, on: list[str], value: str, order: list[str]) -> DataFrame:
    """Cross-references: the first number within each target, or ?? where there is none."""
    first = targets.groupBy(*on).agg(F.min_by(value, F.struct(*order)).alias("_v"))
    return refs.join(first, on, "left").withColumn("ref_text", F.coalesce(F.col("_v").cast("string"), F.lit("??"))).drop("_v")
