"""Blocks to text, Markdown and HTML: a string for each block by native
expressions, put together in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escaped, markdown_escaped


def _joined(blocks: DataFrame, doc: str, line: Column, by: str, as_: str) -> DataFrame:
    rows = blocks.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("ord", line.alias("s")))).alias("r"))
    return rows.select(doc, F.array_join(F.transform("r", lambda x: x["s"]), by).alias(as_))


def plain_text(blocks: DataFrame, doc: str) -> DataFrame:
    """Bullets and indents before items, ten dashes for a rule; cells of a row are
    joined by tabs."""
    indent = F.repeat(F.lit("  "), F.coalesce("list_level", F.lit(0)))
    label = F.when(F.col("list_kind") == "bullet", "• ").when(F.col("list_kind").isNotNull(), "- ").otherwise("")
    line = F.when(F.col("role") == "rule", "----------").otherwise(F.concat(indent, label, "text"))
    cells = blocks.where("row_no is not null").groupBy(doc, "table_no", "row_no").agg(F.min("ord").alias("ord"), F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("c"))
    rows = cells.select(doc, "ord", F.array_join(F.transform("c", lambda x: x["text"]), "\t").alias("s"))
    others = blocks.where("row_no is null").select(doc, "ord", line.alias("s"))
    return _joined(others.unionByName(rows), doc, F.col("s"), "\n", "content")


def markdown(blocks: DataFrame, doc: str) -> DataFrame:
    text = F.replace(markdown_escaped(F.col("text")), F.lit("\n"), F.lit("\\\n"))
    indent = F.repeat(F.lit("  "), F.coalesce("list_level", F.lit(0)))
    body = (
        F.when(F.col("role") == "rule", "---")
        .when(F.col("role") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), text))
        .when(F.col("role") == "code", F.concat(F.lit("```\n"), "text", F.lit("\n```")))
        .when(F.col("list_kind") == "bullet", F.concat(indent, F.lit("- "), text))
        .when(F.col("list_kind").isNotNull(), F.concat(indent, F.lit("1. "), text))
        .otherwise(text)
    )
    quoted = F.concat(F.repeat(F.lit("> "), F.coalesce("quote_depth", F.lit(0))), body)
    return _joined(blocks, doc, quoted, "\n\n", "content")


def html(blocks: DataFrame, doc: str) -> DataFrame:
    text = F.replace(html_escaped(F.col("text")), F.lit("\n"), F.lit("<br>"))
    wrap = lambda tag: F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))
    head = F.concat(F.lit("<h"), F.col("level"), F.lit(">"), text, F.lit("</h"), F.col("level"), F.lit(">"))
    item = F.concat(F.when(F.col("list_kind") == "decimal", "<ol><li>").otherwise("<ul><li>"), text, F.when(F.col("list_kind") == "decimal", "</li></ol>").otherwise("</li></ul>"))
    line = F.when(F.col("role") == "rule", "<hr>").when(F.col("role") == "heading", head).when(F.col("role") == "code", wrap("pre")).when(F.col("list_kind").isNotNull(), item).otherwise(wrap("p"))
    return _joined(blocks, doc, line, "\n", "content")
