"""Documents as rows of blocks: the text source, reading order, plain exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean


def paragraphs(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One paragraph a line, in order (doc, ord, text). Line ends are \\n, \\r\\n and \\r; a
    byte-order mark is dropped; an end at the very end adds none; an empty or null
    text is one empty paragraph. No shuffle: a row makes its own."""
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\\A\\x{FEFF}", "")
    lines = F.split(F.regexp_replace(body, "(\\r\\n|\\n|\\r)\\z", ""), "\\r\\n|\\n|\\r", -1)
    return docs.select(F.col(doc).alias("doc_id"), F.posexplode(lines).alias("ord", "line")).select("doc_id", "ord", clean(F.col("line")).alias("text"))


def neighbours(blocks: DataFrame, doc: Column, order: list[Column], block: Column) -> DataFrame:
    """Adds prev_id and next_id: the paragraphs before and after within one flow."""
    w = W.partitionBy(doc).orderBy(*order)
    return blocks.withColumns({"prev_id": F.lag(block).over(w), "next_id": F.lead(block).over(w)})


def edges(blocks: DataFrame, parent: str, block: str, order: str) -> DataFrame:
    """First and last paragraph under each parent: a partial aggregate, no window."""
    return blocks.groupBy(parent).agg(F.min_by(block, order).alias("first_id"), F.max_by(block, order).alias("last_id"))


def exported(blocks: DataFrame, doc: str, order: str, text: Column) -> DataFrame:
    """A document's text again: its lines in order, joined."""
    rows = blocks.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))).alias("rows"))
    return rows.select(doc, F.array_join(F.transform("rows", lambda r: r["t"]), "\n").alias("text"))


def deduplicated(resources: DataFrame, content: Column, id_: Column) -> DataFrame:
    """Adds canonical_id: the least id with the same bytes, found by digest. The digest
    is aggregated before the join back, so a resource that all share is no hot key."""
    keyed = resources.withColumn("digest", F.sha2(content, 256))
    best = keyed.groupBy("digest").agg(F.min(id_).alias("canonical_id"))
    return keyed.join(best, "digest")


def text_diff(before: Column, after: Column) -> Column:
    """The one stretch that differs (at, removed, inserted), in code points: common
    beginning and common end taken off, the end not reaching into the beginning."""
    n = F.least(F.length(before), F.length(after))
    # halving: whether the first k characters agree falls from true to false once
    agree = lambda k: F.substr(before, F.lit(1), k) == F.substr(after, F.lit(1), k)
    steps = F.sequence(F.lit(0), F.lit(31))

    def search(top: Column, test) -> Column:
        pair = F.aggregate(
            steps,
            F.struct(F.lit(0).alias("lo"), top.cast("int").alias("hi")),
            lambda acc, _: F.when(acc["lo"] >= acc["hi"], acc).otherwise(
                F.when(test(F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")), F.struct(F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int").alias("lo"), acc["hi"].alias("hi"))).otherwise(
                    F.struct(acc["lo"].alias("lo"), (F.floor((acc["lo"] + acc["hi"] + 1) / 2) - 1).cast("int").alias("hi"))
                )
            ),
        )
        return pair["lo"]

    head = search(n, agree)
    end = lambda k: F.right(before, k) == F.right(after, k)
    return F.get(
        F.transform(
            F.array(head),
            lambda h: F.get(
                F.transform(
                    F.array(search(n - h, end)),
                    lambda t: F.struct(h.alias("at"), F.substr(before, h + 1, F.length(before) - h - t).alias("removed"), F.substr(after, h + 1, F.length(after) - h - t).alias("inserted")),
                ),
                F.lit(0),
            ),
        ),
        F.lit(0),
    )
