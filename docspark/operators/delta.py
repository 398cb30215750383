"""Snapshot and deltas: the state of documents after a log of finished operations.

A delta's new state is a row a block, so replay is the last row of each block and
no fold over text; continuity of serials is checked by one window. JSON trees of
any depth are read in one small recursive function per document.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = "id long, kind string, parent long, ord int, role string, level int, style int, text string, runs array<array<int>>"
DELTA = """Delta bigint, NextID bigint, FormatBase int, Formats array<struct<Style:int,Char:map<string,string>>>, RevisionBase int,
Revisions array<struct<Kind:string,Author:string,Date:string>>, New array<struct<Parent:bigint,Tree:string>>,
Blocks array<struct<`_TreeNode_(paragraph)`:struct<ID:bigint,Style:int,Role:string,Level:int,Text:string,Runs:array<array<int>>>>>,
Trees array<struct<Parent:bigint,Kids:array<bigint>>>, Comments array<struct<Author:string,Text:string,Start:array<bigint>,End:array<bigint>,Removed:boolean>>"""


def walk(node: dict, parent: int | None = None, order: int = 0, depth: int = 0) -> Iterator[tuple]:
    """Blocks of a JSON tree, parents first: a node is its kind in a key of its own and
    its children in another. What lies deeper than 128 is told by one row of kind error."""
    if depth > 128:
        yield None, "error", parent, order, None, None, None, "nested too deep", None
        return
    for key, body in node.items():
        if key.startswith("_TreeNode_("):
            at = body.get("ID")
            yield at, key[11:-1], parent, order, body.get("Role"), body.get("Level"), body.get("Style"), body.get("Text"), body.get("Runs")
            for k, child in enumerate(node.get("_TreeChildren_", [])):
                yield from walk(child, at, k, depth + 1)


def json_trees(files: DataFrame, doc: str, content: str) -> DataFrame:
    """doc and a row for each block of the native JSON format (Document and Stories). A
    null or malformed file is one row of kind error."""

    def blocks(text: str | None) -> list[tuple]:
        try:
            top = json.loads(text or "")
            trees = [top.get("Document", {}), *top.get("Stories", [])]
            return [r for k, tree in enumerate(trees) for r in walk(tree, None, k)]
        except (ValueError, AttributeError, TypeError) as e:
            return [(None, "error", None, 0, None, None, None, str(e), None)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, text in zip(f[doc], f[content], strict=True):
                rows += [(d, *r) for r in blocks(text)]
            out = pd.DataFrame(rows, columns=[doc, "id", "kind", "parent", "ord", "role", "level", "style", "text", "runs"])
            for c in ("id", "parent", "ord", "level", "style"):
                out[c] = out[c].astype("Int64")
            yield out

    return files.select(doc, content).mapInPandas(run, f"{doc} {dict(files.dtypes)[doc]}, {BLOCK}")


def parsed(deltas: DataFrame, doc: str, raw: str) -> DataFrame:
    return deltas.select(F.col(doc).alias("doc"), F.from_json(raw, DELTA).alias("d")).select("doc", "d.*")


def checked(found: DataFrame, start: int = 0) -> DataFrame:
    """Adds ok: whether a delta follows the one before it, and its tables begin where
    those before end."""
    w = W.partitionBy("doc").orderBy("Delta")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    formats = F.sum(size("Formats")).over(w.rowsBetween(W.unboundedPreceding, -1))
    first = F.first("FormatBase").over(w)
    follows = F.col("Delta") == F.coalesce(F.lag("Delta").over(w) + 1, F.lit(start) + 1)
    return found.withColumn("ok", follows & (F.coalesce("FormatBase", F.lit(0)) == F.coalesce(first, F.lit(0)) + F.coalesce(formats, F.lit(0))))


def block_states(found: DataFrame) -> DataFrame:
    """doc, id, text, runs, changed: each changed block's last state."""
    b = found.select("doc", "Delta", F.explode("Blocks").alias("b")).select("doc", "Delta", F.col("b.`_TreeNode_(paragraph)`").alias("b"))
    last = b.groupBy("doc", F.col("b.ID").alias("id")).agg(F.max_by("b", "Delta").alias("b"), F.max("Delta").alias("changed"))
    return last.select("doc", "id", F.col("b.Text").alias("text"), F.col("b.Runs").alias("runs"), "changed")


def replayed(snapshot: DataFrame, states: DataFrame) -> DataFrame:
    """Snapshot blocks (doc, id, text) under the states that deltas gave them."""
    s = states.select("doc", "id", F.col("text").alias("_t"), "changed")
    both = snapshot.select("doc", "id", "text").join(s, ["doc", "id"], "full_outer")
    return both.select("doc", "id", F.when(F.col("changed").isNotNull(), F.col("_t")).otherwise(F.col("text")).alias("text"), F.col("changed").isNotNull().alias("changed"))
