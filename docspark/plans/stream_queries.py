"""Queries of streams, deltas and segmentation. The streams run over all of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import segment
from ..functions.text import may_be_rtl
from ..operators import delta
from ..streaming import log_stream
from .common import table


def _updates(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    return raw.select(F.col("user_id").alias("doc"), F.col("event_type").alias("client"), F.col("props").alias("data"), F.col("ts").cast("timestamp").alias("at"), "event_id")


def _name(what: str) -> str:
    return f"{what}_{uuid.uuid4().hex}"


def stream_append(spark: SparkSession, d: str) -> DataFrame:
    return log_stream.drained(log_stream.appended(_updates(spark, d)), _name("append"))


def stream_compaction_due(spark: SparkSession, d: str) -> DataFrame:
    return log_stream.drained(log_stream.due(_updates(spark, d), 4), _name("due"))


def stream_deduplicate(spark: SparkSession, d: str) -> DataFrame:
    return log_stream.drained(log_stream.deduplicated(_updates(spark, d)).select("doc", "event_id"), _name("dedup"))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return log_stream.drained(log_stream.sessions(_updates(spark, d), "1 hour"), _name("sessions"), "complete").select("doc", "client", "n")


def grapheme_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(segment.graphemes("text")).alias("graphemes"))


def line_break_counts(spark: SparkSession, d: str) -> DataFrame:
    b = segment.breaks("text")
    return table(spark, d, "conversations").select("conv_id", "turn", b.alias("b")).select("conv_id", "turn", F.size(F.filter("b", lambda x: x == 1)).alias("allowed"), F.size(F.filter("b", lambda x: x == 2)).alias("mandatory"))


def text_direction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", segment.direction(F.when(may_be_rtl(F.col("text")), F.col("text"))).alias("direction"))


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    """A delta for each turn: block turn % 3 gets the turn's text."""
    node = F.struct(F.struct((F.col("turn") % 3).alias("ID"), F.col("text").alias("Text"), F.array(F.array(F.lit(0), F.octet_length("text"), F.lit(0))).alias("Runs")).alias("_TreeNode_(paragraph)"))
    raw = F.to_json(F.struct((F.col("turn") + 1).alias("Delta"), F.lit(0).alias("FormatBase"), F.array(node).alias("Blocks")))
    return delta.parsed(table(spark, d, "conversations").select("conv_id", raw.alias("raw")), "conv_id", "raw")


def delta_replay(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("doc"), F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)])).alias("id"), F.lit("old").alias("text"))
    return delta.replayed(first, delta.block_states(_deltas(spark, d)))


def delta_continuity(spark: SparkSession, d: str) -> DataFrame:
    return delta.checked(_deltas(spark, d)).groupBy("doc").agg(F.count("*").alias("deltas"), F.count(F.when(F.col("ok"), 1)).alias("ok"))


def json_trees(spark: SparkSession, d: str) -> DataFrame:
    para = F.struct(F.struct((F.col("turn") + 2).alias("ID"), F.lit("body").alias("Role"), F.col("text").alias("Text")).alias("_TreeNode_(paragraph)"))
    kids = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", para.alias("p")))).alias("k"))
    tree = F.struct(F.struct(F.lit(1).alias("ID")).alias("_TreeNode_(section)"), F.transform("k", lambda x: x["p"]).alias("_TreeChildren_"))
    root = F.struct(F.struct(F.lit(0).alias("ID")).alias("_TreeNode_(root)"), F.array(tree).alias("_TreeChildren_"))
    files = kids.select("conv_id", F.to_json(F.struct(root.alias("Document"))).alias("content"))
    return delta.json_trees(files, "conv_id", "content").select("conv_id", "id", "kind", "parent", "ord", "text")


QUERIES = {f.__name__: f for f in (stream_append, stream_compaction_due, stream_deduplicate, stream_sessions, grapheme_counts, line_break_counts, text_direction, delta_replay, delta_continuity, json_trees)}

ORACLE = {
    "grapheme_counts": "SELECT conv_id, turn, length_grapheme(text) AS graphemes FROM conversations",
    "stream_append": "SELECT user_id AS doc, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events",
    "stream_compaction_due": "SELECT doc, k * 4 AS upto FROM (SELECT user_id AS doc, count(*) // 4 AS n FROM events GROUP BY 1), unnest(range(1, n + 1)) AS r(k)",
    "stream_deduplicate": "SELECT user_id AS doc, event_id FROM events",
    "stream_sessions": """SELECT doc, client, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY doc, client ORDER BY ts, event_id) AS s FROM (SELECT user_id AS doc, event_type AS client, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY doc, client, s""",
    "text_direction": r"SELECT doc_id, CASE WHEN regexp_matches(text, '[\x{0590}-\x{08FF}]') THEN 2 ELSE 0 END AS direction FROM documents",
    "delta_replay": "SELECT b.conv_id AS doc, b.id, coalesce(c.text, 'old') AS text, c.text IS NOT NULL AS changed FROM (SELECT DISTINCT conv_id, unnest([0, 1, 2, 3]) AS id FROM conversations) b LEFT JOIN (SELECT conv_id, turn % 3 AS id, arg_max(text, turn) AS text FROM conversations GROUP BY 1, 2) c USING (conv_id, id)",
    "delta_continuity": "SELECT conv_id AS doc, count(*) AS deltas, count(CASE WHEN turn = n THEN 1 END) AS ok FROM (SELECT *, coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1, 0) AS n FROM conversations) GROUP BY 1",
    "json_trees": "SELECT conv_id, turn + 2 AS id, 'paragraph' AS kind, 1 AS parent, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS ord, text FROM conversations UNION ALL SELECT DISTINCT conv_id, 1, 'section', 0, 0, NULL FROM conversations UNION ALL SELECT DISTINCT conv_id, 0, 'root', NULL, 0, NULL FROM conversations",
}
