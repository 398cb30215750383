"""Queries of the update log, presence, sessions, runs, revisions and threads.

events is read as a log: the document is the user, updates are numbered by time
and id, data is the event's properties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import log, runs
from .common import table

UPTO = 5


def _new(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("doc"), F.col("event_type").alias("client"), F.col("props").alias("data"), F.col("ts").alias("at"), "event_id")


def _log(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("doc").orderBy("at", "event_id"))
    return _new(spark, d).withColumn("seq", n)


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot up to the fifth update of every third document."""
    part = _log(spark, d).where(f"doc % 3 = 0 and seq <= {UPTO}")
    return part.groupBy("doc").agg(F.max("seq").cast("int").alias("upto"), F.max_by("data", "seq").alias("data"))


def log_append(spark: SparkSession, d: str) -> DataFrame:
    old = _log(spark, d).where(f"seq <= {UPTO}")
    new = _log(spark, d).where(f"seq > {UPTO}").drop("seq")
    return log.appended(new, old, _snapshots(spark, d), ["at", "event_id"]).select("doc", "event_id", "seq")


def log_last(spark: SparkSession, d: str) -> DataFrame:
    return log.last_seq(_log(spark, d), _snapshots(spark, d))


def log_after(spark: SparkSession, d: str) -> DataFrame:
    return log.after(_log(spark, d).select("doc", "seq", "data"), _snapshots(spark, d), 3, 60)


def log_info(spark: SparkSession, d: str) -> DataFrame:
    return log.info(_log(spark, d), _snapshots(spark, d))


def log_compact(spark: SparkSession, d: str) -> DataFrame:
    snaps, rest = log.compacted(_log(spark, d).select("doc", "seq", "data"), _snapshots(spark, d))
    left = rest.groupBy("doc").agg(F.count("*").alias("left"))
    return snaps.join(left, "doc", "left").select("doc", "upto", "data", F.coalesce("left", F.lit(0)).alias("left"))


def log_compaction_due(spark: SparkSession, d: str) -> DataFrame:
    return log.compaction_due(_log(spark, d), 4)


def log_deduplicate(spark: SparkSession, d: str) -> DataFrame:
    twice = _log(spark, d).select("doc", "seq", "data")
    return twice.unionByName(twice.where("seq % 2 = 0")).dropDuplicates(["doc", "seq"])


def presence_latest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.lit(0).alias("doc"), F.col("user_id").alias("client"), F.col("props").alias("state"), F.col("ts").alias("at"), F.col("event_id").alias("n"))
    # a bounded value: the table's last moment
    now = e.agg(F.max("at")).first()[0]
    return log.presence(e, F.lit(now), 86_400).select("client", "state", "at")


def typing_sessions(spark: SparkSession, d: str) -> DataFrame:
    ops = _log(spark, d).select("doc", "seq", (F.col("seq") + F.floor(F.col("event_id") % 7 / 6)).alias("at_"), F.lit(1).alias("n"))
    return runs.typing_sessions(ops, ["doc"], ["seq"], "at_", "n").groupBy("doc", "step").agg(F.min("seq").alias("first"), F.count("*").alias("edits"))


def undo_limit(spark: SparkSession, d: str) -> DataFrame:
    return runs.last_steps(_log(spark, d), ["doc"], F.col("seq"), 3).select("doc", "seq")


def run_coalesce(spark: SparkSession, d: str) -> DataFrame:
    got = runs.coalesced(_log(spark, d).select("doc", "seq", "client"), ["doc"], ["seq"], "client")
    return got.select("doc", "run_no", "client", F.col("first.seq").alias("first"), F.col("last.seq").alias("last"), "n")


def run_split(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as runs of ten characters; formats set over [5, 17) and [30, 34)."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("format"))
    r = lines.select(F.col("l_orderkey").alias("block"), ((F.col("l_linenumber") - 1) * 10).cast("int").alias("start"), (F.col("l_linenumber") * 10).cast("int").alias("end"), "format")
    keys = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("block")).distinct()
    ranges = keys.select("block", F.explode(F.array(F.struct(F.lit(5).alias("from"), F.lit(17).alias("to"), F.lit("bold").alias("set")), F.struct(F.lit(30).alias("from"), F.lit(34).alias("to"), F.lit("it").alias("set")))).alias("x")).select("block", "x.*")
    return runs.split_at(r, ranges, "block")


def _tracked(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("turn") % 3 == 1, "insert").when(F.col("turn") % 3 == 2, "delete")
    return table(spark, d, "conversations").select("conv_id", "turn", "text", kind.alias("kind"))


def revision_views(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for view in ("final", "original", "inline"):
        one = runs.view_text(_tracked(spark, d), ["conv_id"], "turn", "text", "kind", view).withColumn("view", F.lit(view))
        out = one if out is None else out.unionByName(one)
    return out


def revision_stretches(spark: SparkSession, d: str) -> DataFrame:
    got = runs.coalesced(_tracked(spark, d).select("conv_id", "turn", "kind"), ["conv_id"], ["turn"], "kind").where("kind is not null")
    return got.select("conv_id", "kind", F.col("first.turn").alias("first"), F.col("last.turn").alias("last"), "n")


def run_spans(spark: SparkSession, d: str) -> DataFrame:
    marked = _tracked(spark, d).select(F.col("conv_id").alias("block"), F.col("turn").alias("start"), F.replace("text", F.lit(", "), F.lit("￼")).alias("text"), "kind")
    return runs.spans(marked, "block", "text").groupBy("block", "start").agg(F.count("*").alias("spans"), F.count(F.when(F.col("span") == "￼", 1)).alias("inlines"))


def author_index(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("author"), "ts", "event_id")
    return runs.author_index(e, "author", ["ts", "event_id"]).select("author", "author_no", "colour")


def comment_threads(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") - F.col("o_orderkey") % 4).alias("parent"), "o_custkey")
    return runs.threads(o, "o_orderkey", "parent", F.col("o_custkey") % 5 == 0).select("o_orderkey", "parent")


def conversation_thread(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("reply_to"), F.count("*").over(w).alias("depth"))


_LOG = "lg AS (SELECT user_id AS doc, event_type AS client, props AS data, ts AS at, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"
_SNAP = f"sn AS (SELECT doc, max(seq)::INT AS upto, arg_max(data, seq) AS data FROM lg WHERE doc % 3 = 0 AND seq <= {UPTO} GROUP BY doc)"
_KIND = "CASE turn % 3 WHEN 1 THEN 'insert' WHEN 2 THEN 'delete' END"

QUERIES = {f.__name__: f for f in (log_append, log_last, log_after, log_info, log_compact, log_compaction_due, log_deduplicate, presence_latest, typing_sessions, undo_limit, run_coalesce, run_split, revision_views, revision_stretches, run_spans, author_index, comment_threads, conversation_thread)}

ORACLE = {
    "log_append": f"WITH {_LOG} SELECT doc, event_id, seq FROM lg WHERE seq > {UPTO}",
    "log_last": "SELECT user_id AS doc, count(*) AS last FROM events GROUP BY 1",
    "log_after": f"""WITH {_LOG}, {_SNAP},
a AS (SELECT doc, upto AS seq, data FROM sn WHERE upto > 3 UNION ALL SELECT lg.doc, seq, lg.data FROM lg LEFT JOIN sn USING (doc) WHERE seq > greatest(3, coalesce(upto, 0)))
SELECT doc, seq, data FROM (SELECT *, sum(strlen(data)) OVER w AS s, count(*) OVER w AS n FROM a WINDOW w AS (PARTITION BY doc ORDER BY seq)) WHERE s <= 60 OR n = 1""",
    "log_info": f"WITH {_LOG}, {_SNAP} SELECT doc, max(seq) AS last, coalesce(max(upto), 0) AS snapshot, count(CASE WHEN seq > coalesce(upto, 0) THEN 1 END) AS updates FROM lg LEFT JOIN sn USING (doc) GROUP BY doc",
    "log_compact": f"""WITH {_LOG}, {_SNAP},
p AS (SELECT doc, upto AS seq, data FROM sn UNION ALL SELECT lg.doc, seq, lg.data FROM lg LEFT JOIN sn USING (doc) WHERE seq > coalesce(upto, 0)),
m AS (SELECT doc, max(seq) AS upto, string_agg(data, '' ORDER BY seq) AS data FROM p GROUP BY doc HAVING count(*) >= 2),
f AS (SELECT * FROM m UNION ALL SELECT * FROM sn WHERE doc NOT IN (SELECT doc FROM m))
SELECT f.doc, f.upto, f.data, (SELECT count(*) FROM lg WHERE lg.doc = f.doc AND (lg.doc NOT IN (SELECT doc FROM m) OR lg.seq > f.upto)) AS left FROM f""",
    "log_compaction_due": "SELECT user_id AS doc, count(*) // 4 AS due FROM events GROUP BY 1",
    "log_deduplicate": f"WITH {_LOG} SELECT doc, seq, data FROM lg",
    "presence_latest": "SELECT user_id AS client, arg_max(props, {'a': ts, 'b': event_id}) AS state, max(ts) AS at FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 86400 SECONDS FROM events) GROUP BY 1",
    "typing_sessions": f"""WITH {_LOG}, o AS (SELECT doc, seq, seq + (event_id % 7) // 6 AS p FROM lg),
b AS (SELECT *, CASE WHEN p = lag(p) OVER w + 1 THEN 0 ELSE 1 END AS n FROM o WINDOW w AS (PARTITION BY doc ORDER BY seq)),
s AS (SELECT *, sum(n) OVER (PARTITION BY doc ORDER BY seq) AS step FROM b) SELECT doc, step, min(seq) AS first, count(*) AS edits FROM s GROUP BY doc, step""",
    "undo_limit": f"WITH {_LOG} SELECT doc, seq FROM (SELECT *, count(*) OVER (PARTITION BY doc) AS n FROM lg) WHERE seq > n - 3",
    "run_coalesce": f"""WITH {_LOG}, b AS (SELECT *, CASE WHEN client IS NOT DISTINCT FROM lag(client) OVER w AND seq > 1 THEN 0 ELSE 1 END AS n FROM lg WINDOW w AS (PARTITION BY doc ORDER BY seq)),
s AS (SELECT *, sum(n) OVER (PARTITION BY doc ORDER BY seq) AS run_no FROM b) SELECT doc, run_no, client, min(seq) AS first, max(seq) AS last, count(*) AS n FROM s GROUP BY doc, run_no, client""",
    "run_split": """WITH r AS (SELECT l_orderkey AS block, (l_linenumber - 1) * 10 AS a, l_linenumber * 10 AS b, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2, 3),
c AS (SELECT block, f, a, b, unnest(list_sort(list_distinct(list_filter([a, 5, 17, 30, 34, b], lambda x: x >= a AND x <= b)))) AS s FROM r),
p AS (SELECT block, f, s, lead(s) OVER (PARTITION BY block, a ORDER BY s) AS e FROM c)
SELECT block, s AS start, e AS "end", CASE WHEN s >= 5 AND e <= 17 THEN 'bold' WHEN s >= 30 AND e <= 34 THEN 'it' ELSE f END AS format FROM p WHERE e IS NOT NULL""",
    "revision_views": f"""WITH t AS (SELECT *, {_KIND} AS kind FROM conversations)
SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, 'final' AS view FROM t WHERE kind IS DISTINCT FROM 'delete' GROUP BY conv_id
UNION ALL SELECT conv_id, string_agg(text, '' ORDER BY turn), 'original' FROM t WHERE kind IS DISTINCT FROM 'insert' GROUP BY conv_id
UNION ALL SELECT conv_id, string_agg(text, '' ORDER BY turn), 'inline' FROM t GROUP BY conv_id""",
    "revision_stretches": f"""WITH t AS (SELECT *, {_KIND} AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, {_KIND} ORDER BY turn) AS g FROM conversations)
SELECT conv_id, kind, min(turn) AS first, max(turn) AS last, count(*) AS n FROM t WHERE kind IS NOT NULL GROUP BY conv_id, kind, g""",
    "run_spans": f"""WITH t AS (SELECT conv_id AS block, turn AS start, text, (length(text) - length(replace(text, ', ', ''))) // 2 AS inlines, len(list_filter(string_split(text, ', '), lambda x: x <> '')) AS words FROM conversations WHERE {_KIND} IS DISTINCT FROM 'delete')
SELECT block, start, inlines + words AS spans, inlines FROM t WHERE inlines + words > 0""",
    "author_index": "SELECT author, author_no, author_no % 8 AS colour FROM (SELECT event_type AS author, row_number() OVER (ORDER BY min({'a': ts, 'b': event_id})) - 1 AS author_no FROM events GROUP BY 1)",
    "comment_threads": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey - o_orderkey % 4 END AS parent, o_custkey % 5 = 0 AS gone FROM orders)
SELECT o_orderkey, parent FROM o WHERE NOT gone AND (parent IS NULL OR parent NOT IN (SELECT o_orderkey FROM o WHERE gone))""",
    "conversation_thread": "SELECT conv_id, turn, lag(role) OVER w AS reply_to, count(*) OVER w AS depth FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
}
