"""The update log of shared documents: append-only rows (doc, seq, client, author,
data, at) and a snapshot (doc, upto, data, at) that stands for all up to upto."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_seq(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """doc, last: the greatest number of updates and snapshot."""
    a = log.select("doc", F.col("seq").alias("n"))
    return a.unionByName(snapshots.select("doc", F.col("upto").alias("n"))).groupBy("doc").agg(F.max("n").alias("last"))


def appended(new: DataFrame, log: DataFrame, snapshots: DataFrame, order: list[str]) -> DataFrame:
    """New updates with the numbers that follow those their documents have."""
    n = F.row_number().over(W.partitionBy("doc").orderBy(*order))
    numbered = new.withColumn("_n", n).join(last_seq(log, snapshots), "doc", "left")
    return numbered.withColumn("seq", F.col("_n") + F.coalesce("last", F.lit(0))).drop("_n", "last")


def after(log: DataFrame, snapshots: DataFrame, since: Column | int, limit_bytes: int) -> DataFrame:
    """doc, seq, data of what a reader that has all up to since must get: the snapshot
    first where it is newer, then the updates after both, in order, as many as the
    limit of bytes admits but always the first."""
    since = F.lit(since) if isinstance(since, int) else since
    snaps = snapshots.select("doc", "upto", F.col("data").alias("_snap"))
    tail = log.join(snaps.select("doc", "upto"), "doc", "left").where(F.col("seq") > F.greatest(since, F.coalesce("upto", F.lit(0)))).select("doc", "seq", "data")
    head = snaps.where(F.col("upto") > since).select("doc", F.col("upto").alias("seq"), F.col("_snap").alias("data"))
    w = W.partitionBy("doc").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    both = head.unionByName(tail).withColumns({"_sum": F.sum(F.octet_length("data")).over(w), "_n": F.count("*").over(w)})
    return both.where((F.col("_sum") <= limit_bytes) | (F.col("_n") == 1)).select("doc", "seq", "data")


def compacted(log: DataFrame, snapshots: DataFrame, merge: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """New snapshots and what is left of the log. Parts (snapshot, then updates after
    it) are merged by merge over the ordered array ``parts``; a document with fewer
    than two parts, or whose merge gives null, keeps its snapshot and its log."""
    tail = log.join(snapshots.select("doc", "upto"), "doc", "left").where(F.col("seq") > F.coalesce("upto", F.lit(0)))
    parts = snapshots.select("doc", F.col("upto").alias("seq"), "data").unionByName(tail.select("doc", "seq", "data"))
    folded = parts.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("_p"), F.max("seq").alias("upto"))
    folded = folded.where(F.size("_p") >= 2).select("doc", "upto", F.transform("_p", lambda x: x["data"]).alias("parts"))
    made = folded.select("doc", "upto", (F.array_join("parts", "") if merge is None else merge).alias("data")).where("data is not null")
    kept = snapshots.select("doc", "upto", "data").join(made.select("doc"), "doc", "left_anti")
    rest = log.join(made.select("doc", F.col("upto").alias("_upto")), "doc", "left").where("_upto is null or seq > _upto").drop("_upto")
    return made.unionByName(kept), rest


def info(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """doc, last, snapshot, updates (after the snapshot)."""
    base = F.coalesce("upto", F.lit(0))
    docs = last_seq(log, snapshots).join(snapshots.select("doc", "upto"), "doc", "left")
    n = log.join(snapshots.select("doc", "upto"), "doc", "left").groupBy("doc").agg(F.count(F.when(F.col("seq") > base, 1)).alias("updates"))
    return docs.join(n, "doc", "left").select("doc", "last", base.alias("snapshot"), F.coalesce("updates", F.lit(0)).alias("updates"))


def presence(states: DataFrame, now: Column, ttl_seconds: int = 30, but: str | None = None) -> DataFrame:
    """doc, client, state, at: each client's latest state that is not older than the
    time to live, without the caller's own."""
    live = states.where((F.col("at") <= now) & (F.col("at") >= now - F.expr(f"INTERVAL {ttl_seconds} SECONDS")))
    if but is not None:
        live = live.where(F.col("client") != but)
    return live.groupBy("doc", "client").agg(F.max_by("state", F.struct("at", "n")).alias("state"), F.max("at").alias("at"))


def compaction_due(log: DataFrame, every: int = 500) -> DataFrame:
    """doc, due: how often every appends have been reached."""
    return log.groupBy("doc").agg(F.floor(F.count("*") / every).alias("due"))
