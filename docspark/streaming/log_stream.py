"""The update log as a stream: numbering, presence, compaction triggers, dedup.

State is kept by document: a counter, or each client's latest sign of life; no
operator keeps more than that."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_dir

UPDATE = "doc long, client string, data string, at timestamp, event_id long"


def source(spark: SparkSession, path: str, schema: str = UPDATE, files_at_once: int = 1) -> DataFrame:
    """Updates as files of Parquet arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def appended(updates: DataFrame) -> DataFrame:
    """doc, event_id, seq: each update takes its document's next number. Within one
    micro-batch updates are taken by time and id; the state is one number a document."""

    def take(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (0,)
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        seq = range(last + 1, last + 1 + len(rows))
        state.update((last + len(rows),))
        yield pd.DataFrame({"doc": key[0], "event_id": rows["event_id"].to_numpy(), "seq": list(seq)})

    return updates.groupBy("doc").applyInPandasWithState(take, "doc long, event_id long, seq long", "last long", "append", GroupStateTimeout.NoTimeout)


def due(updates: DataFrame, every: int = 500) -> DataFrame:
    """doc, upto: a row whenever a document has had every more updates: a window of
    counts, the state being one number a document."""

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        m = n + sum(map(len, frames))
        state.update((m,))
        hit = [k * every for k in range(n // every + 1, m // every + 1)]
        yield pd.DataFrame({"doc": [key[0]] * len(hit), "upto": hit})

    return updates.groupBy("doc").applyInPandasWithState(count, "doc long, upto long", "n long", "append", GroupStateTimeout.NoTimeout)


def presence(states: DataFrame, ttl: str = "30 seconds") -> DataFrame:
    """doc, client, window, state: each client's latest state within a time to live of
    event time; late rows beyond it are dropped."""
    return states.withWatermark("at", ttl).groupBy("doc", "client", F.window("at", ttl)).agg(F.max_by("data", F.struct("at", "event_id")).alias("state"), F.max("at").alias("at"))


def deduplicated(updates: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """Updates delivered twice count once, as long as the second comes within ttl."""
    return updates.withWatermark("at", ttl).dropDuplicatesWithinWatermark(["doc", "event_id"])


def sessions(updates: DataFrame, gap: str = "30 seconds") -> DataFrame:
    """Bursts of a client's updates: from, to and their number."""
    w = F.session_window("at", gap)
    return updates.withWatermark("at", gap).groupBy("doc", "client", w.alias("w")).agg(F.count("*").alias("n")).select("doc", "client", F.col("w.start").alias("from"), F.col("w.end").alias("to"), "n")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, and returns what it gave: files in the shared
    folder, a folder for each micro-batch, which a repeated one writes anew; of a
    complete result the last batch is all."""
    path = f"{shared_dir(stream.sparkSession)}/docspark/{name}"
    done: list[int] = []

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={k}")
        done.append(k)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    if not done:
        return spark.createDataFrame([], stream.schema)
    kept = done[-1:] if mode == "complete" else sorted(set(done))
    return spark.read.schema(stream.schema).parquet(*[f"{path}/rows/batch={k}" for k in kept])
