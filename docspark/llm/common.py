"""Helpers that the training-data operators share: reading, folds, the shared
folder and files in it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: A-Z to a-z and nothing else, as a table for bytes.translate.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(of)


def fresh(taken: list[str], *wanted: str) -> tuple[str, ...]:
    """Names for columns of our own that no column in taken has, whatever its case."""
    low = {x.lower() for x in taken}
    out = []
    for name in wanted:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return tuple(out)


def in_sample(doc_id: Column, most: Column | int, of: Column | int) -> Column:
    """Whether a hash of the id is among the first most / of of all: most rows of of in
    expectation, at any size."""
    hashed = F.shiftrightunsigned(F.xxhash64(doc_id), 1).cast("double") / F.lit(float(1 << 63))
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return hashed * as_column(of).cast("double") < as_column(most).cast("double")


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/docspark/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The frame written to the shared folder and read back: cuts the lineage,
    and survives the loss of any executor."""
    path = fresh_dir(df.sparkSession, what)
    _MADE.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders that stored() has written, in order.
_MADE: list[str] = []


def made() -> int:
    return len(_MADE)


def swept(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Deletes the folders that were written after made() gave since, but for the one that
    keep is read from: for a caller that has written what it needs of them."""
    kept = {f.rsplit("/", 2)[-2] for f in keep.inputFiles()}
    left = []
    for path in _MADE[since:]:
        if path.rsplit("/", 1)[1] in kept:
            left.append(path)
            continue
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _MADE[since:] = left


def broadcast_if_small(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Stored rows of a few numbers, marked for broadcast if they are counted to be most
    or fewer (some 50 MB); more are left to a shuffle."""
    return F.broadcast(rows) if rows.count() <= most else rows


def removed(df: DataFrame) -> None:
    """Deletes the files of a frame made by stored(), once nothing reads it."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path and the path within it. Runs on
    executors: file, hdfs, s3 and gs are what pyarrow opens by itself."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def tidy(words: bool = False) -> None:
    """Gives back what earlier tasks of this Python worker left: free memory that the
    allocators hold and, but where a task has use for them, words that a tokeniser
    keeps."""
    import ctypes
    import gc
    import sys

    tokens = sys.modules.get("docspark.llm.tokens")
    if tokens and not words:
        tokens.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it has
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task run, tidied up before, and also after it: a worker that waits for its
    next task else keeps the most that any task took."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        try:
            yield from run(batches)
        finally:
            tidy()

    return task


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def spread(df: DataFrame) -> int:
    """Partitions for a shuffle of whole rows: what the session says, so that it
    follows the cluster and not the code."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
