"""Token-ID / binary output: bit-plane shuffled, compressed files of token ids.

A file holds the ids of consecutive documents. Ids are cut into blocks of a
fixed number; a block is transposed into planes (the 4 bytes of an id, or its
32 bits), each plane is compressed with zstandard by itself, and the chunk
index at the end of the file says where each block's planes stand. High
planes are all zero for small vocabularies and take no bytes.

Layout: MAGIC, blocks, footer (zstandard-compressed JSON: planes, block size,
``chunks`` as [offset, ids, size of each plane], document ids and counts),
length of the footer (8 bytes, little endian), MAGIC.

Defined results: ids are whole numbers; a null or empty text is a document of the end id alone; null
ids sort first; rows with equal ids stay separate documents, ordered by text;
an empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, stored, tidy
from .tokens import END_BYTES, encoder

MAGIC = b"DSPLANE1"
MANIFEST = "shard int, path string, n_docs long, n_tokens long"


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of a block of ids, lowest first; all-zero planes are empty."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        rows = raw.T
    else:
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        rows = np.packbits(bits.T, axis=1, bitorder="little")
    return [x.tobytes() if x.any() else b"" for x in rows]


def from_planes(rows: list[bytes], n: int, planes: str) -> np.ndarray:
    width = n if planes == "byte" else (n + 7) // 8
    full = np.zeros((len(rows), width), np.uint8)
    for k, x in enumerate(rows):
        if x:
            full[k] = np.frombuffer(x, np.uint8)
    if planes == "bit":
        full = np.packbits(np.unpackbits(full, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(full.T).view("<u4").reshape(-1)


class PlaneWriter:
    """Writes one file; holds a block of ids at most, and 16 bytes a document."""

    def __init__(self, uri: str, planes: str = "byte", block: int = 65_536, level: int = 1):
        import zstandard

        where, path = filesystem(uri)
        where.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = where.open_output_stream(path)
        self.planes, self.block, self.pack = planes, block, zstandard.ZstdCompressor(level=level)
        self.at, self.held, self.parts = len(MAGIC), 0, []
        self.chunks: list[list] = []
        self.ids: list = []
        self.counts: list[int] = []
        self.out.write(MAGIC)

    def add(self, doc_id, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= 4 * self.block:
            raw = b"".join(self.parts)
            step = 4 * self.block
            end = len(raw) // step * step
            for i in range(0, end, step):
                self._chunk(raw[i : i + step])
            self.parts, self.held = [raw[end:]], len(raw) - end

    def _chunk(self, raw: bytes) -> None:
        rows = [self.pack.compress(x) if x else b"" for x in to_planes(np.frombuffer(raw, "<u4"), self.planes)]
        self.chunks.append([self.at, len(raw) // 4, [len(x) for x in rows]])
        for x in rows:
            self.out.write(x)
            self.at += len(x)

    def close(self) -> None:
        if self.held:
            self._chunk(b"".join(self.parts))
        foot = self.pack.compress(json.dumps({"planes": self.planes, "block": self.block, "chunks": self.chunks, "ids": self.ids, "counts": self.counts}).encode())
        self.out.write(foot + len(foot).to_bytes(8, "little") + MAGIC)
        self.out.close()


class PlaneReader:
    """Reads a file's footer; chunks are read one at a time as documents are asked for."""

    def __init__(self, uri: str):
        import zstandard

        where, path = filesystem(uri)
        self.file, self.unpack = where.open_input_file(path), zstandard.ZstdDecompressor()
        end = self.file.size()
        tail = self.file.read_at(16, end - 16)
        if tail[8:] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri}: not a plane file")
        size = int.from_bytes(tail[:8], "little")
        self.foot = json.loads(self.unpack.decompress(self.file.read_at(size, end - 16 - size)))

    def chunk(self, k: int) -> bytes:
        at, n, sizes = self.foot["chunks"][k]
        raw, rows, i = self.file.read_at(sum(sizes), at), [], 0
        for s in sizes:
            rows.append(self.unpack.decompress(raw[i : i + s]) if s else b"")
            i += s
        return from_planes(rows, n, self.foot["planes"]).tobytes()

    def documents(self) -> Iterator[tuple]:
        """(doc_id, ids as bytes), in file order."""
        held, k = b"", 0
        at = 0
        for doc_id, n in zip(self.foot["ids"], self.foot["counts"], strict=True):
            parts, need = [], 4 * n
            while need:
                if at == len(held):
                    held, at, k = self.chunk(k), 0, k + 1
                take = min(need, len(held) - at)
                parts.append(held[at : at + take])
                at, need = at + take, need - take
            yield doc_id, b"".join(parts)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the file, through the chunk index."""
        block = self.foot["block"]
        first, last = start // block, -(-stop // block)
        raw = b"".join(self.chunk(k) for k in range(first, min(last, len(self.foot["chunks"]))))
        return np.frombuffer(raw, "<u4")[start - first * block : stop - first * block]


def encoded(batches: Iterable[pa.RecordBatch], path: str, group: int = 1_500_000) -> Iterator[tuple]:
    """(doc_id, ids with the end id as bytes) of batches with columns doc_id and text,
    encoded in groups of about ``group`` characters."""
    enc = encoder(path)
    ids: list = []
    held: list[str] = []
    size = 0

    def flush() -> Iterator[tuple]:
        for doc_id, raw in zip(ids, enc.encode(held), strict=True):
            yield doc_id, raw + END_BYTES

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            held.append(text or "")
            size += len(held[-1])
            if size >= group:
                yield from flush()
                ids, held, size = [], [], 0
    yield from flush()


def write_tokens(docs: DataFrame, out_dir: str, tokenizer: str, planes: str = "byte", block: int = 65_536, level: int = 1) -> DataFrame:
    """Writes the ids of doc_id, text in ascending doc_id order into files under
    out_dir, and returns their manifest (shard, path, n_docs, n_tokens), shards in
    order. One shuffle by range; a task streams its rows into one file under a name
    of its own, so an attempt that was lost leaves no more than an unlisted file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tidy(words=True)
        shard, out, n = TaskContext.get().partitionId(), None, 0
        path = f"{out_dir}/part-{shard:06d}-{uuid.uuid4().hex}.planes"
        for doc_id, raw in encoded(batches, tokenizer):
            out = out or PlaneWriter(path, planes, block, level)
            out.add(doc_id, raw)
            n += len(raw) // 4
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": pa.array([len(out.ids)], pa.int64()), "n_tokens": pa.array([n], pa.int64())})

    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(rows.mapInArrow(write, MANIFEST), "token-manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it in all the
    files), n_tokens, ids_crc32, and with with_ids the ids themselves as bytes. The
    manifest has one row per file, which is all that the driver gathers."""
    files, start = [], 0
    for x in sorted(manifest.collect(), key=lambda x: x.shard):
        files.append((x.path, start))
        start += x.n_tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]
    kinds = [pa.int64()] * 4 + [pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for doc_id, raw in PlaneReader(path).documents():
                    n = len(raw) // 4
                    rows.append((doc_id, at, n, zlib.crc32(raw), raw)[: 4 + with_ids])
                    at += n
                    if len(rows) >= (200 if with_ids else 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    listed = spark.createDataFrame(files, "path string, start long")
    return listed.repartition(max(1, len(files)), F.col("path")).mapInArrow(read, schema)
