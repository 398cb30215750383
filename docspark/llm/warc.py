"""WARC archives: writing with revisits, and the monolithic gzip normaliser.

A WARC file compressed as one gzip stream can't be read from the middle. The
normaliser inflates such a file once, as a stream, finds each record by its
header and Content-Length, rewrites it as a gzip member of its own, and writes
a sidecar index with a line of JSON for each record: where its member stands
and what it is. A reader then opens any record by itself. Files that have many
members already are inflated all the same and come out alike.

Of records with equal payloads one is a response and the others are revisits
that refer to it; which, is found by an aggregation of digests before any file
is written.

Defined results: ids are whole numbers; a null payload is an empty one; rows with a null id are
written but no revisit refers to them unless they are the only choice, and then
it names no id; of rows with equal ids and payloads one counts as above and the
others are revisits, those of the least URL first (null URLs last); an empty table
makes no file; a truncated file's last record is dropped and reported in
the index as ``truncated``.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, stored

CHUNK = 1 << 20
#: The profile of a revisit by digest, from the WARC 1.1 specification (fixed value).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id, url: str | None, payload: bytes, sha1: str, refers_to, date: str) -> bytes:
    """One record; a revisit has headers and no payload of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {''.join(c for c in url or '' if c.isprintable())}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, in chunks."""
    z = zlib.decompressobj(31)
    while raw := source.read(CHUNK):
        while raw:
            out = z.decompress(raw, CHUNK)
            if out:
                yield out
            if z.eof:
                raw, z = z.unused_data, zlib.decompressobj(31)
            else:
                raw = z.unconsumed_tail
    if rest := z.flush():
        yield rest


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(headers by lower name, the whole record, whether it is complete), one at a
    time: memory holds a record and a chunk."""
    held = bytearray()
    chunks = iter(chunks)

    def more() -> bool:
        x = next(chunks, None)
        held.extend(x or b"")
        return x is not None

    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        end = held.find(b"\r\n\r\n")
        if end < 0:
            if more():
                continue
            if held.strip():
                yield {}, bytes(held), False
            return
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        head = {"version": lines[0]}
        for x in lines[1:]:
            name, _, value = x.partition(":")
            head[name.strip().lower()] = value.strip()
        size = end + 4 + int(head.get("content-length", 0))
        while len(held) < size + 4 and more():
            pass
        whole = len(held) >= size
        yield head, bytes(held[:size]), whole
        del held[: size + (4 if held[size : size + 4] == b"\r\n\r\n" else 0)]


def member(raw: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def normalise(source_uri: str, target_uri: str, level: int = 6) -> int:
    """Rewrites a gzip WARC with a member for each record, beside it target_uri with
    ``.idx``; returns the number of whole records."""
    where, path = filesystem(source_uri)
    there, target = filesystem(target_uri)
    there.create_dir(target.rsplit("/", 1)[0], recursive=True)
    n, at = 0, 0
    # buffered pairs: the index is complete only when the archive is
    with where.open_input_stream(path, compression=None) as source, there.open_output_stream(target, compression=None) as out, there.open_output_stream(target + ".idx", compression=None) as index:
        for head, raw, whole in records(inflated(source)):
            entry = {"offset": at, "length": 0, "type": head.get("warc-type"), "id": head.get("warc-record-id"), "refers_to": head.get("warc-refers-to"), "digest": head.get("warc-payload-digest")}
            if whole:
                packed = member(raw + b"\r\n\r\n", level)
                out.write(packed)
                entry["length"] = len(packed)
                at += len(packed)
                n += 1
            else:
                entry["truncated"] = True
            index.write(json.dumps(entry).encode() + b"\n")
    return n


def read_member(file, entry: dict) -> tuple[dict[str, str], bytes]:
    """Headers and content block of one record, by its index entry."""
    raw = zlib.decompress(file.read_at(entry["length"], entry["offset"]), 31)
    head, whole, _ = next(records(iter([raw])))
    return head, whole[whole.index(b"\r\n\r\n") + 4 :]


def kinds(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html (binary, nulls as empty), sha1, first (the page that revisits
    refer to), responses and revisits (how many records to write of each kind).
    Payloads of fewer than least_bytes are not compared."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    raw = pages.select("page_id", "url", body.alias("html"), F.sha1(body).alias("sha1"))
    # a payload that a third of all pages share is one row of each task before the shuffle
    each = raw.where(F.length("html") >= least_bytes).groupBy("sha1", "page_id").agg(F.count("*").alias("copies"))
    best = each.groupBy("sha1").agg(F.max("page_id").alias("first"), F.sum("copies").alias("n")).where("n > 1").drop("n")
    # only what isn't a lone response
    found = stored(each.join(best, "sha1").where(~F.col("page_id").eqNullSafe(F.col("first")) | (F.col("copies") > 1)).select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), "first", "copies"), "revisits")
    same = lambda f: raw.page_id.eqNullSafe(f._id) & (raw.sha1 == f._sha1)
    repeated = found.where("copies > 1")
    lone = F.coalesce(F.col("copies"), F.lit(1)) == 1
    kind = F.col("_sha1").isNull().cast("int")
    out = raw.join(found, same(found), "left").where(lone).select("page_id", "url", "html", "sha1", "first", kind.alias("responses"), (1 - kind).alias("revisits"))
    if repeated.isEmpty():
        return out
    # rows of one id and payload: counted by URL, with the payload once
    rows = raw.join(repeated, same(repeated)).groupBy("page_id", "sha1", "url", "first").agg(F.first("html").alias("html"), F.count("*").alias("n"))
    lead = rows.groupBy("page_id", "sha1").agg(F.min(F.struct(F.col("url").isNull(), "url")).alias("lead")).select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), F.col("lead.url").alias("_url"))
    with_lead = rows.join(lead, rows.page_id.eqNullSafe(lead._id) & (rows.sha1 == lead._sha1))
    kind = (F.col("page_id").eqNullSafe(F.col("first")) & F.col("url").eqNullSafe(F.col("_url"))).cast("int")
    return out.unionByName(with_lead.select("page_id", "url", "html", "sha1", "first", kind.alias("responses"), (F.col("n") - kind).cast("int").alias("revisits")))


def write_archives(pages: DataFrame, out_dir: str, least_bytes: int = 0, date: str = "2020-01-01T00:00:00Z", keep_monolithic: bool = False) -> DataFrame:
    """Writes a WARC record for each row of page_id, url, html; returns the archives
    (path, records). Each task streams its rows into one gzip stream, normalises that
    file, and unless asked to keep it deletes it. A lost attempt leaves unlisted files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{out_dir}/part-{uuid.uuid4().hex}"
        where, path = filesystem(name + ".mono.warc.gz")
        where.create_dir(path.rsplit("/", 1)[0], recursive=True)
        z, out = zlib.compressobj(1, zlib.DEFLATED, 31), None
        for batch in batches:
            for page_id, url, html, sha1, first, responses, revisits in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                out = out or where.open_output_stream(path, compression=None)
                sha = base64.b32encode(bytes.fromhex(sha1)).decode()
                for kind, n in (("response", responses), ("revisit", revisits)):
                    for _ in range(n):
                        out.write(z.compress(record(kind, page_id, url, html, sha, first, date)))
        if out:
            out.write(z.flush())
            out.close()
            n = normalise(name + ".mono.warc.gz", name + ".warc.gz")
            if not keep_monolithic:
                where.delete_file(path)
            yield pa.RecordBatch.from_pydict({"path": [name + ".warc.gz"], "records": pa.array([n], pa.int64())})

    return stored(kinds(pages, least_bytes).mapInArrow(write, "path string, records long"), "archives")


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """A row per record, through the offset index: page_id, payload_bytes,
    payload_digest, record_type, refers_to. A revisit's length and digest are those of
    the payload that it refers to, as its headers have them."""

    def batch_of(rows: list) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, name = filesystem(path)
                with where.open_input_file(name) as file, where.open_input_stream(name + ".idx", compression=None) as index:
                    rows = []
                    for line in io.BufferedReader(index):
                        entry = json.loads(line)
                        if entry.get("truncated"):
                            continue
                        head, block = read_member(file, entry)
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        kind, sha = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and digest(payload) != sha:
                            raise ValueError(f"{path} at {entry['offset']}: the payload doesn't match its digest")
                        page, refers = head["warc-record-id"][10:-1], head.get("warc-refers-to", "")[10:-1]
                        rows.append((int(page) if page else None, len(payload) if kind == "response" else int(head["x-payload-length"]), sha, kind, int(refers) if refers else None))
                        if len(rows) == 10_000:
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    n = archives.count()
    return archives.select("path").repartition(max(1, n), "path").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
