"""Near-duplicates by the Jaccard similarity of word shingles: candidates by SimHash,
each link checked on whole sets.

1. Equal sets are one node from the start, so copies make no pairs.
2. Every set has a SimHash of 256 bits; pairs near each other are found by the tables
   of simhash.py, which tell the share of pairs of the similarity that they may miss.
3. Candidates are verified by whole sets. Where a table has many pairs of a set, they
   aren't told one by one: a forest tells what they connect. The sets of each part of
   it come to one place (a large part's to a place for every two of its pieces), are
   compared there, and what is similar gives a forest again. So pairs make no more rows
   than a multiple of the sets. Comparisons in a place grow with the square of a part;
   beyond two pieces its sets are copied, once a piece.

Defined results: null and empty texts have one set, the empty one; fewer words than
a shingle make one shingle. Rows are decided one by one: of linked rows the one with
the least doc_id stays, null ids last, and one row of those with equal ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, broadcast_if_small, fresh, removed, spread, stored, texts, tidy
from .graph import connected_components
from .simhash import by_key, columns_of, in_parts, later, merged, near_pairs, of_sets
from .simhash import mixed as _mixed

#: Bytes whose words are hashed at once.
CHUNK = 1 << 19
#: Shingles of a piece of a part of near sets, and of sets that are looked up at once.
PIECE, AT_ONCE = 1 << 22, 1 << 20

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, n of each at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 4096)
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, x, np.uint64))]) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of lowered bytes begins, and its 64-bit hash: a polynomial over
    its bytes, told by running sums, and mixed."""
    starts, hashes, at = [], [], 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        b = np.frombuffer(raw, np.uint8, end - at, at)
        gap = np.concatenate([[True], _SPACE[b], [True]])
        first = np.flatnonzero(gap[:-1] & ~gap[1:])
        last = np.flatnonzero(~gap[:-1] & gap[1:])
        up, down = _powers(len(b) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[b] * up[: len(b)])])
        starts.append(first + at)
        hashes.append(_mixed((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)))
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingles(many: list[bytes], shingle: int) -> list[np.ndarray]:
    """The 64-bit hashes of each text's word shingles, in reading order."""
    offsets = np.cumsum([0, *(len(t) + 1 for t in many)])
    starts, w = word_hashes(b" ".join(many).translate(LOWER))
    bounds = np.searchsorted(starts, offsets).tolist()

    def over(w: np.ndarray, size: int) -> np.ndarray:
        n = len(w) - size + 1
        h = np.full(max(0, n), size, np.uint64)
        for k in range(size):
            h = _mixed(h + w[k : k + n]) if n > 0 else h
        return h

    h = over(w, shingle)
    return [h[a : b - shingle + 1] if b - a >= shingle else over(w[a:b], b - a) if b > a else h[:0] for a, b in zip(bounds, bounds[1:], strict=False)]


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def _keyed(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, row, node (a digest of the row's set), its size, print (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            sets = [distinct(h) for h in shingles(texts(batch.column(2)), shingle)]
            nodes = [hashlib.md5(h.tobytes()).digest() for h in sets]
            sizes = [len(h) for h in sets]
            prints = [x.tobytes() if len(h) else None for x, h in zip(of_sets(sets), sets, strict=True)]
            own = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], ["doc_id", "row", "node", "size", "print"])

    return docs.select("doc_id", "row", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, row long, node binary, size long, print binary")


def _similar(percent: int):
    """A block of rows (root, i, j, side, row, size, print, hashes) to edges (a, b), as few
    as connect what its similar pairs connect."""

    def edges(block: pa.Table) -> pa.RecordBatch:
        row, side, size, prints = columns_of(block)
        flat = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in block.column("hashes")])
        names = np.unique(flat)
        ids = np.concatenate([np.searchsorted(names, flat[i : i + AT_ONCE]).astype(np.int32) for i in range(0, len(flat), AT_ONCE)])
        del flat
        starts = np.cumsum(size) - size
        label, mine = np.arange(len(row)), np.zeros(len(names), bool)
        a, b = [], []
        for k, near in later(prints, size, label, side, 0, percent):
            mine[ids[starts[k] : starts[k] + size[k]]] = True
            upto = np.cumsum(size[near])
            for some in np.split(near, np.searchsorted(upto, np.arange(AT_ONCE, upto[-1], AT_ONCE))):
                if not len(some):
                    continue
                sizes = size[some]
                first = np.cumsum(sizes) - sizes
                at = np.arange(sizes.sum()) + np.repeat(starts[some] - first, sizes)
                both = np.add.reduceat(mine[ids[at]], first, dtype=np.int64)
                some = merged(label, k, some[both * 100 >= percent * (size[k] + sizes - both)])
                a += [k] * len(some)
                b += some.tolist()
            mine[ids[starts[k] : starts[k] + size[k]]] = False
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.RecordBatch.from_pydict({"a": row[a], "b": row[b]})

    return by_key(edges)


def _within(docs: DataFrame, roots: DataFrame, shingle: int, percent: int, region: int) -> DataFrame:
    """docs (row, text) and stored (node, root) of rows with words to edges (a, b) that
    connect what similar pairs of one root connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            sets = [distinct(h) for h in shingles(texts(batch.column(2)), shingle)]
            own = [pa.array([len(h) for h in sets], pa.int64()), pa.array([x.tobytes() for x in of_sets(sets)], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], ["root", "row", "size", "print", "hashes"])

    own = docs.join(broadcast_if_small(roots), docs.row == roots.node).select("root", "row", "text")
    sets = stored(own.mapInArrow(run, "root long, row long, size long, print binary, hashes binary"), "sets")
    pieces = F.greatest(F.ceil(F.count("*") / region), F.ceil(F.sum("size") / PIECE)).alias("parts")
    parts = stored(sets.groupBy("root").agg(pieces).where("parts > 2"), "large")
    found = stored(in_parts(sets, "root", parts, spread(docs)).mapInArrow(_similar(percent), "a long, b long"), "links")
    removed(sets)
    return found


def _verified(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of the stored pairs (a, b) whose whole sets are as similar as percent."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            found = [distinct(h).tobytes() for h in shingles(texts(batch.column(1)), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["row", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(distinct(np.concatenate([x, y])))
                ok.append(both * 100 >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    rows = stored(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct(), "rows")
    whole = stored(docs.select("row", "text").join(broadcast_if_small(rows), "row", "left_semi").mapInArrow(sets, "row long, hashes binary"), "sets")
    left = pairs.join(whole.select(F.col("row").alias("a"), F.col("hashes").alias("x")), "a")
    both = left.join(whole.select(F.col("row").alias("b"), F.col("hashes").alias("y")), "b")
    found = stored(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
    removed(whole)
    removed(rows)
    return found


def links(docs: DataFrame, members: DataFrame, shingle: int, percent: int, region: int) -> DataFrame:
    """docs (row, text) and stored members (row, size, print), sets all different, to
    edges (a, b) that connect what pairs of percent similarity connect."""
    found = stored(near_pairs(members, percent, members.count(), region), "near")
    pairs = stored(found.where("not later").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    out = _verified(pairs, docs, shingle, percent)
    removed(pairs)
    roots = connected_components(found.where("later"))
    removed(found)
    if not roots.isEmpty():
        out = out.unionByName(_within(docs, roots, shingle, percent, region))
    return out


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80, region: int = 16_384) -> DataFrame:
    """The documents without those that are linked to an earlier one, in the order of
    doc_id. All columns are kept. region: about how many sets are compared in one place."""
    number = fresh(docs.columns, "_row")[0]
    whole = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    own = whole.select("doc_id", F.col(number).alias("row"), "text")
    keyed = stored(_keyed(own, shingle), "keyed")
    rows = keyed.select("node", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row").alias("r"))
    nodes = stored(rows.groupBy("node").agg(F.min("r").alias("r")).select(F.col("r.row").alias("row"), "r"), "nodes")
    members = stored(keyed.where("print is not null").select("row", "size", "print").join(nodes.select("row"), "row", "left_semi"), "members")
    edges = links(own, members, shingle, percent, region)
    removed(members)
    roots = connected_components(edges)
    named = nodes.join(roots, nodes.row == roots.node, "left").select(F.coalesce("root", "row").alias("root"), "r")
    kept = named.groupBy("root").agg(F.min("r").alias("r")).select(F.col("r.row").alias(number))
    gone = stored(rows.select(F.col("r.row").alias(number)).join(kept, number, "left_anti"), "gone")
    return whole.join(broadcast_if_small(gone), number, "left_anti").select(*docs.columns)
