"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position of a fingerprint has a non-zero vector of radius + 1 bits.
For each non-zero vector v of that size there is a table, whose key keeps the
bits whose vector has an odd product with v. Up to radius differing positions
span less than the whole space, so some v is orthogonal to all of them: in its
table the two fingerprints have one key. No pair within the radius is missed.

A bucket is compared in one place only if its size is bounded (``bucket``), and
there by the tables of its free bits again. The fingerprints of a larger one are
keyed again by the bits still free, under the same guarantee, until buckets are small; a bucket has no more distinct fingerprints than its
free bits can spell, so this ends without a cap. Equal fingerprints are one
node from the start, so copies make no pairs.

Sets of a Jaccard similarity (near_pairs) lie further apart than tables for every
set of differing bits can reach: those of 0.8 differ in 15 of 100 bits, whatever the
width. Their fingerprints have 256 bits, and a table's key is a sample of them. A
table has about as many keys as keep ``region`` fingerprints under each, and there are
as many tables as leave MISS of the pairs at the similarity without a common key. Under
a key all fingerprints are compared; a larger key's in parts, each with each. Pairs of
which there are many for a row aren't told: what they connect is, by a forest.

Defined results: a text without words (null, empty) has fingerprint zero and
links like any other; fewer words than a shingle make one shingle; rows with
equal ids stay apart in the result; rows with a null id link, and give no
component its name unless it has no other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, broadcast_if_small, fresh, spread, stored, texts
from .graph import connected_components

ONES = (1 << 64) - 1

#: Words of 64 bits of fingerprints of sets.
WORDS = 4
#: Share of pairs at the similarity that have no key in common.
MISS = 1e-5
#: Near fingerprints of a set in a key that are told one by one.
FEW = 16
_SEEDS = np.random.default_rng(20).integers(0, 1 << 64, WORDS, np.uint64)


def fingerprint(text: bytes, shingle: int = 3, chunk: int = 1 << 16) -> int:
    """64-bit SimHash of the XXH64 (seed 42) of all word shingles of a text."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n < 1:
        return xxh64_intdigest(b" ".join(words), 42)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    over = np.zeros(64, np.int64)
    for i in range(0, n, chunk):
        h = np.array([xxh64_intdigest(flat[a:b], 42) for a, b in zip(starts[i : i + chunk], stops[i : i + chunk], strict=True)], ">u8")
        over += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * over > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text to doc_id, fp; fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def masks(radius: int, free: int = ONES) -> list[int]:
    """The bits that each table's key keeps, of those in free."""
    positions = [i for i in range(64) if free >> i & 1]
    size = (1 << radius + 1) - 1
    vector = {p: 1 + k % size for k, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() & 1) for v in range(1, size + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _join(x: np.ndarray, at: np.ndarray, label: np.ndarray, radius: int, free: int, small: int) -> None:
    """Gives the fingerprints x[at] one label per connected part; all agree outside
    the free bits. Many are split by the tables of the free bits first; what is one
    part already isn't compared again."""
    if len(at) <= small or free.bit_count() <= 10:  # then at most 1024 in all
        own = x[at]
        near = np.bitwise_count((own[:, None] ^ own[None, :]).view(np.uint64)) <= radius
        while True:
            mine = label[at]
            least = np.where(near, mine[None, :], len(x)).min(axis=1)
            if (least == mine).all():
                return
            # a label that gives way does so everywhere
            gives = np.arange(len(x))
            np.minimum.at(gives, mine, least)
            label[:] = gives[label]
    for m in masks(radius, free):
        key = x[at] & np.int64(signed(m))
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for run in np.split(order, cuts):
            part = at[run]
            if len(part) > 1 and (label[part] != label[part[0]]).any():
                _join(x, part, label, radius, free & ~m, small)


def _stars(radius: int, small: int = 256):
    """Buckets of distinct fingerprints to (a, b): each bucket's connected parts as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for bucket in batch.column(0).to_pylist():
                x = np.unique(np.asarray(bucket, np.int64))
                if len(x) == 2:
                    if ((int(x[0]) ^ int(x[1])) & ONES).bit_count() <= radius:
                        a.append(int(x[1]))
                        b.append(int(x[0]))
                    continue
                label = np.arange(len(x))
                _join(x, np.arange(len(x)), label, radius, ONES, small)
                far = np.flatnonzero(label != np.arange(len(x)))
                a += x[far].tolist()
                b += x[label[far]].tolist()
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def links(nodes: DataFrame, radius: int, bucket: int = 16_384) -> DataFrame:
    """Distinct fp to edges (a, b) that connect just what pairs within the radius
    connect. bucket: fingerprints that are compared in one place."""
    paths: list[tuple[int, int]] = [(0, 0)]  # of each path of tables: bits kept so far, parent
    # each row becomes one for every table, so a few large files would be few large tasks
    rows = nodes.select("fp", F.lit(0).alias("path")).repartition(spread(nodes))
    edges, level, base = None, [0], 0
    while True:
        following = []
        for p in level:
            for m in masks(radius, ONES & ~paths[p][0]):
                following.append(len(paths))
                paths.append((paths[p][0] | m, p))
        tables = (1 << radius + 1) - 1
        kept = F.array(*[F.lit(signed(paths[p][0])) for p in following])
        path = (F.col("path") - base) * tables + F.col("table")
        keyed = rows.select("fp", "path", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("table"))
        keyed = keyed.select("fp", (path + following[0]).alias("path"), F.get(kept, path).bitwiseAND(F.col("fp")).alias("key"))
        # a bucket has at most 2 ** free fingerprints: with ten free bits or fewer all are small
        done = max((ONES & ~paths[p][0]).bit_count() for p in following) <= 10
        sizes = stored(keyed.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
        near = keyed.join(sizes.where(F.lit(done) | (F.col("n") <= bucket)), ["path", "key"]).groupBy("path", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        found = near.mapInArrow(_stars(radius), "a long, b long")
        large = sizes.where(F.col("n") > bucket)
        if done or large.isEmpty():
            return edges.unionByName(found) if edges is not None else found
        # the other buckets of this level are done; the large ones' rows go on
        found = stored(found, "links")
        edges = edges.unionByName(found) if edges is not None else found
        rows = stored(keyed.join(large, ["path", "key"], "left_semi").select("fp", "path"), "large")
        level, base = following, following[0]


def components(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Stored doc_id, fp to doc_id, fp, component_id: the least doc_id that can be
    reached by links of at most radius differing bits."""
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = connected_components(links(nodes, radius).distinct())
    grouped = nodes.join(roots, nodes.fp == roots.node).select("fp", "root", "rep")
    named = grouped.groupBy("root").agg(F.min("rep").alias("named"))
    linked = grouped.join(named, "root").select("fp", "named")
    of = nodes.join(linked, "fp", "left").select("fp", F.coalesce("named", "rep").alias("component_id"))
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    return components(prints, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = 5, radius: int = 3) -> DataFrame:
    """One row of each component: that with the least doc_id, null ids last, and one of
    those with equal ids. Rows are decided one by one. All columns are kept."""
    row = fresh(docs.columns, "_row")[0]
    whole = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    prints = stored(fingerprints(whole.select(F.col(row).alias("doc_id"), "text"), shingle), "fingerprints")
    ids = whole.select(F.col(row).alias("row"), "doc_id")
    found = components(prints, radius).select(F.col("doc_id").alias("row"), "component_id").join(ids, "row")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("r"))
    return whole.join(first.select(F.col("r.row").alias(row)), row, "left_semi").select(*docs.columns)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def of_sets(sets: list[np.ndarray]) -> np.ndarray:
    """The fingerprints of sets of 64-bit hashes."""
    out = np.zeros((len(sets), WORDS * 8), np.uint8)
    for k, h in enumerate(sets):
        over = np.zeros(WORDS * 64, np.int64)
        for i in range(0, len(h), 255):  # what a byte can count
            bits = np.unpackbits(mixed(h[i : i + 255, None] + _SEEDS).view(np.uint8), axis=1)
            over += bits.sum(axis=0, dtype=np.uint8)
        out[k] = np.packbits(2 * over > len(h))
    return out.view(np.uint64)


def differing(percent: int) -> float:
    """The share of bits in which sets of equal size and this similarity differ."""
    return math.acos(2 * percent / (100 + percent)) / math.pi


def sampled_tables(n: int, percent: int, region: int) -> np.ndarray:
    """The bits of each table's key, a row a table; no bit serves twice before all have."""
    size = max(0, math.ceil(math.log2(max(1, n) / region)))
    if not size:
        return np.zeros((1, 0), np.int64)
    tables = math.ceil(math.log(MISS) / math.log1p(-((1 - differing(percent)) ** size)))
    each = WORDS * 64 // size
    rng = np.random.default_rng(21)
    turns = [rng.permutation(WORDS * 64)[: each * size].reshape(each, size) for _ in range(-(-tables // each))]
    return np.concatenate(turns)[:tables]


def later(prints: np.ndarray, size: np.ndarray, label: np.ndarray, side: np.ndarray, word: int, percent: int, at_once: int = 8) -> Iterator[tuple[int, np.ndarray]]:
    """Of each fingerprint the later ones of other labels (and, if there are two, of the
    other side) whose sets' sizes allow the similarity and in which no more bits differ
    than a pair of it may have: within five standard deviations in two words, and six in
    all words. The caller may merge labels on the way."""
    share = differing(percent)
    deviation = math.sqrt(share * (1 - share))
    bits = WORDS * 64
    within, radius = 128 * share + 5 * math.sqrt(128) * deviation, bits * share + 6 * math.sqrt(bits) * deviation
    n, two = len(prints), (side != side[0]).any()
    width = n + -n % 8
    pair = [np.zeros(width, np.uint64) for _ in range(2)]
    pair[0][:n], pair[1][:n] = prints[:, word], prints[:, (word + 1) % WORDS]
    room, counts = np.empty(at_once * width, np.uint64), np.empty((2, at_once * width), np.uint8)
    for a in range(0, n, at_once):
        left, last = a - a % 8, min(a + at_once, n)
        shape, cells = (last - a, width - left), (last - a) * (width - left)
        for x, count in zip(pair, counts, strict=True):
            both = np.bitwise_xor(x[a:last, None], x[None, left:], out=room[:cells].reshape(shape))
            np.bitwise_count(both, out=count[:cells].reshape(shape))
        total = np.add(counts[0, :cells], counts[1, :cells], out=counts[0, :cells])
        near = total <= np.uint8(within)
        # few are near: eight are looked at together first
        at = np.flatnonzero(near.view(np.uint64))
        row, place = np.nonzero(near.reshape(-1, 8)[at])
        i, j = np.divmod(at[row] * 8 + place, width - left)
        i, j = i + a, j + left
        ok = (i < j) & (j < n)
        i, j = i[ok], j[ok]
        ok = (label[i] != label[j]) & (np.minimum(size[i], size[j]) * 100 >= np.maximum(size[i], size[j]) * percent)
        if two:
            ok &= side[i] != side[j]
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(prints[i] ^ prints[j]).sum(1, dtype=np.int64) <= radius
        i, j = i[ok], j[ok]
        if len(i):
            starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            for k, found in zip(i[starts].tolist(), np.split(j, starts[1:]), strict=True):
                found = found[label[found] != label[k]]
                if len(found):
                    yield k, found


def merged(label: np.ndarray, k: int, near: np.ndarray) -> np.ndarray:
    """Gives k and those near it one label; one of near for each label that this joins
    to k's."""
    names, first = np.unique(label[near], return_index=True)
    other = names != label[k]
    names, first = names[other], first[other]
    if len(names):
        all_ = np.append(names, label[k])
        label[np.isin(label, all_)] = all_.min()
    return near[first]


def by_key(make) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by their first three columns, of numbers, to what make gives for the
    table of each of these keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                name = tuple(keys[a].tolist())
                if name != now and held:
                    yield make(pa.Table.from_batches(held))
                    held = []
                now = name
                held.append(batch.slice(a, b - a))
        if held:
            yield make(pa.Table.from_batches(held))

    return run


def in_parts(rows: DataFrame, key: str, parts: DataFrame, count: int) -> DataFrame:
    """Rows of key, row and more, in so many partitions, as blocks (key, i, j) with a
    column side, sorted by key, i, j and row. Stored parts names the large keys and into
    how many parts they go: a block has one of them, or two, each to be compared with the
    other."""
    rest = [c for c in rows.columns if c != key]
    sized = rows.join(broadcast_if_small(parts), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    sided = sized.withColumn("side", F.pmod(F.xxhash64("row"), F.col("parts")))
    blocks = sided.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    blocks = blocks.select(key, F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", *rest)
    return blocks.repartition(count, key, "i", "j").sortWithinPartitions(key, "i", "j", "row")


def columns_of(block: pa.Table) -> tuple[np.ndarray, ...]:
    """row, side, size and print of a block."""
    prints = np.frombuffer(b"".join(block.column("print").to_pylist()), np.uint64).reshape(-1, WORDS)
    return *(block.column(c).to_numpy() for c in ("row", "side", "size")), prints


def _compared(percent: int, masks: np.ndarray):
    """A block of rows (key, i, j, side, row, size, print) to pairs (a, b, later), each in
    the first table that has it. A row that more than FEW are near to isn't told with
    them: pairs marked later connect it to them, as few as do."""

    def pairs(block: pa.Table) -> pa.RecordBatch:
        row, side, size, prints = columns_of(block)
        table = block.column("key")[0].as_py() >> 40
        part = np.arange(len(row))
        a, b, later_ = [], [], []
        for k, near in later(prints, size, part, side, table % WORDS, percent):
            if table:
                near = near[((prints[near] ^ prints[k])[:, None] & masks[:table]).any(axis=2).all(axis=1)]
            waits = len(near) > FEW
            near = merged(part, k, near) if waits else near
            a += [k] * len(near)
            b += near.tolist()
            later_ += [waits] * len(near)
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.RecordBatch.from_pydict({"a": row[a], "b": row[b], "later": pa.array(later_, pa.bool_())})

    return by_key(pairs)


def near_pairs(prints: DataFrame, percent: int, n: int, region: int = 16_384) -> DataFrame:
    """row, print (as bytes), size (of its set) to pairs (a, b, later) that may have the
    similarity, by the tables for n rows. Pairs marked later stand for more: every pair
    that isn't told is of two rows that they connect. There are at most FEW + 1 pairs a
    row and key."""
    tables = sampled_tables(n, percent, region)
    weights = 1 << np.arange(tables.shape[1], dtype=np.int64)
    masks = np.zeros((len(tables), WORDS * 64), np.uint8)
    for t, at in enumerate(tables):
        masks[t, at] = 1
    masks = np.packbits(masks, axis=1).view(np.uint64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                bits = np.unpackbits(raw, axis=1)
                for t, at in enumerate(tables):
                    key = pa.array((t << 40) + bits[:, at].astype(np.int64) @ weights)
                    yield pa.RecordBatch.from_arrays([key, *batch.columns], ["key", "row", "size", "print"])

    dealt = prints.select("row", "size", "print").mapInArrow(keys, "key long, row long, size long, print binary")
    # a key's rows in parts of a region or less; at most so many keys as regions
    parts = stored(dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 2 * region).select("key", F.ceil(F.col("n") / region).alias("parts")), "large")
    blocks = in_parts(dealt, "key", parts, max(spread(prints), min(10_000, len(tables) << tables.shape[1] >> 1)))
    return blocks.mapInArrow(_compared(percent, masks), "a long, b long, later boolean")
