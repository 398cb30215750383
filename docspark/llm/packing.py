"""Best-fit packing by swap-based local search.

Lengths are whole numbers up to the capacity, so a corpus of any size is told
by its histogram: at most ``capacity`` counts. The search runs over bins in
classes, a class being the lengths in a bin and how many bins are alike: first
best fit decreasing, then between underfull bins one-for-one, two-for-one
exchanges and moves, each for as many bins as both classes have, that raise
the sum of squared fills until bins empty. Pieces then find their place by
their rank among those of their length, so nothing but the histogram and the
classes reaches the driver, and no piece is compared with another.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, tidy
from .token_store import encoded

Bin = tuple[int, ...]  # lengths, largest first


def best_fit(hist: dict[int, int], capacity: int) -> Counter[Bin]:
    """Best fit decreasing over classes of bins."""
    done: Counter[Bin] = Counter()
    open_: dict[int, Counter[Bin]] = {}  # by room left
    for length in sorted(hist, reverse=True):
        n = hist[length]
        while n:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                # fresh bins: as full of this length as they get
                per = capacity // length
                fresh, n = divmod(n, per)
                new = [((length,) * per, fresh)] if fresh else []
                if n:
                    new.append(((length,) * n, 1))
                    n = 0
                for b, k in new:
                    left = capacity - sum(b)
                    (open_.setdefault(left, Counter()) if left else done)[b] += k
                continue
            b, k = next(iter(open_[room].items()))
            take = min(k, n)
            open_[room][b] -= take
            if not open_[room][b]:
                del open_[room][b]
                if not open_[room]:
                    del open_[room]
            left, grown = room - length, (*b, length)
            (open_.setdefault(left, Counter()) if left else done)[grown] += take
            n -= take
    for bins in open_.values():
        done.update(bins)
    return done


@lru_cache(maxsize=100_000)
def _sums(b: Bin) -> tuple[int, int]:
    """The lengths in a bin, and the sums of two of them, as sets of bits."""
    one = two = 0
    for i, x in enumerate(b):
        one |= 1 << x
        for y in b[i + 1 :]:
            two |= 1 << (x + y)
    return one, two


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def _parts(b: Bin, total: int) -> Bin:
    """One length of a bin, or two, of this total."""
    if total in b:
        return (total,)
    x = next(x for i, x in enumerate(b) if total - x in b[i + 1 :])
    return (x, total - x)


def _exchange(low: Bin, high: Bin, gap: int) -> tuple[Bin, Bin] | None:
    """What low gives and gets so that high grows by the most it can, gap at most;
    a move gives for nothing. One or two lengths go for one or none, or one for two."""
    one, two = _sums(low)
    both, within = one | two, (2 << gap) - 2
    got_one, got_two = _sums(high)
    best = (0, 0)
    for gives, gets in ((both, got_one | 1), (one, got_two)):
        for y in _bits(gets):
            if found := gives >> y & within:
                best = max(best, (found.bit_length() - 1, -y))
                if best[0] == gap:
                    break
    if not best[0]:
        return None
    y = -best[1]
    get = () if not y else (y,) if y in high else _parts(high, y)
    give = y + best[0]
    return ((give,) if give in low or len(get) == 2 else _parts(low, give)), get


def _without(b: Bin, out: Bin, into: Bin) -> Bin:
    rest = list(b)
    for x in out:
        rest.remove(x)
    return tuple(sorted([*rest, *into], reverse=True))


class _Search:
    """Underfull and full bins in classes, and the exchanges between them."""

    def __init__(self, bins: Counter[Bin], capacity: int):
        self.capacity = capacity
        self.under = Counter({b: k for b, k in bins.items() if sum(b) < capacity})
        self.full: Counter[Bin] = Counter()
        self.total, self.pairs = sum(bins.values()), {}
        for b, k in bins.items():
            if sum(b) == capacity:
                self._add(b, k)

    def _add(self, b: Bin, k: int) -> None:
        if not b:
            self.total -= k
        elif sum(b) < self.capacity:
            self.under[b] += k
        else:
            self.full[b] += k
            for two in _bits(_sums(b)[1]):
                self.pairs[two] = b  # a full bin with two lengths of this total

    def _take(self, b: Bin, k: int) -> None:
        held = self.under if b in self.under else self.full
        held[b] -= k
        if not held[b]:
            del held[b]

    def _swap(self, a: Bin, b: Bin, give: Bin, get: Bin) -> list[Bin]:
        """Exchanges between as many bins of both classes as there are; the new classes."""
        k = self.under[a] // 2 if a == b else min(self.under[a], self.under[b] or self.full[b])
        self._take(a, k)
        self._take(b, k)
        new = [_without(a, give, get), _without(b, get, give)]
        for x in new:
            self._add(x, k)
        return new

    def raise_fills(self, queue: list[Bin], least: int) -> None:
        """Exchanges until none raises the squared fills. queue: classes that haven't
        been tried with all others; of two the emptier gives."""
        order = lambda b: (-sum(b), -len(b), b)
        queue = sorted(queue, key=order)
        while queue and self.total > least:
            b = queue.pop()  # the emptiest
            if b not in self.under:
                continue
            for other in sorted(self.under, key=order):
                low, high = (b, other) if sum(b) <= sum(other) else (other, b)
                if low == high and self.under[b] < 2:
                    continue
                if found := _exchange(low, high, self.capacity - sum(high)):
                    for x in (*self._swap(low, high, *found), b):
                        if x in self.under and x not in queue:
                            insort(queue, x, key=order)
                    break

    def refine(self, seen: set[tuple[Bin, int]]) -> list[Bin]:
        """Swaps a length of an underfull bin, the emptiest first, for two of a full one
        that make the same: no fill changes, but the underfull bin has finer parts."""
        for low in sorted(self.under, key=lambda b: (sum(b), len(b), b)):
            for x in low:
                high = self.pairs.get(x)
                if high in self.full and (low, x) not in seen:
                    seen.add((low, x))
                    return [y for y in self._swap(low, high, (x,), _parts(high, x)) if y in self.under]
        return []


def local_search(bins: Counter[Bin], capacity: int) -> Counter[Bin]:
    """Exchanges between underfull bins until none raises the sum of squared fills or
    the bins are as few as their content allows. Where none is left, an underfull bin
    gets finer parts from a full one. Every step raises the squared fills, or leaves
    them and raises the number of parts in underfull bins: the search ends by itself."""
    least = -(-sum(sum(b) * k for b, k in bins.items()) // capacity)
    search, seen = _Search(bins, capacity), set()
    queue = list(search.under)
    while queue and search.total > least:
        search.raise_fills(queue, least)
        queue = search.refine(seen)
    return search.full + search.under


def plan(hist: dict[int, int], capacity: int) -> list[tuple[Bin, int]]:
    """Bins for a histogram of lengths 1..capacity, as (lengths, how many)."""
    if any(not 0 < x <= capacity for x in hist):
        raise ValueError("a length is not within 1 and the capacity")
    return sorted(local_search(best_fit(hist, capacity), capacity).items(), reverse=True)


def places(bins: list[tuple[Bin, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence, pieces of this length in a bin, index
    of its first offset, of each class in turn, and all offsets."""
    out: dict[int, list] = {}
    first = 0
    for b, k in bins:
        at, offsets = 0, {}
        for x in b:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, where in offsets.items():
            rows = out.setdefault(x, [0, [], [], [], [], []])
            rows[1].append(rows[0])
            rows[2].append(first)
            rows[3].append(len(where))
            rows[4].append(len(rows[5]))
            rows[5] += where
            rows[0] += k * len(where)
        first += k
    return {x: tuple(np.asarray(r, np.int64) for r in rows[1:]) for x, rows in out.items()}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, with_ids: bool = False, group: int = 1_500_000) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, part
    and rank (its place among pieces of its length in its partition), with with_ids
    also the ids. group: characters that are encoded together, which bears on memory
    and speed alone. A document longer than the capacity is cut into pieces of just the
    capacity, the first being what is left over.

    Null or empty text: the end id alone. Rows with equal or null ids are each
    packed. Ids may be of any type. An empty table has no pieces."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tidy(words=True)
        part, seen, rows = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), []
        for doc_id, raw in encoded(batches, tokenizer, group):
            n = len(raw) // 4
            at, k = 0, 0
            while at < n:
                size = (n % capacity or capacity) if k == 0 else capacity
                ids = raw[4 * at : 4 * (at + size)]
                rows.append((doc_id, k, at, size, zlib.crc32(ids), part, int(seen[size]), *([ids] if with_ids else [])))
                seen[size] += 1
                at, k = at + size, k + 1
            if len(rows) >= (500 if with_ids else 10_000):
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"]
    kinds = [id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names[: 7 + with_ids])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (length, part, rank). Ranks of a
    length count on from partition to partition; a length that all pieces share is
    no hot key, as it is counted per partition first."""
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).select("length", "part", "before")
    hist = {int(x.length): int(x.n) for x in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = places(plan(hist, capacity))
    fields = list(cut.columns)
    kinds = dict(cut.dtypes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            rank = rank + batch.column("before").to_numpy(zero_copy_only=False)
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                first, base, per, at, offsets = table[int(x)]
                mine = length == x
                r = rank[mine]
                k = np.searchsorted(first, r, "right") - 1
                r = r - first[k]
                seq[mine] = base[k] + r // per[k]
                offset[mine] = offsets[at[k] + r % per[k]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), pa.array(seq), pa.array(offset)], [*fields, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in fields) + ", sequence_id long, offset long"
    return cut.join(before, ["length", "part"]).select(*fields, "before").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, with_ids: bool = False, group: int = 1_500_000) -> DataFrame:
    """pieces() and pack(): every piece with its sequence_id, its offset there and,
    with with_ids, its ids."""
    return pack(stored(pieces(docs, tokenizer, capacity, with_ids, group), "pieces"), capacity).drop("part", "rank")
