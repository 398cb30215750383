"""Benchmark decontamination with a generalised suffix automaton.

The automaton is built over the words of all normalised test items. A training
text streams through it: the state after each word stands for the longest run
of words ending there that some item holds, so its length tells whether a
window of items ends there, and the state which. Runs of words that the
automaton has no transitions for are found first, in whole arrays: only
stretches in which each neighbouring pair occurs in some item are walked.

A window is 8 consecutive words of an item; an item of fewer words is one
window. Items of an automaton are bounded (``words_at_once``); a larger
benchmark is matched in several passes whose results are merged per document.

Defined results: null or empty text has no words and no hits; items without
words match nothing; items of one id count as one, and all without an id as one of
an empty name; an empty benchmark leaves all clean; rows with equal or null ids are kept apart; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored, texts, tidy

#: Bytes to words: A-Z lowered, every other ASCII byte but letters and digits to a space.
WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Automaton:
    """Generalised suffix automaton over word ids, with what each state says about
    windows: ``marks[state]`` are (window length, items) of those that end where the
    state's words do."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = 8):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        whole: list[tuple[object, list[int]]] = []
        pairs = set()
        for name, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in text.translate(WORD).split()]
            pairs.update(zip(words, words[1:], strict=False))
            last = 0
            for w in words:
                last = self._extend(last, w)
            if words:
                whole.append((name, words))
        # the items whose text holds a state's words: each prefix state and its suffixes
        held: list[set] = [set() for _ in self.len]
        short: dict[int, list[int]] = {}
        for k, (_, words) in enumerate(whole):
            s = 0
            for w in words:
                s = self.next[s][w]
                p = s
                while p > 0 and k not in held[p]:
                    held[p].add(k)
                    p = self.link[p]
            if len(words) < window:
                short.setdefault(s, []).append(k)
        self.names = [name for name, _ in whole]
        self.short_lengths = {len(words) for _, words in whole if len(words) < window}
        # per state: windows that end where the state does, longest first
        self.marks: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in self.len]
        for s in range(1, len(self.len)):
            p, found = s, []
            while p > 0:
                if self.len[p] >= window > self.len[self.link[p]]:
                    found.append((window, tuple(sorted(held[p]))))
                if p in short:
                    by: dict[int, list[int]] = {}
                    for k in short[p]:
                        by.setdefault(len(whole[k][1]), []).append(k)
                    found += [(n, tuple(ks)) for n, ks in by.items()]
                p = self.link[p]
            self.marks[s] = sorted(found, reverse=True)
        self.size = len(self.ids) + 1
        self.pairs = np.array(sorted(a * self.size + b for a, b in pairs), np.int64)
        self.shortest = min([window, *self.short_lengths])

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, q, w)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return cur

    def _clone(self, p: int, q: int, w: int) -> int:
        new = len(self.len)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [first, last) of words inside occurrences of windows, merged, and
        the items (by number) whose windows occur."""
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        known = ids > 0
        if not known.any():
            return spans, items
        if len(self.pairs):
            code = ids[:-1] * self.size + ids[1:]
            at = np.searchsorted(self.pairs, code).clip(max=len(self.pairs) - 1)
            joined = known[:-1] & known[1:] & (self.pairs[at] == code)
        else:
            joined = np.zeros(max(0, len(ids) - 1), bool)
        # stretches of known words in which every neighbouring pair is joined
        starts = np.flatnonzero(known & ~np.concatenate([[False], joined]))
        stops = np.flatnonzero(known & ~np.concatenate([joined, [False]])) + 1
        long = stops - starts >= self.shortest
        for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            state, n = 0, 0
            for i, w in enumerate(ids[a:b].tolist(), a):
                while state and w not in self.next[state]:
                    state = self.link[state]
                    n = self.len[state]
                if w in self.next[state]:
                    state, n = self.next[state][w], n + 1
                for size, ks in self.marks[state]:
                    if size <= n:
                        items.update(ks)
                        if spans and spans[-1][1] >= i + 1 - size:
                            while spans and spans[-1][0] > i + 1 - size:
                                spans.pop()
                            if spans and spans[-1][1] >= i + 1 - size:
                                spans[-1] = (spans[-1][0], i + 1)
                            else:
                                spans.append((i + 1 - size, i + 1))
                        else:
                            spans.append((i + 1 - size, i + 1))
        return spans, items


def automata(benchmark: DataFrame, window: int, words_at_once: int) -> list[Automaton]:
    """Items (item_id, text) in automata of bounded size; a benchmark is a stated
    query set, and each automaton holds ``words_at_once`` words at most, one item
    more at the end."""
    out, part, n = [], [], 0
    for x in benchmark.select("item_id", "text").toLocalIterator():
        text = (x.text or "").encode()
        part.append((x.item_id, text))
        n += len(text.translate(WORD).split())
        if n >= words_at_once:
            out.append(Automaton(part, window))
            part, n = [], 0
    return [*out, Automaton(part, window)] if part or not out else out


def _pass(rows: DataFrame, auto: Automaton) -> DataFrame:
    """doc_id, text, row to doc_id, row, n_words, spans, items of one automaton."""
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, row long, n_words long, spans array<struct<first:int,last:int>>, items array<string>"
    shared = rows.sparkSession.sparkContext.broadcast(auto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        for batch in batches:
            out = []
            for text, row in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.translate(WORD).split()
                spans, items = auto.match(words)
                out.append((row, len(words), [{"first": a, "last": b} for a, b in spans], sorted({'' if auto.names[k] is None else str(auto.names[k]) for k in items})))
            rows, n, spans, items = zip(*out, strict=True) if out else ((), (), (), ())
            span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.int64()), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], ["doc_id", "row", "n_words", "spans", "items"])

    return rows.mapInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 8, words_at_once: int = 500_000) -> DataFrame:
    """doc_id, n_words, spans (array of struct first, last: merged ranges of hit
    words), items (sorted ids of the items whose windows occur, as strings)."""
    rows, parts = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), automata(benchmark, window, words_at_once)
    if len(parts) == 1:
        return _pass(rows, parts[0]).drop("row")
    # written once, so that every pass numbers rows the same
    rows = stored(rows, "numbered")
    both = None
    for auto in parts:
        both = _pass(rows, auto) if both is None else both.unionByName(_pass(rows, auto))
    merged = both.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.select("doc_id", "n_words", _union("spans").alias("spans"), "items")


def _union(spans: str) -> F.Column:
    """Merges sorted ranges that touch or overlap."""
    last = lambda acc: F.element_at(acc, -1)
    empty = F.filter(F.col(spans), lambda x: F.lit(False))
    return F.aggregate(
        F.array_sort(spans),
        empty,
        lambda acc, x: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["last"] >= x["first"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["first"].alias("first"), F.greatest(last(acc)["last"], x["last"]).alias("last"))))).otherwise(F.concat(acc, F.array(x))),
    )


def digest(found: DataFrame, least_items: int = 2) -> DataFrame:
    """Counts and the items' digest of matches()."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["last"] - x["first"]).cast("long"))
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_items >= least_items).alias("contaminated"))


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given ranges of words, from the first's first byte to
    the last's last."""
    flat = text.translate(WORD)
    starts, stops, at = [], [], 0
    for w in flat.split():
        at = flat.index(w, at)
        starts.append(at)
        at += len(w)
        stops.append(at)
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : starts[a]])
        done = stops[b - 1]
    return b"".join([*out, text[done:]])


def _cut(batch: pa.RecordBatch, matched: list[list[tuple[int, int]]], max_coverage: float) -> pa.RecordBatch:
    """The rows of a batch without the spans matched in each, or without the row."""
    names, keep, changed = batch.schema.names, [], {}
    for i, (text, spans) in enumerate(zip(texts(batch.column("text")), matched, strict=True)):
        keep.append(not spans or sum(b - a for a, b in spans) <= max_coverage * len(text.translate(WORD).split()))
        if spans and keep[-1]:
            changed[i] = without_spans(text, spans).decode()
    if changed:
        col = batch.column("text").to_pylist()
        for i, x in changed.items():
            col[i] = x
        k = names.index("text")
        batch = batch.set_column(k, batch.schema.field(k), pa.array(col, batch.schema.field(k).type))
        if "n_chars" in names:
            k = names.index("n_chars")
            n = batch.column(k).to_pylist()
            for i, x in changed.items():
                n[i] = len(x)
            batch = batch.set_column(k, batch.schema.field(k), pa.array(n, batch.schema.field(k).type))
    return batch.filter(pa.array(keep, pa.bool_()))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, max_coverage: float = 0.5, words_at_once: int = 500_000) -> DataFrame:
    """The documents with every matched span removed from their text (column n_chars,
    if there is one, follows); a document of which more than max_coverage of the
    words is matched goes whole. All columns are kept in order. Every automaton
    matches the text as it was; spans are merged before any is removed."""
    names, schema, parts = docs.columns, docs.schema, automata(benchmark, window, words_at_once)
    number, spans_of = fresh(names, "_row", "_spans")
    if len(parts) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(parts[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tidy()
            auto = shared.value
            for batch in batches:
                yield _cut(batch, [auto.match(t.translate(WORD).split())[0] for t in texts(batch.column("text"))], max_coverage)

        return docs.mapInArrow(run, schema)
    # written once, so that every pass and the removal number rows the same
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = None
    for auto in parts:
        hits = _pass(numbered.select("doc_id", "text", F.col(number).alias("row")), auto).where("size(spans) > 0").select(F.col("row").alias(number), "spans")
        found = hits if found is None else found.unionByName(hits)
    merged = found.groupBy(number).agg(F.flatten(F.collect_list("spans")).alias("all")).select(number, _union("all").alias(spans_of))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matched = [[(x["first"], x["last"]) for x in xs or ()] for xs in batch.column(spans_of).to_pylist()]
            yield _cut(batch.select(names), matched, max_coverage)

    return numbered.join(merged, number, "left").select(*names, spans_of).mapInArrow(remove, schema)
