"""Language ID by language-bitmask n-gram filters.

A bit-sliced Bloom filter: one array of masks, a bit per language. A look-up
ANDs the masks at an n-gram's hash positions and so returns all languages that
contain it, in one go. A text's popcount per language is corrected for that
language's false positives, which its share of set bits tells; the highest
corrected share decides.

Learning reads a bounded sample of labelled rows (``sample_docs`` per language
in expectation, whole texts, chosen by a hash of the id), counts n-grams where
they lie and gathers at most ``grams`` per language. Prediction sees the text
alone.

Defined results: a text that is null or has no letter is ``und`` with score 0;
one of whose n-grams no language has any is given the most common language
with score 0; ties go to the language that sorts first; rows with equal or
null ids are judged apart (a null id is never learned from); without labelled
rows all is ``und``. There may be any number of languages: a mask has a 64-bit
word for every 64 of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, in_sample, stored, tidy

UNKNOWN = "und"
#: Odd multipliers of the n-gram hash and of the filter's two positions.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
SPOTS = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)

#: Languages that one mask word has room for; more take several words.
WIDTH = 64

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def code_points(text: str) -> np.ndarray:
    """Lowered code points between two spaces, all but letters as spaces."""
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(letters()[cp], cp, np.uint32(32))


def grams(cp: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams that hold no two spaces in a row."""
    if len(cp) < n:
        return np.zeros(0, np.uint64)
    h = np.full(len(cp) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ cp[k : len(cp) - n + 1 + k]) * MIX[k]
        h ^= h >> np.uint64(29)
    space = cp == 32
    gap = space[:-1] & space[1:]
    bad = np.zeros(len(h), bool)
    for k in range(n - 1):
        bad |= gap[k : k + len(h)]
    return h[~bad]


@dataclass
class Filters:
    """The filter: masks by position, and what reading it needs."""

    languages: list[str]
    masks: np.ndarray  # a row for each mask word
    false: np.ndarray  # a language's rate of false positives
    common: int
    sizes: tuple[int, ...]

    @staticmethod
    def spots(h: np.ndarray, bits: int) -> list[np.ndarray]:
        shift = np.uint64(64 - bits)
        return [(h * m) >> shift for m in SPOTS]

    @classmethod
    def build(cls, languages: list[str], found: dict[int, np.ndarray], common: int, sizes: tuple[int, ...]) -> Filters:
        """found: the n-gram hashes of each language, by number."""
        n = max([1, *(len(x) for x in found.values())])
        bits = int(np.ceil(np.log2(max(1 << 12, 16 * n))))
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        masks = np.zeros((-(-max(1, len(languages)) // WIDTH), 1 << bits), kind)
        for k, h in found.items():
            for at in cls.spots(h.astype(np.uint64), bits):
                masks[k // WIDTH, at] |= kind(1 << k % WIDTH)
        fill = np.array([np.mean((masks[k // WIDTH] >> kind(k % WIDTH)) & kind(1)) for k in range(len(languages))])
        return cls(languages, masks, fill ** len(SPOTS), common, sizes)

    def languages_of(self, h: np.ndarray) -> np.ndarray:
        """All languages that contain each n-gram, as bits: a row for each mask word."""
        a, b = self.spots(h, int(np.log2(self.masks.shape[1])))
        return self.masks[:, a] & self.masks[:, b]

    def shares(self, text: str) -> tuple[np.ndarray, int]:
        """Corrected share of a text's n-grams that each language has, and their number."""
        cp = code_points(text)
        kind = self.masks.dtype.type
        hits, n = np.zeros(len(self.languages)), 0
        for size in self.sizes:
            h = grams(cp, size)
            mask = self.languages_of(h)
            n += len(h)
            if kind is np.uint8:
                table = np.bincount(mask[0], minlength=256)
                hits += [table[np.arange(256) >> k & 1 == 1].sum() for k in range(len(self.languages))]
            else:
                hits += [np.count_nonzero(mask[k // WIDTH] >> kind(k % WIDTH) & kind(1)) for k in range(len(self.languages))]
        if not n:
            return np.zeros(len(self.languages)), 0
        return np.clip((hits / n - self.false) / (1 - self.false), 0, 1), n

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, its part of all languages' shares, and its share."""
        if not text or not self.languages:
            return UNKNOWN, 0.0, 0.0
        share, n = self.shares(text)
        if not n:
            return UNKNOWN, 0.0, 0.0
        best = int(share.argmax())
        if share[best] <= 0:
            return self.languages[self.common], 0.0, 0.0
        return self.languages[best], float(share[best] / share.sum()), float(share[best])


def learn(labelled: DataFrame, sizes: tuple[int, ...] = (2, 3, 4), sample_docs: int = 1500, top: int = 30_000, least: int = 3, ratio: float = 0.2) -> Filters:
    """Filters from doc_id, text, lang (rows to learn from only). A language has an
    n-gram if it occurs ``least`` times in its sample, and relatively at least
    ``ratio`` times as often as in any other; of these it keeps the ``top``."""
    rows = labelled.where("lang is not null and text is not null and doc_id is not null")
    counts = {x.lang: x.n for x in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Filters([], np.zeros((1, 1 << 12), np.uint8), np.zeros(0), 0, sizes)
    languages = sorted(counts)
    number = {x: k for k, x in enumerate(languages)}
    # one row a language
    sample = rows.join(F.broadcast(rows.groupBy("lang").agg(F.count("*").alias("_of"))), "lang").where(in_sample(F.col("doc_id"), sample_docs, F.col("_of")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            by: dict[int, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cp = code_points(text)
                by.setdefault(number[lang], []).extend(grams(cp, n) for n in sizes)
            for k, parts in by.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array(np.full(len(h), k, np.int32)), "h": pa.array(h.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    each = sample.select("text", "lang").mapInArrow(count, "lang int, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    totals = each.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = each.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))  # one row a language
    peak = rated.groupBy("h").agg(F.max("rate").alias("peak"))
    held = stored(rated.where(F.col("n") >= least).join(peak, "h").where(F.col("rate") >= ratio * F.col("peak")).select("lang", "h", "n"), "grams")
    # the count from which on a language keeps all, by a histogram of counts and not by
    # sorting a language in one place; of those with the next lower count, as many as
    # there is room for in expectation, by a hash
    cuts, room = {}, {}
    for x in sorted(held.groupBy("lang", "n").agg(F.count("*").alias("of")).collect(), key=lambda x: (x.lang, -x.n)):
        left = room.setdefault(x.lang, top)
        if left > 0:
            cuts[x.lang] = (x.lang, x.n, left, x.of)
        room[x.lang] = left - x.of
    kept = held.join(F.broadcast(rows.sparkSession.createDataFrame(list(cuts.values()), "lang int, cut long, most long, of long")), "lang")
    kept = kept.where((F.col("n") > F.col("cut")) | ((F.col("n") == F.col("cut")) & in_sample(F.col("h"), F.col("most"), F.col("of"))))
    got = kept.select("lang", "h").toArrow()
    lang, h = got.column(0).to_numpy(), got.column(1).to_numpy().view(np.uint64)
    found = {k: h[lang == k] for k in range(len(languages))}
    return Filters.build(languages, found, number[min(counts, key=lambda x: (-counts[x], x))], sizes)


def identified(docs: DataFrame, filters: Filters, own: tuple[str, ...] = ("_lang_pred", "_score", "_coverage")) -> DataFrame:
    """All columns of docs, then under the names in own the language, its score and its
    coverage (the share of n-grams that the language has)."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # masks for at most top n-grams a language
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        filters = shared.value
        for batch in batches:
            found = [filters.predict(t) for t in batch.column(names.index("text")).to_pylist()]
            cols = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.float64()), strict=True))], [*names, *own])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType(list(docs.schema.fields))
    for name, kind in zip(own, (StringType(), DoubleType(), DoubleType()), strict=True):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def with_language(docs: DataFrame, filters: Filters, least_coverage: float = 0.2) -> DataFrame:
    """The documents that have letters and of whose n-grams some language has at
    least least_coverage; all columns are kept. With nothing learned all documents stay."""
    if not filters.languages:
        return docs
    own = fresh(docs.columns, "_lang_pred", "_score", "_coverage")
    out = identified(docs, filters, own)
    return out.where((F.col(own[0]) != UNKNOWN) & (F.col(own[2]) >= least_coverage)).select(*docs.columns)
