"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Examples lie in an inverted index whose postings are cut into blocks of
examples; for each term and block the index keeps the highest weight. A text's
bound on a block is the product of its weights with those, blocks are visited
by falling bound, and the search ends when no bound can beat the k-th best: the
neighbours are exactly those of a full scan. Votes are weighted by distance;
the score is the calibrated probability that the label is 1, and the
neighbours are the evidence.

Learning: a bounded sample of labelled rows (``examples`` per class in
expectation, whole texts, chosen by a hash of the id). Terms are lowered words
and beginnings of words that one class uses at least ``lift`` times as often as
the other, with a z-score of ``z``: with more terms the nearest examples are those
of like language and subject, whatever their label (README). A text in which no
such term occurs has no neighbours, and its score is the calibrated one of
examples without neighbours. Calibration:
votes of each example over the others, isotonic, weighted to the classes' real
shares.

Defined results: null and empty texts have no neighbours; ties among
neighbours go to the smaller id; several labels of an id count as their
highest, of several texts of an id the least is learned from; null labels and ids are not learned from; without labelled rows every
score is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_sample, texts
from .decontaminate import WORD

BLOCK = 64
#: Bytes of the word beginnings that are terms beside whole words.
STEMS = (5, 6, 7, 8)


def terms_of(text: bytes) -> list[bytes]:
    """Lowered words and, marked by a caret, the beginnings of longer ones: what
    marks a class may be a stem with many endings."""
    words = text.translate(WORD).split()
    out = list(words)
    for k in STEMS:
        out += [w[:k] + b"^" for w in words if len(w) > k]
    return out


@dataclass
class Index:
    """Block-max inverted index over examples, ordered so that like ones share a block."""

    terms: dict[bytes, int]
    idf: np.ndarray
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    k: int = 15
    steps: tuple[np.ndarray, np.ndarray] = ((), ())  # calibration: votes and scores
    alone: float = 0.0  # score without neighbours

    def vector(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Terms and TF-IDF weights of unit length."""
        n = Counter(filter(None, map(self.terms.get, terms_of(text))))
        t = np.fromiter(sorted(n), np.int64, len(n))
        return t, self.weights(t, np.fromiter((n[x] for x in sorted(n)), float, len(n)))

    def weights(self, t: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (1 + np.log(n)) * self.idf[t]
        return w / np.sqrt((w * w).sum()) if len(w) else w

    def fill(self, examples: list[tuple[int, int, np.ndarray, np.ndarray]]) -> None:
        """examples: id, label, terms, weights; those without terms are left out."""
        rows = [x for x in examples if len(x[2])]
        rows.sort(key=lambda x: (int(x[2][x[3].argmax()]), x[1], x[0]))
        self.ids = np.array([x[0] for x in rows], np.int64)
        self.labels = np.array([x[1] for x in rows], np.int64)
        blocks = -(-len(rows) // BLOCK)
        self.most = np.zeros((len(self.terms) + 1, max(1, blocks)))
        at: dict[tuple[int, int], list] = {}
        for i, (_, _, t, w) in enumerate(rows):
            b = i // BLOCK
            self.most[t, b] = np.maximum(self.most[t, b], w)
            for x, y in zip(t.tolist(), w.tolist(), strict=True):
                at.setdefault((x, b), []).append((i - b * BLOCK, y))
        self.postings = {key: (np.array([i for i, _ in v]), np.array([y for _, y in v])) for key, v in at.items()}

    def nearest(self, t: np.ndarray, w: np.ndarray, but: int = -1) -> list[tuple[float, int]]:
        """The k examples of highest cosine above 0, as (cosine, number)."""
        if not len(t) or not len(self.ids):
            return []
        bound = w @ self.most[t]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(best) == self.k and bound[b] < best[-1][0] - 1e-12):
                break
            sim = np.zeros(min(BLOCK, len(self.ids) - b * BLOCK))
            for x, y in zip(t.tolist(), w.tolist(), strict=True):
                if (x, b) in self.postings:
                    i, v = self.postings[x, b]
                    sim[i] += y * v
            found = [(s, b * BLOCK + i) for i, s in enumerate(sim.tolist()) if s > 0 and b * BLOCK + i != but]
            best = sorted(best + found, key=lambda x: (-x[0], self.ids[x[1]]))[: self.k]
        return best

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of label 1, each neighbour weighted by the inverse of its distance."""
        w = np.array([1 / (1.05 - s) for s, _ in near])
        return float(w @ self.labels[[i for _, i in near]] / w.sum())

    def calibrate(self, examples: list[tuple[int, int, np.ndarray, np.ndarray]], weight: tuple[float, float]) -> None:
        own = {int(x): i for i, x in enumerate(self.ids)}
        votes, without = [], [1e-9, 0.0]
        for doc, y, t, w in examples:
            near = self.nearest(t, w, own.get(doc, -1))
            if near:
                votes.append((self.vote(near), y, weight[y]))
            else:
                without[0] += weight[y]
                without[1] += weight[y] * y
        self.alone = without[1] / without[0]
        # pool adjacent violators, with a weak prior so that no step is 0 or 1
        pools: list[list[float]] = []
        for v, y, c in sorted(votes):
            pools.append([v, c * y, c])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                _, a, b = pools.pop()
                pools[-1] = [pools[-1][0], pools[-1][1] + a, pools[-1][2] + b]
        self.steps = (np.array([p[0] for p in pools]), np.array([(p[1] + 0.01) / (p[2] + 0.02) for p in pools]))

    def score(self, text: bytes, seen: dict) -> tuple[float, list[int]]:
        t, w = self.vector(text)
        key = (t.tobytes(), w.tobytes())
        if key not in seen:
            near = self.nearest(t, w)
            if near and len(self.steps[0]):
                at = int(np.searchsorted(self.steps[0], self.vote(near), "right")) - 1
                seen[key] = float(self.steps[1][max(0, at)]), [int(self.ids[i]) for _, i in near]
            else:
                seen[key] = float(self.alone), []
        return seen[key]


def learn(docs: DataFrame, labels: DataFrame, examples: int = 2000, lift: float = 3.0, z: float = 7.0, k: int = 15) -> Index:
    """An index from doc_id, text and doc_id, toxic (rows to learn from only)."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    counts = {x.y: x.n for x in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = [counts.get(0, 0), counts.get(1, 0)]
    if not all(total):
        return Index({}, np.zeros(0))
    chosen = known.where(in_sample(F.col("doc_id"), examples, F.when(F.col("y") == 1, total[1]).otherwise(total[0])))
    # 2 * examples rows of an id and a class in expectation; of an id that several rows
    # have, the least text is the example, so the sample stays bounded
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: list[Counter] = [Counter(), Counter()]
            for text, y in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                n[y].update({None, *terms_of(text)})
            for y in (0, 1):
                yield pa.RecordBatch.from_pydict({"term": pa.array(list(n[y]), pa.binary()), "n0": pa.array([x * (1 - y) for x in n[y].values()], pa.int64()), "n1": pa.array([x * y for x in n[y].values()], pa.int64())})

    df = sample.select("text", "y").mapInArrow(presence, "term binary, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    size = df.where("term is null").first()  # rows of each class
    n0, n1 = max(1, size.n0), max(1, size.n1)
    p0, p1 = F.col("n0") / n0, F.col("n1") / n1
    both = (F.col("n0") + F.col("n1")) / (n0 + n1)
    score = F.abs(p1 - p0) / F.sqrt(both * (1 - both) * (1 / n0 + 1 / n1))
    bounds = (F.greatest(p0, p1) >= lift * F.least(p0, p1)) & (both < 1) & (score >= z)
    top = df.where("term is not null").where(bounds).collect()  # terms of the examples, so bounded by them
    found = sorted(top, key=lambda x: bytes(x.term))
    idf = np.array([0.0, *(np.log((1 + n0 + n1) / (1 + x.n0 + x.n1)) + 1 for x in found)])  # numbers start at 1
    index = Index({bytes(x.term): i for i, x in enumerate(found, 1)}, idf, k=k)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [index.vector(t) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([t.tolist() for t, _ in rows], pa.list_(pa.int64())), pa.array([w.tolist() for _, w in rows], pa.list_(pa.float64()))], ["doc_id", "y", "t", "w"])

    got = sample.select(F.col("doc_id").cast("long"), "text", "y").mapInArrow(vectors, "doc_id long, y int, t array<long>, w array<double>").collect()
    rows = sorted(((x.doc_id, x.y, np.array(x.t, np.int64), np.array(x.w)) for x in got), key=lambda x: (x[0], x[3].tobytes()))
    index.fill(rows)
    index.calibrate(rows, (total[0] / n0, total[1] / n1))
    return index


def scored(docs: DataFrame, index: Index, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted and neighbours (ids of the nearest examples, nearest
    first) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by examples and terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seen = shared.value, {}
        for batch in batches:
            if len(seen) > 50_000:
                seen.clear()
            found = [index.score(t, seen) for t in texts(batch.column(1))]
            s = [x for x, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32()), pa.array([n for _, n in found], pa.list_(pa.int64()))], ["doc_id", "score", "predicted", "neighbours"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int, neighbours array<long>")
