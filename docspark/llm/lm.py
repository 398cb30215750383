"""LM scoring by a log-bilinear neural model, trained in numpy with
noise-contrastive estimation.

A word's context vector is the sum of the vectors of the words before it, each
scaled by the weights of its position; its product with an output's vector,
and a bias, is the output's score. Outputs are the ``outs`` most frequent words
and classes of all others, the class being told by a word's ending, so that
unseen words have one too; within a class words follow their counts. Outputs are
few, so the softmax is computed whole, as batched matrix products: every token's
probability is normalised.

All that is gathered is of all training texts: the counts of words, combined in
each task before their shuffle by word; the ``hot`` commonest words and the
``ENDINGS`` commonest endings from those counts, which are the model's
vocabulary; and for each ending the common words that stand in texts with it, by
which endings are put into classes. Every token of every training text is
trained on once, where it lies: in each of the ``ROUNDS`` a part of the texts,
told by a hash of the row, goes through every partition's copy of the model, and
the parameters' mean, weighted by tokens, starts the next round.

Defined results: a null text is empty, its one token the end; without training
texts the counts are zero; rows with equal or null ids are scored apart, and a
null id is not learned from; other columns are ignored; ids may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, stored, tidied

END = b"\n"
MARKS = b".,;:!?"
ORDER = 3
#: Endings that tell a word's class; words with another ending share one more.
ENDINGS = 4096
#: Common words whose presence beside an ending tells endings apart.
COMMON = 128
#: Training texts of each round, in sixteenths of all, its learning rate and batch.
ROUNDS = ((0, 1, 0.3, 128), (1, 4, 0.2, 256), (4, 16, 0.1, 1024))


def tokens(text: bytes) -> list[bytes]:
    """Lowered words; the end is counted apart."""
    return text.translate(LOWER).split()


def distinct(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What tokens() gives of each text, by Arrow: distinct words, the place of every word
    of the texts among them, and where each text's words begin, and the last one's end. A
    word that no text has may be among the distinct ones, but only the empty one."""
    # copied, as ascii_lower takes wrong bytes from a cast part of a longer column
    own = column.take(pa.array(np.arange(len(column)))).cast(pa.large_string()).fill_null("")
    own = pc.ascii_split_whitespace(pc.ascii_lower(own))
    bounds, coded = own.offsets.to_numpy().astype(np.int64), own.values.dictionary_encode()
    del own
    words, at = coded.dictionary, coded.indices.to_numpy()
    empty = pc.index(words, "").as_py()  # what stands before or after the white space at an edge
    if empty >= 0:
        full = at != empty
        at, bounds = at[full], np.concatenate([[0], np.cumsum(full)])[bounds]
    return words, at, bounds


def pieces(batch: pa.RecordBatch, column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, in order, with about ``size`` bytes of the column's texts at
    once: distinct() takes some ten times as much memory. A longer text is alone."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(ends // size)) + 1
    for i, j in pairwise([0, *cuts.tolist(), len(ends)] if len(ends) else []):
        yield batch.slice(i, j - i)


def bare(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The endings of words, without the marks behind, and whether there are any."""
    short = pc.ascii_rtrim(words, MARKS.decode())
    marked = pc.not_equal(pc.binary_length(short), pc.binary_length(words)).to_numpy(zero_copy_only=False)
    return pc.binary_slice(short.cast(pa.large_binary()), -3), marked


@dataclass
class Vocabulary:
    """hot: words by number, the end being 0. A word beyond them has the code
    len(hot) + twice the number of its ending, and one more with a mark behind it."""

    hot: dict[bytes, int]
    endings: dict[bytes, int]
    outs: int = 196
    ins: int = 8192

    @property
    def codes(self) -> int:
        return len(self.hot) + 2 * (len(self.endings) + 1)

    def ending(self, word: bytes) -> int:
        bare = word.rstrip(MARKS)
        return 2 * self.endings.get(bare[-3:], len(self.endings)) + (len(bare) < len(word))

    def endings_of(self) -> np.ndarray:
        """The ending, twice its number and the mark, of each code."""
        n = len(self.hot)
        out = np.arange(self.codes) - n
        for w, k in self.hot.items():
            out[k] = self.ending(w)
        return out

    def tables(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input and output number of each code, by the class of each ending."""
        n, ending = len(self.hot), self.endings_of()
        cls = 2 * own[ending // 2] + ending % 2
        code = np.arange(self.codes)
        ins, outs = min(self.ins, n), min(self.outs, n)
        return np.where(code < ins, code, ins + cls), np.where(code < outs, code, outs + cls)


def _kmeans(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Clusters of rows; seeds are the farthest rows in turn, from the heaviest."""
    seeds = [int(weight.argmax())]
    far = ((x - x[seeds[0]]) ** 2).sum(1)
    while len(seeds) < min(k, len(x)):
        seeds.append(int((far * np.sqrt(weight)).argmax()))
        far = np.minimum(far, ((x - x[seeds[-1]]) ** 2).sum(1))
    centre = x[seeds]
    for _ in range(rounds):
        own = ((x * x).sum(1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(1)).argmin(1)
        for c in range(len(centre)):
            mine = own == c
            if mine.any():
                centre[c] = np.average(x[mine], axis=0, weights=weight[mine])
    return own


class Model:
    """Parameters: vectors r of inputs (the last is the place before a text), weights
    w of positions, vectors q and biases b of outputs."""

    names = ("r", "w", "q", "b")

    def __init__(self, ins: int, outs: int, dim: int = 32, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.r = (0.1 * rng.standard_normal((ins + 1, dim))).astype(np.float32)
        self.w = np.repeat(np.array([1.0, 0.6, 0.4], np.float32)[:ORDER, None], dim, 1)
        self.q = (0.1 * rng.standard_normal((outs, dim))).astype(np.float32)
        self.b = np.zeros(outs, np.float32)
        #: Adagrad's sums of squares; for r one to a row.
        self.grown = {n: np.full(getattr(self, n).shape if n != "r" else len(self.r), 1e-3, np.float32) for n in self.names}

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.names])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for n in self.names:
            x = getattr(self, n)
            setattr(self, n, flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return self

    def contexts(self, docs: list[np.ndarray]) -> np.ndarray:
        """For each token of each text the ORDER inputs before it, nearest first."""
        start = np.full(ORDER, len(self.r) - 1)
        parts = []
        for x in docs:
            padded = np.concatenate([start, x])
            parts.append(np.stack([padded[ORDER - k : ORDER - k + len(x)] for k in range(1, ORDER + 1)], 1))
        return np.concatenate(parts)

    def train(self, x: np.ndarray, y: np.ndarray, noise: np.ndarray, rate: float, rng: np.random.Generator, k: int = 32, batch: int = 1024) -> None:
        """Noise-contrastive estimation with Adagrad: the noise words of a batch are k
        draws that its examples share."""
        grown, dim = self.grown, self.r.shape[1]
        shift = np.log(k * noise + 1e-20).astype(np.float32)
        for i in range(0, len(y), batch):
            xs, ys = x[i : i + batch], y[i : i + batch]
            vecs = self.r.take(xs, axis=0)
            ctx = np.einsum("bod,od->bd", vecs, self.w)
            drawn = rng.multinomial(k, noise)
            at = np.flatnonzero(drawn)
            q, qy, scale = self.q[at], self.q.take(ys, axis=0), np.float32(1 / np.sqrt(len(ys)))
            # how likely each noise word, and each word that stands there, is data and not noise
            g = _likely(ctx @ q.T + (self.b[at] - shift[at])) * (drawn[at] * scale).astype(np.float32)
            own = (_likely(np.einsum("bd,bd->b", ctx, qy) + self.b[ys] - shift[ys]) - 1) * scale
            dctx = g @ q + own[:, None] * qy
            dq, db = np.zeros_like(self.q), np.bincount(ys, own, minlength=len(self.b)).astype(np.float32)
            rows, sums = _by_row(ys, own[:, None] * ctx)
            dq[rows] = sums
            dq[at] += g.T @ ctx
            db[at] += g.sum(0)
            dw = np.einsum("bd,bod->od", dctx, vecs)
            rows, dr = _by_row(xs.ravel(), (dctx[:, None, :] * self.w).reshape(-1, dim))
            grown["r"][rows] += (dr * dr).mean(1)
            self.r[rows] -= rate * dr / np.sqrt(grown["r"][rows])[:, None]
            for n, d, step in (("w", dw, 0.1 * rate), ("q", dq, rate), ("b", db, rate)):
                grown[n] += d * d
                getattr(self, n).__isub__(step * d / np.sqrt(grown[n]))

    def log10(self, x: np.ndarray, y: np.ndarray, batch: int = 512) -> np.ndarray:
        """Normalised log10 probabilities of outputs y after contexts x."""
        # the bias is one more dimension, in which contexts are 1
        tables = [np.pad(self.r * self.w[j], ((0, 0), (0, 1)), constant_values=float(j == 0)) for j in range(ORDER)]
        q = np.concatenate([self.q, self.b[:, None]], 1).T.copy()
        ones, out = np.ones(q.shape[1], np.float32), np.empty(len(y))
        for i in range(0, len(y), batch):
            xs, ys = x[i : i + batch], y[i : i + batch]
            ctx = tables[0][xs[:, 0]]
            for j in range(1, ORDER):
                ctx += tables[j][xs[:, j]]
            s = ctx @ q
            if max(s.max(), -s.min()) > 60:  # beyond, exponentials wouldn't fit
                s -= s.max(1, keepdims=True)
            own = s[np.arange(len(ys)), ys]
            np.exp(s, out=s)
            out[i : i + batch] = own - np.log(s @ ones)
        return out / np.log(10)


def _likely(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _by_row(at: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in at, and the sums of their rows of v."""
    if len(at) and at.max() < 1 << 16:
        at = at.astype(np.uint16)  # numbers of 16 bits are sorted by radix
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first].astype(np.int64), np.add.reduceat(v.take(order, axis=0), first)


def word_counts(train: DataFrame, size: int = 12 << 20) -> DataFrame:
    """word, ending and c, the number of times that it stands in the texts. A task
    combines the counts of about ``size`` bytes of texts at once; it holds the counts of
    their pieces meanwhile, and not the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
            coded = pa.concat_arrays([words for words, _ in held]).dictionary_encode()
            words, c = coded.dictionary, np.zeros(len(coded.dictionary), np.int64)
            np.add.at(c, coded.indices.to_numpy(), np.concatenate([n for _, n in held]))
            return pa.RecordBatch.from_arrays([words.cast(pa.binary()), bare(words)[0].cast(pa.binary()), pa.array(c, pa.int64())], ["word", "ending", "c"])

        held, got = [], 0
        for batch in batches:
            for part in pieces(batch, 0):
                words, at, _ = distinct(part.column(0))
                c = np.bincount(at, minlength=len(words))
                held.append((words.filter(pa.array(c > 0)), c[c > 0]))
                got += part.column(0).nbytes
                if got >= size:
                    yield out(held)
                    held, got = [], 0
        if held:
            yield out(held)

    each = train.select("text").mapInArrow(tidied(count), "word binary, ending binary, c long")
    return each.groupBy("word", "ending").agg(F.sum("c").alias("c"))  # a word has one ending


def vocabulary(counts: DataFrame, hot: int) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary from the counts of all training texts, and its hot words' counts;
    hot words and ENDINGS endings reach the driver. The end's count is left 0."""
    got = counts.orderBy(F.desc("c"), "word").limit(hot - 1).select("word", "c").toArrow()
    ends = counts.groupBy("ending").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "ending").limit(ENDINGS).collect()
    words = {END: 0} | {w: k for k, w in enumerate(got.column(0).to_pylist(), 1)}
    return Vocabulary(words, {bytes(x.ending): k for k, x in enumerate(ends)}), np.concatenate([[0], got.column(1).to_numpy()])


def _summed(rows: DataFrame, parts: int) -> list[np.ndarray]:
    """Rows (part, raw float32 numbers) summed by part: in parts tasks, as a stream."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = np.frombuffer(raw, np.float32)
                total[k] = total[k] + v if k in total else v.astype(np.float64)
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()), "raw": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    schema = "part int, raw binary"
    got = {x.part: np.frombuffer(x.raw, np.float64) for x in rows.repartition(parts, "part").mapInArrow(add, schema).collect()}
    return [got[k] for k in sorted(got)]


def classes(heads: DataFrame, vocab: Vocabulary, groups: int, parts: int = 64) -> np.ndarray:
    """The class of each ending: endings that stand in texts with the same common words
    are one class. heads: codes of all training texts."""
    ending, n = vocab.endings_of() // 2, len(vocab.endings) + 1
    common = min(COMMON, len(vocab.hot))
    shared = heads.sparkSession.sparkContext.broadcast(ending)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z, ending = zstandard.ZstdDecompressor(), shared.value
        total = np.zeros((n, common + 1), np.float32)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                codes = _unpacked(raw, z)
                at, c = np.unique(ending[codes], return_counts=True)
                beside = np.append(np.bincount(codes[codes < common], minlength=common) > 0, True).astype(np.float32)
                total[at] += c[:, None].astype(np.float32) * beside
        if not total.any():
            return
        rows = np.array_split(total.ravel(), parts)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(parts), pa.int32()), "raw": pa.array([x.tobytes() for x in rows], pa.binary())})

    m = _summed(heads.select("codes").mapInArrow(tidied(profile), "part int, raw binary"), parts)
    m = np.concatenate(m).reshape(n, common + 1) if m else np.zeros((n, common + 1))
    own, seen = np.zeros(n, np.int64), m[:, -1] > 0
    if seen.any():
        weight, x = m[seen, -1], m[seen, :-1] / m[seen, -1:]
        # rare endings lean on the mean
        mean = np.average(x, axis=0, weights=weight)
        x = (x * weight[:, None] + 5 * mean) / (weight[:, None] + 5)
        own[seen] = _kmeans(np.sqrt(x), weight, groups)
    return own


def _packed(codes: np.ndarray, z) -> bytes:
    return z.compress(np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(raw: bytes, z) -> np.ndarray:
    x = np.frombuffer(z.decompress(raw), np.uint8)
    return np.ascontiguousarray(x.reshape(4, -1).T).view("<i4").reshape(-1).astype(np.int64)


CODED = "kind int, row long, doc_id {kind}, train boolean, n long, word binary, codes binary"


def coded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """doc_id, text, train to two kinds of rows: 0 a text's codes (n tokens), 1 a word
    beyond the hot ones in a text (n times)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # hot words at most, and endings
    names = ["kind", "row", "doc_id", "train", "n", "word", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        vocab, z = shared.value, zstandard.ZstdCompressor(level=1)
        size, hot, endings = len(vocab.hot), pa.array(vocab.hot, pa.large_binary()), pa.array(vocab.endings, pa.large_binary())
        row = TaskContext.get().partitionId() << 40
        for batch in (part for whole in batches for part in pieces(whole, 1)):
            ids, train, k = batch.column(0), batch.column(2), batch.num_rows
            words, at, bounds = distinct(batch.column(1))
            # the table of hashes is of the batch's words, which are fewer than the hot ones
            found = pc.index_in(hot, value_set=words.cast(pa.large_binary()))
            code = np.full(len(words), -1, np.int64)
            code[found.drop_null().to_numpy()] = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            far = np.flatnonzero(code < 0)
            ending, marked = bare(words.take(pa.array(far)))
            code[far] = size + 2 * pc.index_in(ending, value_set=endings).fill_null(len(endings)).to_numpy() + marked
            each = code[at]
            ends = bounds[1:] + np.arange(k)
            codes, word = np.zeros(len(each) + k, np.int64), np.ones(len(each) + k, bool)
            word[ends] = False
            codes[word] = each
            packed = [_packed(x, z) for x in np.split(codes, ends[:-1] + 1)]
            n = pa.array(np.diff(bounds) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), pa.array(row + np.arange(k)), ids, train, n, pa.nulls(k, pa.binary()), pa.array(packed, pa.binary())], names)
            beyond = np.flatnonzero(each >= size)
            text = np.searchsorted(bounds, beyond, "right") - 1
            pair, times = np.unique(text * len(words) + at[beyond], return_counts=True)
            for i in range(0, len(pair), 100_000):
                text, of = np.divmod(pair[i : i + 100_000], len(words))
                m = len(of)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(row + text), pa.nulls(m, ids.type), train.take(pa.array(text)), pa.array(times[i : i + m]), words.take(pa.array(of)).cast(pa.binary()), pa.nulls(m, pa.binary())], names)
            row += k

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "train").mapInArrow(tidied(run), CODED.format(kind=dict(docs.dtypes)["doc_id"]))


def trained(model: Model, texts_of: DataFrame, ins: np.ndarray, outs: np.ndarray, noise: np.ndarray, rate: float, batch: int, parts: int = 64) -> Model:
    """One round where the texts lie (codes of training texts): each partition starts
    from model and takes every token of its texts; the mean of the parameters, weighted
    by tokens, is the new model."""
    shared, size = texts_of.sparkSession.sparkContext.broadcast((model, ins, outs, noise)), batch

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        model, ins, outs, noise = shared.value
        model, z, n = deepcopy(model), zstandard.ZstdDecompressor(), 0
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            raw = batch.column(0).to_pylist()
            for i in range(0, len(raw), 200):
                codes = [_unpacked(c, z) for c in raw[i : i + 200]]
                x, y = model.contexts([ins[d] for d in codes]), outs[np.concatenate(codes)]
                order = rng.permutation(len(y))
                model.train(x[order], y[order], noise, rate, rng, batch=size)
                n += len(y)
        if n:
            rows = np.array_split(np.append(model.flat() * np.float32(n), np.float32(n)), parts)
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(parts), pa.int32()), "raw": pa.array([x.tobytes() for x in rows], pa.binary())})

    got = _summed(texts_of.select("codes").mapInArrow(tidied(step), "part int, raw binary"), parts)
    if got:
        flat = np.concatenate(got)
        model.load(flat[:-1] / flat[-1])
    return model


def scored(docs: DataFrame, hot: int = 131_072, groups: int = 30, dim: int = 32) -> DataFrame:
    """doc_id, text, train to doc_id, n_tokens, n_known, train_tokens, base_score and
    score of every row; learns from rows whose train is true."""
    docs = docs.select("doc_id", "text", F.coalesce("train", F.lit(False)).alias("train"))
    counts = stored(word_counts(docs.where("train")), "word-counts")
    vocab, c = vocabulary(counts, hot)
    book = stored(coded(docs, vocab), "coded")
    heads = book.where("kind = 0")
    learn = heads.where("train")
    own = classes(learn, vocab, groups)
    ins, outs = vocab.tables(own)
    size, single = len(vocab.hot), min(vocab.outs, len(vocab.hot))

    # counts of all training tokens: words, and one end to each text
    total = counts.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    c[0] = learn.count()
    n_all, v_all = (total.n or 0) + int(c[0]), total.v + (c[0] > 0)
    # of each class, the tokens and distinct words without an output of their own
    n_of, v_of = np.zeros(2 * groups), np.zeros(2 * groups)
    marked = F.length(F.rtrim(F.col("word").cast("string"), F.lit(MARKS.decode()))) < F.length(F.col("word").cast("string"))
    # from Arrow, which starts no Python workers of another kind beside those that the tasks keep
    class_of = pa.table({"ending": pa.array(vocab.endings, pa.binary()), "class": pa.array(own[:-1], pa.int32())})
    by_class = counts.join(F.broadcast(docs.sparkSession.createDataFrame(class_of, "ending binary, class int")), "ending", "left")
    of = 2 * F.coalesce("class", F.lit(int(own[-1]))) + marked.cast("int")
    for x in by_class.groupBy(of.alias("k")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect():
        n_of[x.k], v_of[x.k] = x.n, x.v
    cls = outs - single  # below 0 for words with an output of their own
    ending = vocab.endings_of()
    for k in range(1, single):
        at = 2 * own[ending[k] // 2] + ending[k] % 2
        n_of[at] -= c[k]
        v_of[at] -= 1
    room = np.log10(np.maximum(n_of, 0) + 0.5 * (np.maximum(v_of, 0) + 1))
    seen = np.log10(c + 0.5)
    rest = len(outs) - size
    base = np.concatenate([seen, np.zeros(rest)])
    inner = np.where(cls >= 0, np.concatenate([seen, np.zeros(rest)]) - room[np.maximum(cls, 0)], 0)
    known = np.concatenate([c > 0, np.zeros(rest, bool)])
    log_all = float(np.log10(n_all + 0.5 * (v_all + 1)))

    noise = np.concatenate([c[:single], np.maximum(n_of, 0)]) + 1
    noise = noise / noise.sum()
    model = Model(int(ins.max()) + 1, len(noise), dim)
    model.b = np.log(noise).astype(np.float32)
    turn = F.pmod(F.xxhash64("row"), F.lit(16))
    for first, last, rate, batch in ROUNDS:
        model = trained(model, learn.where((turn >= first) & (turn < last)), ins, outs, noise, rate, batch)

    shared = docs.sparkSession.sparkContext.broadcast((model, ins, outs, base, inner, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        model, ins, outs, base, inner, known = shared.value
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            raw = batch.column(2).to_pylist()
            cols: list[list] = [[], [], [], []]
            i = 0
            while i < len(raw):
                part, n = [], 0
                while i < len(raw) and n < 50_000:
                    part.append(_unpacked(raw[i], z))
                    n += len(part[-1])
                    i += 1
                code = np.concatenate(part)
                starts = np.cumsum([0, *map(len, part[:-1])])
                per = model.log10(model.contexts([ins[d] for d in part]), outs[code]) + inner[code]
                for out, v in zip(cols, (known[code].astype(np.int64), base[code], per), strict=False):
                    out += np.add.reduceat(v, starts).tolist()
                cols[3] += list(map(len, part))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols[3], pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64())], ["row", "doc_id", "n_tokens", "known", "base", "model"])

    each = heads.select("row", "doc_id", "codes").mapInArrow(tidied(run), f"row long, doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, known long, base double, model double")
    # a word that no training text holds has no row among the counts
    rare = book.where("kind = 1").select("row", "word", "n").join(counts.select("word", "c"), "word", "left")
    held = F.coalesce("c", F.lit(0))
    far_of = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(held + 0.5)).alias("far"), F.sum(F.when(held > 0, F.col("n")).otherwise(0)).alias("far_known"))
    far = F.coalesce("far", F.lit(0.0))
    found = each.join(far_of, "row", "left")
    return found.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + far - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("model") + far).alias("score"),
    )
