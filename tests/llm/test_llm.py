"""Every training-data operator against brute force, and its defined results for
nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import base64
import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import SF, oracle, rows_of
from pyspark.sql import functions as F

from docspark.llm import decontaminate, graph, langid, line_dedup, lm, packing, quality, queries, simhash, token_store, toxicity, warc
from docspark.llm.common import fresh_dir, stored, table
from docspark.llm.tokens import WordEncoder
from docspark.session import ship

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows, with a column whose name an operator uses itself."""
    ship(spark)
    long = "lorem ipsum dolor sit amet " * 6000
    rows = [(0, "", "en"), (1, None, None), (2, "a b c d e f", "en"), (2, "a b c d e f", "en"), (3, long, "en"), (4, "…!? 42", None), (5, "x\n\nx\n \nx", "de"), (None, "no id here", "en"), (7, "één\tתשע 中文 😀", "xx"), (8, "\n\n\n", "en")]
    return spark.createDataFrame([(i, t, lg, "s", len(t or ""), 1.0) for i, t, lg in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return ship(spark).createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    return [(r.doc_id, r.text) for r in table(ship(spark), SF, "documents").select("doc_id", "text").collect()]


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


# tokens, files, packing
def test_word_encoder_is_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    assert t.encode("hello <|endoftext|> world", add_special_tokens=False).ids == [31373, 220, 50256, 995]
    rng = random.Random(2)
    parts = ["a", "B", " ", "  ", "\n", " \n", "\t", "é", "\xa0", "1", "'s", "!", "<|endoftext|>", "😀", "\r\n", "\x1c", "中", "\x85", "b c", "\nd", "word,", "ends."]
    for e in (WordEncoder(BPE), WordEncoder(BPE, memo=5, longest=2)):
        for _ in range(400):
            batch = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4)]
            assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(batch)] == [t.encode(x, add_special_tokens=False).ids for x in batch]


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes_round_trip(tmp_path, planes):
    rng = np.random.default_rng(0)
    ids = [rng.integers(0, 50_257, n).astype("<u4") for n in (0, 1, 7, 1000, 63, 2500)]
    w = token_store.PlaneWriter(str(tmp_path / "a.planes"), planes, block=64)
    for k, x in enumerate(ids):
        w.add(k, x.tobytes())
    w.close()
    r = token_store.PlaneReader(str(tmp_path / "a.planes"))
    assert [(k, x) for k, x in r.documents()] == [(k, x.tobytes()) for k, x in enumerate(ids)]
    assert (r.slice(5, 700) == np.concatenate(ids)[5:700]).all()
    (tmp_path / "a.planes").write_bytes(b"junk" * 9)
    with pytest.raises(ValueError):
        token_store.PlaneReader(str(tmp_path / "a.planes"))


def ids_of(text):
    from tokenizers import Tokenizer

    if not hasattr(ids_of, "t"):
        ids_of.t = Tokenizer.from_file(BPE)
    return [*ids_of.t.encode(text or "", add_special_tokens=False).ids, 2]


def test_op10(spark, corpus):
    start = 0
    got = {r.doc_id: r for r in queries.op10_token_planes(spark, SF).collect()}
    assert len(got) == len(corpus)
    for i, text in sorted(corpus):
        ids = ids_of(text)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_token_files_edges(spark, docs, empty):
    out = token_store.read_tokens(spark, token_store.write_tokens(docs, fresh_dir(spark, "t"), BPE), with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, 0, 1, 2, 2, 3, 4, 5, 7, 8]
    want = {(r.doc_id, r.text or "") for r in docs.collect()}
    assert {(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in out} == {(i, tuple(ids_of(t))) for i, t in want}
    assert token_store.read_tokens(spark, token_store.write_tokens(empty, fresh_dir(spark, "t"), BPE)).count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_op3(spark, corpus):
    rows = queries.op3_best_fit_packing(spark, SF).collect()
    n = check_packing(rows, 1024)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    total = 0
    for i, text in corpus:
        ids, at = ids_of(text), 0
        total += len(ids)
        sizes = [len(ids)] if len(ids) <= 1024 else [x for x in [len(ids) % 1024] if x] + [1024] * (len(ids) // 1024)
        assert [r.length for r in sorted(got[i], key=lambda r: r.piece)] == sizes
        for r in sorted(got[i], key=lambda r: r.piece):
            part = ids[at : at + r.length]
            assert r.start == at and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
    assert n <= math.ceil(total / 1024) * 1.02 + 2


def test_packing_edges(spark, docs, empty):
    rows = packing.pack_documents(docs, BPE, 64, with_ids=True).collect()
    check_packing(rows, 64)
    assert sum(r.piece == 0 for r in rows) == 10 and sum(len(r.ids) for r in rows) == 4 * sum(r.length for r in rows)
    assert packing.pack_documents(empty, BPE).count() == 0
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert {r.doc_id for r in packing.pack_documents(named, BPE, 64).collect()} == {None, *(f"d{k}" for k in (0, 1, 2, 3, 4, 5, 7, 8))}


def test_local_search_keeps_pieces_and_saves_bins():
    rng = random.Random(1)
    for _ in range(30):
        hist = Counter(rng.choice([rng.randint(1, 100), rng.randint(30, 60)]) for _ in range(rng.randint(1, 400)))
        first = packing.best_fit(dict(hist), 100)
        then = packing.local_search(first, 100)
        back = Counter()
        for b, k in then.items():
            assert sum(b) <= 100
            for x in b:
                back[x] += k
        assert back == hist and sum(then.values()) <= sum(first.values())
    # one for two: 60 + 30 and 50 + 20 + 20 become full and nearly empty
    moved = packing.local_search(Counter({(60, 30): 1, (50, 20): 1, (20, 10): 1}), 100)
    assert sum(moved.values()) == 2
    with pytest.raises(ValueError):
        packing.plan({101: 1}, 100)


# language
def test_bit_sliced_filter_returns_all_languages():
    a, b = np.arange(1, 500, dtype=np.uint64) * np.uint64(7919), np.arange(250, 750, dtype=np.uint64) * np.uint64(7919)
    f = langid.Filters.build(["a", "b"], {0: a, 1: b}, 0, (3,))
    mask = f.languages_of(np.concatenate([a, b]))[0]
    assert (mask[: len(a)] & 1).all() and (mask[len(a) :] & 2).all()
    assert (f.false < 0.05).all()


def test_op1(spark):
    truth = {r.doc_id: (r.lang, r.text) for r in table(spark, SF, "documents").collect()}
    rows = queries.op1_language_id(spark, SF).collect()
    assert len(rows) == len(truth) and all(r.held_out == (fold(r.doc_id, 4) == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, docs, empty):
    f = langid.learn(docs.select("doc_id", "text", "lang"), least=1)
    got = {(r.doc_id, r.text): r._lang_pred for r in langid.identified(docs, f).collect()}
    assert got[1, None] == got[0, ""] == got[4, "…!? 42"] == got[8, "\n\n\n"] == "und"
    assert got[3, "lorem ipsum dolor sit amet " * 6000] == "en"
    none = langid.learn(empty.select("doc_id", "text", "lang"))
    assert {r._lang_pred for r in langid.identified(docs, none).collect()} == {"und"}
    assert langid.identified(empty, f).count() == 0
    assert langid.with_language(docs, f).columns == docs.columns


def test_filter_against_exact_sets(spark):
    rows = [r for r in table(spark, SF, "documents").collect() if r.lang]
    f = langid.learn(table(spark, SF, "documents").select("doc_id", "text", "lang"))
    counts = {}
    for r in rows:
        counts.setdefault(r.lang, Counter()).update(h for n in f.sizes for h in langid.grams(langid.code_points(r.text), n).tolist())
    total = {k: sum(c.values()) for k, c in counts.items()}
    held = {}
    for k, c in counts.items():
        held[k] = {h for h, n in c.items() if n >= 3 and all(n / total[k] >= 0.2 * d[h] / total[o] for o, d in counts.items())}
        assert len(held[k]) <= 30_000
    for r in rows[:60]:
        own = [h for n in f.sizes for h in langid.grams(langid.code_points(r.text), n).tolist()]
        if own:
            share = {k: sum(h in s for h in own) / len(own) for k, s in held.items()}
            got, n = f.shares(r.text)
            assert n == len(own)
            for k, lang in enumerate(f.languages):
                assert abs(got[k] - share[lang]) < 0.03
            if sorted(share.values())[-1] > sorted(share.values())[-2] + 0.06:
                assert f.predict(r.text)[0] == max(share, key=share.get)


def test_seventy_languages(spark):
    letters = [chr(0x4E00 + k) for k in range(700)]
    rows = [(k * 10 + j, "".join(letters[k * 10 : k * 10 + 10]) * 4, f"l{k:02}") for k in range(70) for j in range(4)]
    d = ship(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    f = langid.learn(d)
    assert len(f.languages) == 70 and f.masks.shape[0] == 2
    assert all(r._lang_pred == r.lang for r in langid.identified(d, f).collect())


def test_samples_hold_at_any_size(spark):
    from docspark.llm.common import in_sample

    ids = spark.range(400_000)
    for n in (10**6, 10**9, 10**11, 10**13):
        k = n // 400
        assert abs(ids.where(in_sample(F.col("id"), k, n)).count() - 1000) < 160
    assert ids.where(in_sample(F.col("id"), 1500, 1500)).count() == 400_000
    # what one more row in 10 ** 13 needs is still told apart
    assert 1500 / 10**13 * 2**53 > 1000


def test_columns_of_any_name(spark, docs):
    d = docs.withColumns({c: F.lit(1) for c in ("_row", "_gone", "_lines", "_lang_pred", "_score", "_coverage", "_spans", "gone", "n_lines")})
    f = langid.learn(docs.select("doc_id", "text", "lang"), least=1)
    bench = spark.createDataFrame([(1, "a b c"), (2, "lorem ipsum dolor")], "item_id long, text string")
    for out in (langid.with_language(d, f), line_dedup.deduplicated_lines(d), simhash.deduplicated(d), decontaminate.decontaminated(d, bench), decontaminate.decontaminated(d, bench, words_at_once=1)):
        assert out.columns == d.columns and out.count() > 0


# language model
def test_op2_counts_and_scores(spark, corpus):
    rows = {r.doc_id: r for r in queries.op2_lm_scoring(spark, SF).collect()}
    words = {i: lm.tokens((t or "").encode()) for i, t in corpus}
    c = Counter()
    for i, w in words.items():
        if fold(i, 5) != 1:
            c.update([*w, b"\n"])
    n, v = sum(c.values()), len(c)
    for i, w in words.items():
        r, all_ = rows[i], [*w, b"\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(all_), sum(c[x] > 0 for x in all_), n, fold(i, 5) == 1)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in all_))
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_is_normalised():
    m = lm.Model(5, 7, dim=4)
    x = m.contexts([np.array([0, 1, 2])])
    assert x.tolist() == [[5, 5, 5], [0, 5, 5], [1, 0, 5]]
    total = sum(10 ** m.log10(x, np.full(3, y)) for y in range(7))
    assert total == pytest.approx(np.ones(3), rel=1e-5)


def test_model_learns_what_follows():
    rng = np.random.default_rng(3)
    seq = np.cumsum(rng.integers(1, 3, 4000)) % 6
    m = lm.Model(6, 6, dim=8)
    x = m.contexts([seq])
    noise = np.full(6, 1 / 6)
    before = m.log10(x, seq).mean()
    for _ in range(5):
        m.train(x, seq, noise, 0.2, rng, k=16, batch=128)
    assert m.log10(x, seq).mean() > before + 0.3


def test_lm_edges(spark, docs, empty):
    got = lm.scored(docs.withColumn("train", F.lit(True))).collect()
    assert len(got) == 10 and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (0, 1, 8)} == {1}
    assert lm.scored(empty.withColumn("train", F.lit(True))).count() == 0
    untrained = lm.scored(docs.withColumn("train", F.lit(False))).collect()
    assert len(untrained) == 10 and all(r.train_tokens == 0 and r.n_known == 0 for r in untrained)


# decontamination
def brute_windows(items, words, w):
    hit, found = set(), set()
    for k, item in items:
        for x in [item[i : i + w] for i in range(len(item) - w + 1)] if len(item) >= w else [item] if item else []:
            for i in range(len(words) - len(x) + 1):
                if words[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    found.add(k)
    return hit, found


def test_automaton_against_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        v = [b"a", b"b", b"c"][: rng.randint(1, 3)]
        items = [(k, b" ".join(rng.choice(v) for _ in range(rng.randint(0, 9)))) for k in range(rng.randint(0, 5))]
        w = rng.choice([2, 3, 4])
        auto = decontaminate.Automaton(items, w)
        words = [rng.choice([*v, b"z"]) for _ in range(rng.randint(0, 25))]
        spans, found = auto.match(words)
        hit, names = brute_windows([(k, t.split()) for k, t in items], words, w)
        assert {j for a, b in spans for j in range(a, b)} == hit and {auto.names[k] for k in found} == names


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_op4(spark, corpus):
    bench = [(r.item_id, normal(r.text)) for r in table(spark, SF, "benchmark").collect()]
    index = {}
    for k, item in bench:
        for x in {tuple(item[i : i + 8]) for i in range(len(item) - 7)} if len(item) >= 8 else {tuple(item)} - {()}:
            index.setdefault(x, set()).add(k)
    sizes = {len(x) for x in index}
    got = {r.doc_id: r for r in queries.op4_benchmark_decontamination(spark, SF).collect()}
    hits = 0
    for i, text in corpus:
        words, hit, items = normal(text), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if found := index.get(tuple(words[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(items), len(items) >= 2)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        hits += bool(hit)
    assert hits


def test_decontamination_edges(spark, docs, empty):
    bench = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None), (3, "!!"), (4, "ipsum dolor sit amet lorem ipsum dolor sit amet")], "item_id long, text string")
    found = decontaminate.matches(docs, bench)
    many = decontaminate.matches(docs, bench, words_at_once=1)
    key = lambda df: sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.spans], r.items) for r in df.collect())
    assert key(found) == key(many)
    assert key(decontaminate.matches(docs, bench.limit(0)))[0][2:] == ([], [])
    out = {r.doc_id: r.text for r in decontaminate.decontaminated(docs, bench, max_coverage=0.5).collect()}
    assert 3 not in out and out[2] == " d e f" and out[1] is None and len(out) == 8
    assert decontaminate.decontaminated(empty, bench).count() == 0
    assert decontaminate.without_spans(b"Aa, b!  c D.", [(1, 3)]) == b"Aa,  D."[:4] + b" D."[0:]


def test_removal_is_the_same_in_one_pass_and_in_several(spark):
    a, b = [f"a{k}" for k in range(8)], [f"b{k}" for k in range(8)]
    ab = [*a[4:], *b[:4]]
    bench = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(ab))], "item_id long, text string")
    rows = [(1, " ".join([*a, "x", "y", *b, "z", "t"]), "two of 40 %"), (2, " ".join(["x"] * 20 + [*a, *b] + ["y"] * 20), "overlapping"), (3, " ".join(["u"] * 20 + [*a[:4], *a, *a[4:]] + ["v"] * 20), "joined by a cut"), (None, None, "null"), (3, "clean words", "same id")]
    d = ship(spark).createDataFrame([(i, t, len(t or ""), s) for i, t, s in rows], "doc_id long, text string, n_chars long, source string")
    once, many = [sorted((r.source, r.text, r.n_chars) for r in decontaminate.decontaminated(d, bench, words_at_once=w).collect()) for w in (500_000, 1)]
    assert many == once and [r[0] for r in once] == ["joined by a cut", "null", "overlapping", "same id"]
    assert decontaminate.decontaminated(d, bench, words_at_once=1).columns == d.columns
    assert once[2][1] == " ".join(["x"] * 20) + "  " + " ".join(["y"] * 20)


# quality and lines
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert rows_of(queries.queries()[name](spark, SF)) == oracle(queries.oracle_sql()[name])


def test_quality_counts_by_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 90))) for _ in range(40)] + ["a " * 200, "x y z " * 70, None, "", " \n\t"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.measured(d).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        cov = {p for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        assert (r.n_words, r.n_repeat_words, r.n_distinct_words) == (len(w), len(cov), len(set(w)))


def test_quality_ledger(spark, docs, empty):
    book = quality.applied(quality.ledger(docs))
    assert all(r.base_failed and not r.kept for r in book.where("doc_id = 0 or doc_id = 1").collect())
    a = {r["rule"]: r for r in quality.ablations(book).collect()}
    assert a["few_words"].n_failed == 9 and set(a) == set(quality.BIT)
    assert quality.ablations(quality.ledger(empty)).count() == 0
    assert quality.mask("base-1") == 3


def test_line_dedup_edges(spark, docs, empty):
    p = "one\ntwo\nthree"
    extra = [(20, f"{p}\nown", "en"), (21, f"x\n{p}\n\ny\n{p}", "en"), (22, "one\n\ntwo\n three ", "en"), (23, p, "en"), (None, p, "en")]
    d = docs.unionByName(spark.createDataFrame([(i, t, lg, "s", len(t), 1.0) for i, t, lg in extra], SCHEMA))
    got = {(r.doc_id, r.source): r for r in line_dedup.deduplicated_lines(d, counts=True).collect() if r.doc_id}
    assert got[20, "s"].text == f"{p}\nown" and got[21, "s"].text == "x\n\ny" and got[22, "s"].text == "" and got[23, "s"].text == ""
    assert got[21, "s"].n_removed == 6 and got[21, "s"].n_chars == 4 and got[1, "s"].text is None and got[8, "s"].text == "\n\n\n"
    out = line_dedup.deduplicated_lines(d)
    assert out.columns == d.columns and out.count() == d.count() and line_dedup.deduplicated_lines(empty).count() == 0
    assert out.where("doc_id is null").count() == 2


def test_line_dedup_decides_rows(spark):
    p, own = "one\ntwo\nthree", "u1\nu2\nu3\nu4"
    rows = [(1, p, "a"), (5, f"x\n{p}", "b"), (5, own, "c"), (6, p, "d"), (6, p, "e"), (None, f"{p}\nnull", "f"), (None, own, "g")]
    d = spark.createDataFrame(rows, "doc_id long, text string, k string")
    got = {r.k: r.text for r in line_dedup.deduplicated_lines(d).collect()}
    assert got == {"a": p, "b": "x", "c": own, "d": "", "e": "", "f": "null", "g": ""}


# near duplicates
def test_every_pair_in_the_radius_shares_a_key():
    rng = random.Random(0)
    for radius in (1, 2, 3):
        keys = simhash.masks(radius)
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), rng.randint(0, radius)):
                y ^= 1 << b
            assert any(x & m == y & m for m in keys)


def brute_components(prints, radius):
    up = {i: i for i in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: root(i) for i in prints}


@pytest.mark.parametrize("bucket", [2, 16_384])
def test_components_with_large_buckets(spark, bucket, monkeypatch):
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    prints = {}
    for i in range(120):
        x = centre if i < 80 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, 4)):
            x ^= 1 << b
        prints[i] = x
    df = ship(spark).createDataFrame([(i, simhash.signed(x)) for i, x in prints.items()], "doc_id long, fp long")
    whole = simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes, radius: whole(nodes, radius, bucket))
    got = {r.doc_id: r.component_id for r in simhash.components(stored(df, "p"), 2).collect()}
    assert got == brute_components(prints, 2)


def test_op7(spark, corpus):
    import xxhash

    got = {r.doc_id: r for r in queries.op7_simhash_near_dedup(spark, SF).collect()}
    prints = {}
    for i, text in corpus:
        w = (text or "").encode().translate(simhash.LOWER).split()
        s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[i].fingerprint == f"{prints[i]:016x}"
    assert {i: r.component_id for i, r in got.items()} == brute_components(prints, 2)


def test_near_duplicate_edges(spark, docs, empty):
    got = simhash.near_duplicates(docs).collect()
    zero = {r.doc_id: r for r in got if r.fingerprint == "0" * 16}
    assert set(zero) == {0, 1, 8} and {r.component_id for r in zero.values()} == {0}
    assert len(got) == 10 and simhash.near_duplicates(empty).count() == 0
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 2, 3, 4, 5, None, 7}
    assert kept.count() == 7
    a, b, c = (f"{x} {x}1 {x}2 {x}3 {x}4 {x}5" for x in "abc")
    rows = [(3, a, 1), (7, a, 2), (7, b, 3), (9, c, 4), (9, c, 5), (None, a, 6), (None, "only here", 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, k int")
    left = {r.k for r in simhash.deduplicated(d, radius=1).collect()}
    assert left in ({1, 3, 4, 7}, {1, 3, 5, 7})


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    up = {x: x for e in edges for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges for x in (a, b) if a != b}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# archives
def test_op8(spark):
    pages = {r.page_id: (r.html or "").encode() for r in table(spark, SF, "pages").collect()}
    last = {}
    for i, p in sorted(pages.items()):
        last[p] = i
    rows = {r.page_id: r for r in queries.op8_warc(spark, SF).collect()}
    assert len(rows) == len(pages)
    for i, p in pages.items():
        r = rows[i]
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last[p] == i else ("revisit", last[p]))


def test_archive_edges(spark, tmp_path):
    ship(spark)
    rows = [(1, "u", None), (2, "u\r\nX: y", ""), (3, None, "\r\n\r\nWARC/1.1\r\n\r\n"), (4, "u", "same"), (4, "u", "same"), (None, "u", "same"), (5, "u", "é" * 70_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("extra", F.lit(1))
    got = warc.read_archives(spark, warc.write_archives(pages, str(tmp_path / "w"))).collect()
    by = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert by == Counter([(1, "revisit", 2, 0), (2, "response", None, 0), (3, "response", None, 16), (4, "response", None, 4), (4, "revisit", 4, 4), (None, "revisit", 4, 4), (5, "response", None, 140_000)])
    alike = spark.createDataFrame([(None, "u", "x"), (None, "v", "x"), (None, "u", "x"), (7, "b", "y"), (7, None, "y"), (7, "a", "y"), (6, "a", "y")], "page_id long, url string, html string")
    got = warc.read_archives(spark, warc.write_archives(alike, str(tmp_path / "a"))).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter({(None, "response", None): 1, (None, "revisit", None): 2, (7, "response", None): 1, (7, "revisit", 7): 2, (6, "revisit", 7): 1})
    small = warc.read_archives(spark, warc.write_archives(alike, str(tmp_path / "s"), least_bytes=2)).collect()
    assert {r.record_type for r in small} == {"response"} and len(small) == 7
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0), str(tmp_path / "v"))).count() == 0


def test_normaliser_rewrites_each_record(tmp_path):
    raw = [warc.record("response", k, f"http://x/{k}", b"y" * k, warc.digest(b"y" * k), None, "2020-01-01T00:00:00Z") for k in (1, 50_000, 0)]
    cut = raw[2][:60]
    for name, data in (("one", zlib.compress(b"".join(raw) + cut, wbits=31)), ("many", b"".join(zlib.compress(x, wbits=31) for x in [*raw, cut]))):
        (tmp_path / name).write_bytes(data)
        assert warc.normalise(str(tmp_path / name), str(tmp_path / f"{name}.gz")) == 3
        import json

        index = [json.loads(x) for x in (tmp_path / f"{name}.gz.idx").read_text().splitlines()]
        packed = (tmp_path / f"{name}.gz").read_bytes()
        assert [zlib.decompress(packed[e["offset"] : e["offset"] + e["length"]], 31) for e in index[:3]] == raw
        assert index[3]["truncated"] and len(index) == 4


# toxicity
def test_search_is_exact_and_bounded():
    rng = np.random.default_rng(1)
    terms = {f"t{k}".encode(): k for k in range(40)}
    index = toxicity.Index(terms, 1 + rng.random(40), k=7)
    rows = []
    for i in range(300):
        t = np.sort(rng.choice(40, rng.integers(0, 6), replace=False))
        rows.append((i, int(rng.random() < 0.3), t, index.weights(t, rng.integers(1, 4, len(t)).astype(float))))
    index.fill(rows)
    dense = np.zeros((300, 40))
    for i, _, t, w in rows:
        dense[i, t] = w
    for _ in range(50):
        t = np.sort(rng.choice(40, 4, replace=False))
        w = index.weights(t, np.ones(4))
        q = np.zeros(40)
        q[t] = w
        sim = dense @ q
        want = sorted(((s, i) for i, s in enumerate(sim) if s > 1e-12), key=lambda x: -x[0])[:7]
        got = index.nearest(t, w)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want])


def test_op9(spark):
    truth = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    rows = queries.op9_toxicity(spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (fold(r.doc_id, 4) == 2) for r in rows)
    big = SF.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.toxic for r in table(spark, big, "labels").collect()}
    held = [(truth[r.doc_id], r.predicted) for r in queries.op9_toxicity(spark, big).collect() if r.held_out and r.doc_id in truth]
    caught = sum(p for t, p in held if t)
    assert caught >= 0.6 * sum(t for t, _ in held) and caught >= 0.8 * sum(p for _, p in held) and len(held) > 80


def test_toxicity_edges(spark, docs, empty):
    rng = random.Random(6)
    train = [(i, " ".join(rng.choice("abcdefgh") for _ in range(20)) + (" vile" if i % 4 == 0 else "")) for i in range(400)]
    d = spark.createDataFrame(train, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in train] + [(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    index = toxicity.learn(d, labels)
    got = {r.doc_id: r for r in toxicity.scored(docs.unionByName(spark.createDataFrame([(50, "so VILE!", "en", "s", 1, 1.0)], SCHEMA)), index).collect()}
    assert got[50].predicted == 1 and got[50].neighbours and got[0].predicted == got[1].predicted == 0 and len(got) == 10
    none = toxicity.learn(d, labels.limit(0))
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.0}
    assert toxicity.scored(empty, index).count() == 0


def test_words_of_letters_go_to_the_model():
    import random

    import public_tokenizers

    enc = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng, letters = random.Random(3), [chr(c) for c in range(0x250) if chr(c).isalpha()]
    words = ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(500)]
    texts = [" ".join(words), "\n".join(words), "don't we'll it's x2 2x ﬁn naïve Ⅷ ʔa ﬀ. été, ªº"]
    assert enc.encode(texts) == enc._whole(texts)
    sent = []
    whole = enc._whole
    enc._whole = lambda texts: sent.extend(texts) or whole(texts)
    enc.encode([" ".join(w + "q" for w in words)])
    assert not sent  # no letter word takes the way through the pre-tokeniser
    enc.letters = None
    assert enc.encode([" ".join(w + "z" for w in words)]) == whole([" ".join(w + "z" for w in words)])


def test_few_characters_are_encoded_at_once(monkeypatch):
    import inspect

    import pyarrow as pa

    from docspark.llm import packing, token_store

    seen = []

    class Count:
        def encode(self, texts):
            seen.append(sum(map(len, texts)))
            return [b"" for _ in texts]

    monkeypatch.setattr(token_store, "encoder", lambda path: Count())
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": ["x" * 8000] * 1000})
    assert len(list(token_store.encoded([batch], ""))) == 1000
    assert sum(seen) == 8_000_000 and max(seen) <= 1_500_000 + 8000
    assert inspect.signature(packing.pieces).parameters["group"].default <= 1_500_000


def test_words_are_encoded_once():
    enc = WordEncoder(BPE)
    asked = []
    words_of = enc._words
    enc._words = lambda words, *more: asked.append(len(words)) or words_of(words, *more)
    text = " ".join("".join(chr(97 + k // 26**j % 26) for j in range(5)) for k in range(300_000))
    first = enc.encode([text])
    assert enc.encode([text]) == first
    assert sum(asked) == 300_000


def test_marks_after_letters_are_a_piece_of_their_own():
    enc = WordEncoder(BPE)
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abéÀōz", k=rng.randint(1, 9)))
    words = [word() + "".join(rng.choices(marks, k=rng.randint(1, 5))) for _ in range(3000)]
    words += [word() + rng.choice(["'s", "'ll.", "1!", "—", "!a", "-b-"]) for _ in range(300)]
    rng.shuffle(words)
    texts = [" ".join(words), "\n".join(words), *words[:100]]
    assert enc.encode(texts) == enc._whole(texts)
    sent = []
    whole = enc._whole
    enc._whole = lambda texts: sent.extend(texts) or whole(texts)
    enc.encode([" ".join(w + "q" + m for w, m in zip(("xy" * 30, "é" * 9), (",###", "..."), strict=True))])
    assert not any("q" in x for x in sent)  # the letters are not sent with their marks


def test_op3_encodes_each_word_once(monkeypatch):
    import pyarrow as pa

    enc, sent = WordEncoder(BPE), []
    words_of, rng = enc._words, random.Random(7)
    enc._words = lambda words, *more: sent.append(len(words)) or words_of(words, *more)
    monkeypatch.setattr(token_store, "encoder", lambda path: enc)
    known = ["".join(rng.choices("abcdefghij", k=9)) for _ in range(2000)]
    rows = ["x " + " ".join(w + rng.choice(["", ",", ".", ";", "...", "!?", "###"]) for w in rng.sample(known, 2000)) for _ in range(20)]
    got = [raw for _, raw in token_store.encoded([pa.RecordBatch.from_pydict({"doc_id": list(range(20)), "text": rows})], BPE, group=20_000)]
    assert got == [x + token_store.END_BYTES for x in enc._whole(rows)]
    assert sum(sent) == len(set(known)) + 1 + 6  # with the first word and six sorts of marks


def test_distinct_words_are_the_tokens_of_each_text():
    import pyarrow as pa

    rng = random.Random(11)
    parts = ["a", "B", "éÀ", " ", "  ", "\n", "\t", "\x0b", "\x0c\r", "\x1c", "\xa0", "\x85", "word,", "\x00", "中"]
    texts = [None, "", " ", *("".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(500))]
    for column in (pa.array(texts), pa.array(texts).slice(200), pa.array(texts[:2]), pa.array(texts[:0], pa.string())):
        words, at, bounds = lm.distinct(column)
        words = [x.encode() for x in words.to_pylist()]
        got = [[words[k] for k in at[i:j]] for i, j in itertools.pairwise(bounds)]
        assert got == [lm.tokens((x or "").encode()) for x in column.to_pylist()]
        assert len(set(words)) == len(words)


def test_coded_texts_by_brute_force(spark, docs):
    texts = ["Xa, Xa xb. xb. xc", None, "zz!! xa, " * 3, "  ", "xb qrs?"]
    d = docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("train", F.lit(True))
    vocab = lm.Vocabulary({lm.END: 0, b"xa,": 1, b"xc": 2}, {b"xb": 0, b"rs": 1, b"qrs": 2})
    rows = lm.coded(d, vocab).collect()
    z = __import__("zstandard").ZstdDecompressor()
    heads = {r.doc_id: r for r in rows if r.kind == 0}
    far = Counter()
    for i, t in enumerate(texts):
        words = lm.tokens((t or "").encode())
        code = [vocab.hot.get(w, len(vocab.hot) + vocab.ending(w)) for w in words]
        assert lm._unpacked(heads[i].codes, z).tolist() == [*code, 0] and heads[i].n == len(words) + 1
        far.update((heads[i].row, w) for w in words if w not in vocab.hot)
    assert {(r.row, bytes(r.word)): r.n for r in rows if r.kind == 1} == dict(far)
    assert len({r.row for r in heads.values()}) == len(texts)


def test_op2_counts_words_without_a_call_for_each_text(spark, monkeypatch):
    import pyarrow as pa

    class Caught:
        def mapInArrow(self, run, schema):
            self.run = run
            return self

        select = groupBy = agg = lambda self, *columns: self

    def one_by_one(text):
        raise AssertionError("a text was split by itself")

    texts = ["A b, b,", None, "b, c"]
    monkeypatch.setattr(lm, "tokens", one_by_one)
    got = Counter()
    for batch in lm.word_counts(Caught()).run(iter([pa.RecordBatch.from_pydict({"text": texts})])):
        for r in batch.to_pylist():
            got[r["word"], r["ending"]] += r["c"]
    assert got == {(b"a", b"a"): 1, (b"b,", b"b"): 3, (b"c", b"c"): 1}


class Tasks:
    """A frame of which the task of mapInArrow is kept."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    select = groupBy = agg = lambda self, *columns: self


def test_op2_holds_few_texts_at_once_and_gives_memory_back(spark, monkeypatch):
    import pyarrow as pa

    from docspark.llm import common

    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(20_000)]
    texts = [" ".join(rng.choices(words, k=1000)) for _ in range(2000)]
    whole = [pa.RecordBatch.from_pydict({"text": texts})]  # one batch of 12 MB
    pool, tidied = pa.proxy_memory_pool(pa.default_memory_pool()), []
    monkeypatch.setattr(common, "tidy", lambda: tidied.append(0))
    usual = pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        got = Counter()
        for batch in lm.word_counts(Tasks()).run(iter(whole)):
            for w, c in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                got[w.decode()] += c
            del batch
    finally:
        pa.set_memory_pool(usual)
    assert got == Counter(w for t in texts for w in t.split())
    assert pool.max_memory() < 48 << 20
    assert len(tidied) == 2


def test_pieces_of_a_batch_are_its_rows():
    import pyarrow as pa

    for texts in ([], [None], ["a" * 50], ["", None, "a" * 9, "b" * 30, "c", "d" * 10, "", "é" * 5, None]):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
        parts = list(lm.pieces(batch, 1, 10))
        assert [r for p in parts for r in p.to_pylist()] == batch.to_pylist()
        for p in parts:
            sizes = [len((t or "").encode()) for t in p.column(1).to_pylist()]
            assert sizes and sum(sizes) < 10 + max(sizes[0], next((n for n in sizes if n), 0))


def test_op2_codes_are_the_same_in_pieces(spark, docs, monkeypatch):
    vocab = lm.Vocabulary({lm.END: 0, b"lorem": 1, b"a": 2}, {b"rem": 0, b"sum": 1})
    d = docs.select("doc_id", "text", F.lit(True).alias("train"))
    monkeypatch.setattr(lm.pieces, "__defaults__", (8,))
    row = lambda r: (r.kind, r.row, r.doc_id, r.train, r.n, bytes(r.word or b""), bytes(r.codes or b""))
    counts = lambda: sorted((bytes(r.word), bytes(r.ending), r.c) for r in lm.word_counts(docs).collect())
    few, few_counts = sorted(map(repr, map(row, lm.coded(d, vocab).collect()))), counts()
    monkeypatch.setattr(lm.pieces, "__defaults__", (1 << 30,))
    assert few == sorted(map(repr, map(row, lm.coded(d, vocab).collect()))) and few_counts == counts()


def test_op2_starts_no_workers_for_rows_of_the_driver(spark, docs, monkeypatch):
    def by_python(*a, **k):
        raise AssertionError("rows of the driver went through Python workers of their own")

    train = docs.withColumn("train", F.lit(True))
    n = train.count()
    monkeypatch.setattr(type(spark), "_createFromLocal", by_python)
    assert lm.scored(train).count() == n
