"""The pipeline's stages against plain Python, and near-dedup against all pairs."""

import re
import struct
import zlib
from collections import Counter

import pytest
from compare import SF

pipeline = pytest.importorskip("corpus_pipeline")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_lines(docs):
    """Line dedup of {doc_id: text}."""
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        lines = text.split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for three in zip(full, full[1:], full[2:], strict=False):
            key = tuple(lines[k].strip(" ") for k in three)
            if key in seen:
                gone.update(three)
            seen.add(key)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text
    return out


def plain_near(docs):
    sets = {}
    for i, t in docs.items():
        w = t.encode().translate(LOWER).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    up = {i: i for i in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(docs)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: docs[i] for i in ids if root(i) == i}


def plain_clean(docs, items):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    windows = set()
    for t in items:
        w = WORD.findall(lower(t))
        windows |= {tuple(w[k : k + 8]) for k in range(len(w) - 7)} if len(w) >= 8 else {tuple(w)} - {()}
    sizes, out = {len(w) for w in windows}, {}
    for i, text in docs.items():
        found = list(WORD.finditer(lower(text)))
        words, hit = [m[0] for m in found], set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit.add((k, n))
        cover = sorted({p for k, n in hit for p in range(k, k + n)})
        if len(cover) > 0.5 * len(words):
            continue
        spans = []
        for k, n in sorted(hit):
            if spans and spans[-1][1] >= k:
                spans[-1][1] = max(spans[-1][1], k + n)
            else:
                spans.append([k, k + n])
        kept, done = [], 0
        for a, b in spans:
            kept.append(text[done : found[a].start()])
            done = found[b - 1].end()
        out[i] = "".join(kept) + text[done:]
    return out


def test_stages_and_run(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text or "") for r in docs.collect()) or k == 0
            texts.append({r.doc_id: r.text or "" for r in docs.collect()})
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    # no document of this table is without a language
    assert {i: t for i, t in texts[0].items()} == {i: t for i, t in whole.items() if i in texts[0]} and len(texts[0]) > 0.98 * len(whole)
    assert texts[1] == plain_lines(texts[0])
    assert texts[2] == plain_near(texts[1])
    assert texts[3] == plain_clean(texts[2], [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    rows, bpe, by = docs.collect(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(texts[3])
    for i, t in texts[3].items():
        ids = [*bpe.encode(t, add_special_tokens=False).ids, 2]
        for r in by[i]:
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32
        assert sum(r.length for r in by[i]) == len(ids)
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024
    again = pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in again) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)


def test_near_copies_leave_one(spark):
    words = [f"w{k}" for k in range(400)]
    near = [*words[:200], "changed", *words[201:]]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(near)), (4, " ".join(reversed(words)))]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in pipeline.near_duplicates(spark, d, SF).collect()}
    assert {1, 4} <= kept and 2 not in kept


def test_all_pairs_at_the_similarity_are_linked(spark):
    import itertools
    import random

    rng = random.Random(11)
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    for g in range(25):
        first = [f"w{rng.randint(0, 999)}" for _ in range(rng.randint(20, 300))]
        for k in range(rng.randint(2, 6)):
            w = list(first)
            for _ in range(rng.randint(0, len(w) // 40 + 1)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
            rows.append((1_000_000 + g * 100 + k, " ".join(w)))
    rng.shuffle(rows)
    sets = []
    for _, t in rows:
        w = t.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or 5 * len(a & b) >= 4 * len(a | b):
            up[root(i)] = root(j)
    want = {}
    for k, (i, _) in enumerate(rows):
        want[root(k)] = min(i, want.get(root(k), i))
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.near_duplicates(spark, d, SF)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == sorted(want.values())


def test_near_copies_are_decided_by_row(spark):
    t = "one two three four five six"
    rows = [(1, t, 1), (2, t, 2), (2, "all other words stand in here", 3), (3, "twice the same id and text", 4), (3, "twice the same id and text", 5), (None, "no id but the same text", 6), (None, "no id but the same text", 7), (4, None, 8), (5, "", 9)]
    d = spark.createDataFrame([(i, x, "en", "s", n) for i, x, n in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), r.text) for r in pipeline.near_duplicates(spark, d, SF).collect() if r.text)
    assert got == [("1", t), ("2", "all other words stand in here"), ("3", "twice the same id and text"), ("None", "no id but the same text")]
    assert pipeline.near_duplicates(spark, d, SF).count() == 5


def test_near_copies_come_from_simhash(spark, monkeypatch):
    """Its tables find all similar pairs, also when they have several keys, larger ones
    come in parts and rows wait; without it only equal sets are found."""
    import random

    from docspark.llm import jaccard, simhash

    rng = random.Random(5)
    rows = []
    for g in range(60):
        first = [f"w{rng.randint(0, 999)}" for _ in range(rng.randint(20, 200))]
        for k in range(40 if g == 0 else 3):
            w = list(first)
            for _ in range(rng.randint(0, len(w) // 40 + 1)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
            rows.append((g * 100 + k, " ".join(w)))
    rows += [(10_000 + k, f"all the other texts are few words {k % 7}") for k in range(9)]
    rng.shuffle(rows)
    want = sorted(plain_near(dict(rows)))
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for region in (16_384, 8):
        assert sorted(r.doc_id for r in jaccard.deduplicated(d, 5, 80, region).collect()) == want
    monkeypatch.setattr(jaccard, "near_pairs", lambda prints, *_: simhash.near_pairs(prints, *_).where("false"))
    equal = {frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for _, t in rows}
    assert pipeline.near_duplicates(spark, d, SF).count() == len(equal) > len(want)


def test_near_texts_that_are_not_linked_make_few_rows(spark, monkeypatch):
    """A group of 300 texts, each like each other by 0.75, and near copies of some: the rows
    made are a multiple of the texts, not of their pairs, and all links are found, also
    where the group comes in pieces."""
    import random

    from docspark.llm import jaccard

    rng = random.Random(3)
    core = [f"c{k}" for k in range(150)]
    rows = [(k, " ".join([*core, *(f"t{k}x{i}" for i in range(25))])) for k in range(300)]
    rows += [(1000 + k, f"{t} one{k} two{k} more{k}") for k, t in rng.sample(rows, 20)]
    rows += [(2000 + k, f"{t} on") for k, t in rng.sample(rows, 20)]
    rng.shuffle(rows)
    want = sorted(plain_near(dict(rows)))
    assert 300 <= len(want) < len(rows)
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near_pairs, made = jaccard.near_pairs, []

    def counted(*given):
        found = jaccard.stored(near_pairs(*given), "found")
        made.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "near_pairs", counted)
    assert sorted(r.doc_id for r in jaccard.deduplicated(d, 5, 80).collect()) == want
    assert sum(made) <= 17 * len(rows)
    monkeypatch.setattr(jaccard, "PIECE", 10_000)
    for region in (16_384, 50):
        assert sorted(r.doc_id for r in jaccard.deduplicated(d, 5, 80, region).collect()) == want
