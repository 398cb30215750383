import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.functions import bidi, codec, media, values
from docspark.operators import breaking, edits, lookups
from docspark.plans import office_queries


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_controls_that_stay_open_and_stray_closes(spark):
    marks = spark.createDataFrame([(1, 10, 1, "a"), (1, 20, 1, "b"), (1, 30, -1, None), (2, 5, 1, "c")], "f int, at int, step int, id string")
    asked = spark.createDataFrame([(1, 5, 1), (1, 25, 2), (1, 40, 3), (2, 9, 4), (3, 1, 5)], "f int, at int, pos long")
    assert rows(lookups.control_at(marks, asked, ["f"], "at").select("pos", "control"), "pos") == [(1, None), (2, "b"), (3, "a"), (4, "c"), (5, None)]
    assert rows(lookups.control_ranges(marks, ["f"], "at").select("id", "to"), "id") == [("a", None), ("b", 30), ("c", None)]


def test_nearest_place_and_ties(spark):
    places = spark.createDataFrame([(1, 0.0, 7), (1, 10.0, 3), (1, 10.0, 2), (2, 1.0, 9)], "k int, x double, id int")
    points = spark.createDataFrame([(1, 5.0, 1), (1, 4.0, 2), (1, 10.0, 3), (1, -3.0, 4), (2, 50.0, 5), (3, 0.0, 6)], "k int, x double, point long")
    assert rows(lookups.nearest(points, places, ["k"], "x", "id").select("point", "id"), "point") == [(1, 2), (2, 7), (3, 2), (4, 7), (5, 9), (6, None)]


def test_ranks_don_t_depend_on_ranges(spark):
    rng = random.Random(4)
    data = [(rng.choice("abcde") * rng.randint(1, 3), k) for k in range(500)]
    df = spark.createDataFrame(data, "s string, k long")
    want = {x: i for i, x in enumerate(sorted(data), 1)}
    for parts, sample in ((64, 4096), (3, 20), (1, 5)):
        got = lookups.ranked(df, ["s", "k"], "no", parts, sample).collect()
        assert {(r.s, r.k): r.no for r in got} == want
    assert lookups.ranked(df.limit(0), ["s", "k"], "no").count() == 0


def test_ranks_make_their_order_once(spark):
    df = spark.range(2000).select("id", F.regexp_replace(F.hex(F.xxhash64("id")), "0+", "").alias("s"))
    plan = lookups.ranked(df, ["s", "id"], "no")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("regexp_replace") == 1
    odd = spark.createDataFrame([(None, 1), ("b", 2), (None, 3), ("a", 4), ("", 5)], "s string, k long")
    assert rows(lookups.ranked(odd, ["s", "k"], "no", 2).select("no", "k"), "no") == [(1, 1), (2, 3), (3, 5), (4, 4), (5, 2)]


def records_shuffled(spark, df):
    """Rows that a query deals out between its stages, its result thrown away."""
    empty = spark.sparkContext._jvm.java.util.ArrayList()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(empty, False, False, quantiles, empty)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    was = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - was


def test_a_whole_file_is_listed_without_being_dealt_out(spark):
    rng = random.Random(5)
    cites = [(d, rng.choice([k for k in range(2100) if k % 7]), at) for d in range(60) for at in range(rng.choice([1, 5, 40]))] + [(60, 5000, 0)]
    entries = [(k, 3 * k % 2000 + (k >= 2000) * 9000) for k in range(2000)] + [(9999, -1)]
    want, order = {}, [k for k, _ in sorted(entries, key=lambda e: e[1])]
    for d in range(61):
        first = dict.fromkeys(k for x, k, _ in cites if x == d)
        shown = [k for k in first if k in set(order)]
        want |= {(d, k): n for n, k in enumerate(shown + [k for k in order if d % 3 == 0 and k not in first], 1)}
    c, e = spark.createDataFrame(cites, "d int, k long, at int").cache(), spark.createDataFrame(entries, "k long, file_ord long").cache()
    for chunk in (1024, 1):
        got = lookups.cited_order(c, e, "d", "k", "at", F.col("d") % 3 == 0, chunk)
        assert {(r.d, r.k): r.no for r in got.collect()} == want and got.count() == len(want)
    assert records_shuffled(spark, lookups.cited_order(c, e, "d", "k", "at", F.col("d") % 3 == 0)) < len(want) / 1.5


def test_neighbours_by_frames_that_grow(spark):
    rng = random.Random(6)
    places = [(k % 3, float(rng.randint(0, 300)), k) for k in range(200)]
    points = [(rng.randint(0, 3), float(rng.randint(-20, 320)), k) for k in range(800)]
    df = lookups.nearest(spark.createDataFrame(points, "k int, x double, point long"), spark.createDataFrame(places, "k int, x double, id int"), ["k"], "x", "id")
    want = {p: min(((abs(x - y), i) for q, y, i in places if q == k), default=(0, None))[1] for k, x, p in points}
    assert {r.point: r.id for r in df.collect()} == want
    marks = spark.createDataFrame([(1, 5), (1, 9), (2, 1)], "k int, start int")
    near = lookups.next_mark(spark.createDataFrame([(1, 5), (1, 7), (1, 9), (2, 0), (3, 4)], "k int, pos int"), marks, "k")
    assert rows(near, "k", "pos") == [(1, 5, 9, None), (1, 7, 9, 5), (1, 9, None, 5), (2, 0, 1, None), (3, 4, None, None)]
    for plan in (df, near):  # a frame to the end of its group takes the square of it
        assert "unboundedfollowing" not in plan._jdf.queryExecution().executedPlan().toString()


def test_topmost_of_many_boxes(spark):
    rng = random.Random(7)
    boxes = [(k % 2, k, x, y, x + rng.choice([0.0, 3.5, 20.0, 40.0]), y + rng.choice([0.0, 5.0, 33.0])) for k in range(3000) for x, y in [(rng.choice([-7.0, 0.0, 16.0, 2.5, 31.0]), float(rng.randint(-20, 40)))]]
    boxes += [(0, 9000, 5.0, 5.0, 1.0, 9.0), (0, 9001, None, 0.0, 50.0, 50.0)]
    points = [(rng.randint(0, 2), k, rng.choice([0.0, 16.0, 2.5, 32.0, -7.0, 11.25]), float(rng.randint(-25, 75))) for k in range(900)]
    holds = lambda b, x, y: b[2] is not None and b[2] <= x <= b[4] and b[3] <= y <= b[5]
    want = {p: max((b[1] for b in boxes if b[0] == g and holds(b, x, y)), default=None) for g, p, x, y in points}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:  # rows that a join makes: far fewer than there are pairs of a point and a box that holds it
        df = lookups.topmost_at(spark.createDataFrame(boxes, "page int, idx long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(points, "page int, point long, x double, y double"), "page", 16.0)
        assert {r.point: r.box for r in df.collect()} == want
        made, nodes = [], [df._jdf.queryExecution().executedPlan()]
        while nodes:
            node = nodes.pop()
            kids = node.children()
            nodes += [kids.apply(k) for k in range(kids.size())]
            if "Join" in node.nodeName():
                made.append(node.metrics().apply("numOutputRows").value())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(made) < 30 * len(points) < sum(holds(b, x, y) for g, _, x, y in points for b in boxes if b[0] == g)


def test_children_that_stay(spark):
    cases = [([1, 2, 3, 4], [4, 1, 2, 3], 3), ([1, 2, 3], [3, 2, 1], 1), ([1, 2], [9, 1, 8, 2], 2), ([], [5], 0)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a array<int>, b array<int>")
    assert [r[1] for r in rows(df.select("k", lookups.kept_children(F.col("a"), F.col("b"))), "k")] == [n for _, _, n in cases]


def test_positions_within_characters(spark):
    df = spark.createDataFrame([("aé",), ("",), (None,)], "t string")
    got = df.select(*[lookups.position_valid(F.col("t"), F.lit(k)).alias(f"v{k}") for k in (-1, 0, 1, 2, 3, 4)]).collect()
    assert tuple(got[0]) == (False, True, True, False, True, False) and tuple(got[1]) == (False, True, False, False, False, False) and not any(got[2])


def test_an_outline_with_a_loop_ends(spark):
    df = spark.createDataFrame([(1, "a", None, 0, "A"), (1, "b", "a", 1, "B"), (1, "c", "a", 0, "C"), (1, "x", "y", 0, "X"), (1, "y", "x", 0, "Y")], "d int, id string, p string, o int, t string")
    assert rows(lookups.outline(df, "d", "id", "p", "o", "t").select("no", "level", "id"), "no") == [(1, 1, "a"), (2, 2, "c"), (3, 2, "b")]


def test_deletion_across_paragraphs(spark):
    blocks = spark.createDataFrame([(1, 0, "ab", "h"), (1, 1, "cd", "x"), (1, 2, "ef", "y"), (2, 0, "gh", "z")], "p int, ord int, t string, role string")
    ranges = spark.createDataFrame([(1, 0, 1, 2, 1), (2, 0, 0, 5, 1)], "p int, first int, at int, last int, to int")
    assert rows(edits.deleted_across(blocks, ranges, "p", "ord", "t"), "p", "ord") == [(1, 0, "af", "h"), (2, 0, "gh", "z")]


def test_many_paragraphs_are_fitted_as_one_is():
    rng = random.Random(1)
    data = ["x" * 45 + " a b c d " + "y" * 60, "", "a", " ".join("z" * rng.choice([39, 38, 2]) for _ in range(30))]
    data += [" ".join("w" * rng.randint(1, 12) for _ in range(rng.randint(1, 60))) for _ in range(120)] + [" ".join("a" * rng.choice([1, 2]) for _ in range(80)) for _ in range(5)]
    paras = [breaking.Paragraph.of(t) for t in data]
    for width in (400, 95):
        many = breaking.fit_many([np.array(p.boxes, np.int64) for p in paras], width)
        exact = lambda over, room: breaking.badness(over, room)  # noqa: E731  the general program
        assert [tuple(x) for x in many] == [(*breaking.total_fit(p, width, bad=exact), breaking.demerits(p, breaking.first_fit(p, width), width)) for p in paras]


def test_looser_fits_of_many_paragraphs(monkeypatch):
    rng = random.Random(11)
    texts = ["", "a", "a b", "y" * 60, "x" * 45 + " a b c d " + "y" * 60, " ".join("a" * rng.choice([1, 2]) for _ in range(80)), " ".join(["z" * 60] * 3000)]
    texts += [" ".join("z" * rng.choice([39, 38, 2]) for _ in range(30)), " ".join("w" * 7 for _ in range(70)), " ".join("q" * 41 for _ in range(9))]
    texts += [" ".join("w" * rng.choice([rng.randint(1, 12), rng.randint(1, 50) if j % 5 == 0 else 4]) for _ in range(rng.randint(1, 90))) for j in range(160)]
    boxes = [np.fromiter(map(len, t.split()), np.int64) * breaking.CHAR for t in texts]
    for width in (400, 95):
        best = breaking.fit_many(boxes, width)
        for more in (1, -1, 3):
            asked = [len(b[0]) + more for b in best]
            want = [breaking._fit_words(p.tolist(), width, n) for p, n in zip(boxes, asked, strict=True)]
            assert breaking.fit_lines(boxes, width, asked) == want
            monkeypatch.setattr(breaking, "_PLACES", 10_000)
            assert breaking.fit_lines(boxes[:40], width, asked[:40]) == want[:40]
            monkeypatch.undo()
    # all that can have so many lines are fitted at once
    plain = [p for p in boxes if 2 < len(p) < 200 and p.max() < 300]
    monkeypatch.setattr(breaking, "_fit_words", None)
    assert len(breaking.fit_lines(plain, 400, [len(b[0]) + 1 for b in breaking.fit_many(plain, 400)])) == len(plain) > 60


def test_halves_of_a_colour_are_rounded_as_by_sql(spark, tmp_path):
    from compare import oracle, rows_of

    rng = random.Random(12)
    keys = [66_059, 66_067, 68_107, 68_195, *rng.sample(range(1 << 24), 5000)]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    sql = office_queries.ORACLE["theme_colours"].replace("FROM part)", f"FROM '{tmp_path}/part.parquet/*.parquet')")
    assert rows_of(office_queries.theme_colours(spark, str(tmp_path))) == oracle(sql)
    grey = spark.createDataFrame([(0x808080,), (0xFF0000,), (0x102030,)], "c int")
    assert [tuple(r) for r in grey.select(media.lum_adjusted(F.col("c"), F.lit(50_000), F.lit(0)), media.lum_adjusted(F.col("c"), F.lit(60_000), F.lit(40_000))).collect()] == [(0x404040, 0xB3B3B3), (0x800000, 0xFF6666), (0x081018, 0x3D79B6)]


def test_levels_of_mixed_text():
    h = "אבג"
    want = {f"abc {h} 123": [0] * 4 + [1] * 4 + [2] * 3, f"{h} abc": [1] * 4 + [2] * 3, f"a⁧{h}⁩b": [0, 0, 1, 1, 1, 0, 0], f"a ({h}) b": [0] * 3 + [1] * 3 + [0] * 3, f"123 {h}": [2] * 3 + [1] * 4, "": []}
    for text, levels in want.items():
        assert bidi.levels(text) == levels
    assert bidi.visual(f"abc {h} 123") == f"abc 123 {h[::-1]}"
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("aא1+,.( )[]‫‬⁧⁩١́\n\t") for _ in range(rng.randint(0, 20)))
        assert len(bidi.levels(t)) == len(t) and sorted(bidi.visual(t)) == sorted(t)


@pytest.mark.parametrize("raw", [b"", b"a", b"-----A---B", bytes(range(256)) * 3])
def test_filters_and_broken_streams(raw):
    # the table as an encoder builds it
    table, width, codes, word = {bytes([k]): k for k in range(256)}, 9, [(256, 9)], b""
    for k in raw:
        c = bytes([k])
        if word + c in table:
            word += c
            continue
        codes.append((table[word], width))
        table[word + c] = len(table) + 2
        width = max(9, min(12, (len(table) + 2).bit_length()))
        word = c
    if word:
        codes.append((table[word], width))
        width = max(9, min(12, (len(table) + 3).bit_length()))
    bits = "".join(f"{c:0{w}b}" for c, w in [*codes, (257, width)])
    packed = int((bits + "0" * (-len(bits) % 8)), 2).to_bytes(-(-len(bits) // 8), "big")
    assert codec.lzw(packed) == raw
    assert codec.unfiltered(raw.hex().encode() + b">", ["ASCIIHexDecode"]) == raw
    assert codec.unfiltered(zlib.compress(raw), ["FlateDecode"]) == raw
    for name in codec.FILTERS:
        for cut in (b"", b"\xff", packed[:3], zlib.compress(raw)[:5]):
            assert isinstance(codec.unfiltered(cut, [name]), bytes)
    assert codec.gif_delays(b"GIF89a") == [] and codec.unfiltered(b"x", ["Other"]) == b""


def test_values_of_odd_input(spark):
    df = spark.createDataFrame([("#12",), ("rgb(300, 0,1)",), ("",), (None,), ("12",), ("-.5em",), ("1 0px",)], "x string")
    got = [tuple(r) for r in df.select(values.css_colour(F.col("x")), values.css_length(F.col("x"))).collect()]
    assert got == [(None, None), (255 * 65_536 + 1, None), (None, None), (None, None), (None, 9.0), (None, -6.0), (None, None)]
    n = spark.createDataFrame([(0,), (-1,), (2**62,), (-(2**62),), (65_536,)], "v long")
    assert [tuple(r) for r in n.select(values.bj_value(values.bj_int(F.col("v"))), F.col("v")).collect()] == [(v, v) for v in (0, -1, 2**62, -(2**62), 65_536)]
    assert [r[0] for r in n.select(values.whole_root(F.col("v"))).collect()] == [0, 0, 2**31, 0, 256]
