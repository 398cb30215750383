import random

from pyspark.sql import functions as F

from docspark.functions import detect, numbers, segment, text
from docspark.operators import blocks, breaking, delta, log, numbering, pagetext, runs, styles
from docspark.sources import bibtex, html, markdown


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_format_detection(spark):
    cases = {
        "": "text", "  \n ": "text", "{\\rtf1 x}": "rtf", "<p>": "html", "﻿ <p>": "html", "# x": "markdown", "#x": "text", "a\n- b": "markdown",
        "a **b** c": "markdown", "see [a](b)": "markdown", "|a|b|": "markdown", "PK\x03\x04zz": "docx", "PK\x03\x04 ppt/presentation.xml": "pptx",
        '{"_DataInfo_": {}}': "jdata", '{"a": 1}': "text", "plain words": "text",
    }
    got = spark.createDataFrame(list(cases.items()), "x string, y string").select("x", "y", detect.detect_format(F.col("x")).alias("z")).collect()
    assert [(r.x, r.z) for r in got] == [(r.x, r.y) for r in got]


def test_number_formats(spark):
    want = {"lowerroman": "mcmxciv", "upperroman": "MCMXCIV", "loweralpha": "bxr", "ordinal": "1994th", "cjkcounting": "一千九百九十四", "cardinaltext": "1994", "fullwidth": "１９９４"}
    row = spark.range(1994, 1995).select(*[numbers.format_number(F.col("id"), f).alias(f) for f in want]).first()
    assert row.asDict() == want
    small = spark.range(10, 11).select(numbers.format_number(F.col("id"), "cjkcounting"), numbers.format_number(F.col("id"), "cjktraditional"), numbers.format_number(F.col("id"), "symbol")).first()
    assert tuple(small) == ("十", "癸", "†††")


def test_list_labels_follow_the_fixture(spark):
    items = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 0)], "flow int, seq int, level int")
    c = numbering.list_counters(items, [F.col("flow")], F.col("level"), [F.col("seq")], 2, [1, 1])
    shown = [numbers.format_number(F.col("c0"), "decimal"), numbers.format_number(F.col("c1"), "loweralpha")]
    label = F.when(F.col("level") == 0, numbering.list_label("%1.", shown)).otherwise(numbering.list_label("%1.%2)", shown))
    assert [r[0] for r in c.orderBy("seq").select(label).collect()] == ["1.", "1.a)", "1.b)", "2."]


def sorts(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Sort [")


def test_counters_of_all_levels_from_one_sort(spark):
    rng = random.Random(8)
    data = [(f, k, rng.choice([0, 1, 1, 2, 2, 2, 5])) for f in range(5) for k in range(60)]
    c = numbering.list_counters(spark.createDataFrame(data, "flow int, seq int, level int"), [F.col("flow")], F.col("level"), [F.col("seq")], 3, [1, 1, 4])
    want, starts = {}, [1, 1, 4]
    for f, k, lv in data:
        count = [0, 0, 0] if not k else count  # noqa: F821  of the item before
        at = min(lv, 2)
        count = [n if i < at else n + 1 if i == at else 0 for i, n in enumerate(count)]
        want[f, k] = tuple(n and n + s - 1 for n, s in zip(count, starts, strict=True))
    assert {(r.flow, r.seq): (r.c0, r.c1, r.c2) for r in c.collect()} == want
    assert sorts(c) == 1  # each more would hold the rows once more


def test_lines_of_a_page_from_one_sort(spark):
    rng = random.Random(9)
    data = []
    for page in range(6):
        x, y = 0.0, 0.0
        for k in range(120):
            x, y = (rng.choice([0.0, 30.0]), y + 12.0) if rng.random() < 0.15 else (x + rng.choice([6.0, 6.0, 6.0, 9.0, 40.0]), y)
            data.append((page, k + 2 * (k > 60), rng.choice([32, 32, 97, 98, 99]), x, y, x + 6, y + rng.choice([0.0, 8.0]), rng.choice([0.0, 8.0])))
    chars = spark.createDataFrame(data, "page int, idx int, cp int, x0 double, y0 double, x1 double, y1 double, size double")
    want = {}
    for c in pagetext.gaps(chars, ["page"]).orderBy("page", "idx").collect():
        if not c.idx:
            last, n, fresh = None, 0, True
        gutter = last and c.cp != 32 and (last[0] < c.idx - 1 or c.gap == "space") and c.x0 - last[1] > 1.5 * (last[2] or 10)
        fresh = fresh or c.gap == "newline" or bool(gutter)
        if c.cp != 32:
            n, fresh, last = n + fresh, False, (c.idx, c.x1, c.size or c.y1 - c.y0)
            want.setdefault((c.page, n), []).append(c)
    got = pagetext.lines(chars, ["page"])
    assert {(r.page, r.line_no): (r.n, r.x0, r.x1, r.y0, r.y1, r.first_cp) for r in got.collect()} == {k: (len(v), min(c.x0 for c in v), max(c.x1 for c in v), min(c.y0 for c in v), max(c.y1 for c in v), v[0].cp) for k, v in want.items()}
    assert sorts(got) == 1


def test_runs_are_cut_by_one_join(spark):
    rng = random.Random(10)
    tiles, sets = [], []
    for b in range(40):
        cuts = sorted(rng.sample(range(1, 60), 6))
        tiles += [(b, s, e, rng.choice(["x", None])) for s, e in zip([0, *cuts], [*cuts, cuts[-1]], strict=True)]  # the last is empty
        ends = sorted(rng.sample(range(60), 4))
        sets += [(b, *ends[:2], "p"), (b, *ends[2:], "q")] if b % 4 else []
    got = runs.split_at(spark.createDataFrame(tiles, "b int, start int, end int, format string"), spark.createDataFrame(sets, "b int, from int, to int, set string"), "b")
    want = []
    for b, s, e, f in tiles:
        mine = [r for r in sets if r[0] == b]
        at = sorted([s, e, *{c for r in mine for c in r[1:3] if s < c < e}])
        want += [(b, i, j, next((r[3] for r in mine if r[1] <= i and j <= r[2]), f)) for i, j in zip(at, at[1:], strict=False)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_numbers_past_four_letters(spark):
    want = {475_254: "zzzz", 475_255: "aaaaa", 12_356_630: "zzzzz", 12_356_631: "aaaaaa", 2_147_483_647: "fxshrxw"}
    got = spark.createDataFrame([(v,) for v in want], "v int").select("v", numbers.format_number(F.col("v"), "loweralpha")).collect()
    assert dict(map(tuple, got)) == want


def test_entities_need_no_semicolon():
    rows = html.parse("<h1>a&amp;&amp</h1><p>&copy x &nosuch &#65 &amp")
    assert [r["text"] for r in rows] == ["a&&", "© x &nosuch A &"]


def test_restart_rules(spark):
    items = spark.createDataFrame([("a", i, lv) for i, lv in enumerate([0, 1, 0, 1, 1])], "flow string, seq int, level int")
    never = numbering.folded_counters(items, ["flow"], ["seq"], "level", [(1, 0), (1, -1)]).orderBy("seq").collect()
    again = numbering.folded_counters(items, ["flow"], ["seq"], "level", [(1, 0), (1, 0)]).orderBy("seq").collect()
    assert [r.counters[1] for r in never] == [0, 1, 1, 2, 3]
    assert [r.counters[1] for r in again if r.level] == [1, 1, 2]


def test_style_inheritance_and_circles(spark):
    s = spark.createDataFrame([(1, None, 10.0, "n"), (2, 1, None, "b"), (3, 2, None, None), (4, 5, None, None), (5, 4, 1.0, None)], "id int, parent int, size double, weight string")
    got = {r.id: (r.size, r.weight) for r in styles.inherited(s, "id", "parent", ["size", "weight"]).collect()}
    assert got[3] == (10.0, "b") and got[4] == (1.0, None)


def test_relay_log(spark):
    none = spark.createDataFrame([], "doc string, upto long, data string")
    new = spark.createDataFrame([("d", f"update{k}", k) for k in range(3)], "doc string, data string, at int")
    empty = spark.createDataFrame([], "doc string, seq long, data string")
    first = log.appended(new, empty, none, ["at"]).select("doc", "seq", "data")
    assert [(r.seq, r.data) for r in first.orderBy("seq").collect()] == [(1, "update0"), (2, "update1"), (3, "update2")]
    assert [r.seq for r in log.after(first, none, 2, 1000).collect()] == [3]
    assert log.after(first, none, 3, 1000).count() == 0
    assert log.after(first, none, 0, 1).count() == 1  # at least one
    snap, rest = log.compacted(first, none)
    assert (snap.first().upto, snap.first().data, rest.count()) == (3, "update0update1update2", 0)
    assert log.after(rest, snap, 1, 1000).first().seq == 3
    assert log.info(rest, snap).count() == 1
    refused, kept = log.compacted(first, none, F.lit(None).cast("string"))
    assert refused.count() == 0 and kept.count() == 3


def test_page_text_blocks(spark):
    rows, idx = [], 0

    def put(words, x, y, size):
        nonlocal idx
        for k, c in enumerate(words):
            rows.append((1, idx, ord(c), x + k * size / 2, float(y), x + (k + 1) * size / 2, float(y + size), float(size)))
            idx += 1

    put("Heading", 72, 72, 20)
    for k in range(3):
        put(f"line {k} of words", 72, 120 + 14 * k, 12)
    put("second block", 72, 220, 12)
    put("its end Tail", 72, 234, 12)
    chars = spark.createDataFrame(rows, "page int, idx int, cp int, x0 double, y0 double, x1 double, y1 double, size double")
    lines = pagetext.lines(chars, ["page"])
    assert lines.count() == 6
    got = pagetext.blocks(lines, ["page"]).orderBy("block_no").collect()
    assert [(b.lines, b.size, b.align, b.x0) for b in got] == [(1, 20.0, 0, 72.0), (3, 12.0, 0, 72.0), (2, 12.0, 0, 72.0)]


def test_graphemes_and_line_breaks():
    family, flags = "👨‍👩‍👧x", "🇯🇵🇺🇸"
    assert segment.grapheme_starts(family)[1] == 18
    assert segment.grapheme_starts(flags) == [0, 8]
    assert 3 in segment.grapheme_starts("café ok") and 4 not in segment.grapheme_starts("café ok")
    b = segment.line_breaks("ab cd-ef $(12.35)")
    assert (b[1], b[3], b[6], b[10], b[14], b[17]) == (0, 1, 1, 0, 0, 2)
    assert segment.line_breaks("a\nb")[2] == 2 and segment.line_breaks("") == [2]


def test_total_fit_is_never_worse_than_first_fit():
    rng = random.Random(5)
    for _ in range(60):
        p = breaking.Paragraph.of(" ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(1, 60))))
        for width in (100, 200, 345):
            breaks, d = breaking.total_fit(p, width)
            assert d == breaking.demerits(p, breaks, width) <= breaking.demerits(p, breaking.first_fit(p, width), width)
            assert breaks[-1] == len(p.boxes)


def test_badness():
    assert breaking.badness(0, 0) == 0 and breaking.badness(5, 5) == 100 and breaking.badness(1, 0) == breaking.WORST
    assert breaking.tex_badness(5, 5) == 100 and breaking.tex_badness(50, 1) == 10_000


def test_pages():
    assert breaking.optimal_pages([10] * 6, 30, [3] * 6)[-1] == 6
    assert breaking.optimal_pages([], 30, []) == []


def test_text_difference(spark):
    d = spark.createDataFrame([("Hello world", "Hello big world"), ("same", "same"), ("", "x"), ("aXb", "ab")], "a string, b string")
    got = d.select(blocks.text_diff(F.col("a"), F.col("b")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [(6, "", "big "), (4, "", ""), (0, "", "x"), (1, "X", "")]


def test_text_import_edges(spark):
    d = spark.createDataFrame([(1, "a\r\nb\rc\n"), (2, ""), (3, None), (4, "﻿x\n\n")], "doc_id int, text string")
    got = {}
    for r in blocks.paragraphs(d).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {1: ["a", "b", "c"], 2: [""], 3: [""], 4: ["x", ""]}


def test_utf16_and_labels(spark):
    assert one(spark, text.utf16_units, "é😀 ") == 4
    assert one(spark, text.reference_label, "  A\n b ") == "a b"
    assert one(spark, text.purified, r"{\ss}-M\"uller, A.") == "smuller  a" or one(spark, text.purified, r"{\ss}-M\"uller, A.").startswith("s")


def test_tracked_changes(spark):
    r = spark.createDataFrame([(1, 0, "Hello", None), (1, 1, ", dear", "insert"), (1, 2, " old", "delete"), (1, 3, " world", None)], "b int, o int, t string, kind string")
    view = lambda v: runs.view_text(r, ["b"], "o", "t", "kind", v).first().text
    assert (view("final"), view("original"), view("inline")) == ("Hello, dear world", "Hello old world", "Hello, dear old world")


def test_bibtex(spark):
    src = '@string{p = "Press"} @comment{no} @Book(a, title = {A {B} C}, publisher = p # "es", month = feb) @article{b, crossref = "A", date = "2001-02", journaltitle = {J}}'
    e = bibtex.entries(spark.createDataFrame([(1, src)], "f int, text string"), "f", "text")
    got = {r.key: (r.type, r.fields) for r in e.collect()}
    assert got["a"] == ("book", {"title": "A {B} C", "publisher": "Presses", "month": "February"})
    assert got["b"][1]["journal"] == "J"
    b = {r.key: r.fields for r in bibtex.crossrefs(e, ["f"]).collect()}["b"]
    assert b["booktitle"] == "A {B} C" and b["publisher"] == "Presses" and "title" not in b
    assert bibtex.names("van der Berg, Jan and Ada {de la} Cruz") == [{"first": "Jan", "von": "van der", "last": "Berg"}, {"first": "Ada {de la}", "von": "", "last": "Cruz"}]


def test_html_blocks():
    rows = html.parse('<head><title>t</title></head><h2 class="title">T</h2><p>a <b>b</b><p>c<br>d &amp; &copy;<ul><li><input type=checkbox checked>x<li>y</ul><table><tr><th>h<tr><td colspan=2>1</table><script>var a="</p>";</script><hr>z')
    assert [(r["role"], r["text"]) for r in rows] == [("title", "T"), ("body", "a b"), ("body", "c\nd & ©"), ("body", "x"), ("body", "y"), ("body", "h"), ("body", "1"), ("rule", ""), ("body", "z")]
    assert rows[1]["marks"] == [{"start": 2, "end": 3, "mark": "bold"}]
    assert rows[3]["task"] == 2 and rows[6]["col_span"] == 2 and rows[5]["header"] is True
    assert html.parse("")[0]["text"] == "" and html.parse("<head><p>x")[0]["text"] == ""


def test_markdown_blocks():
    src = "---\nm: 1\n---\n# H #\n\npara *a* **b** `c` [l](u) [r]\n\n[r]: v\n\n- [x] one\n- two\n  more\n\n1. n\n\n> q\n\n```\ncode\n```\n\n|a|b|\n|-|-|\n|1|2|\n\nset\n===\n***\n"
    rows = markdown.parse(src)
    assert [(r["role"], r["text"]) for r in rows] == [("heading", "H"), ("body", "para a b c l r"), ("body", "one"), ("body", "two more"), ("body", "n"), ("quote", "q"), ("code", "code"), ("body", "a"), ("body", "b"), ("body", "1"), ("body", "2"), ("heading", "set"), ("rule", "")]
    assert [x["href"] for x in rows[1]["links"]] == ["u", "v"] and rows[2]["task"] == 2 and rows[4]["list_kind"] == "decimal"
    assert {m["mark"] for m in rows[1]["marks"]} == {"italic", "bold", "code"}
    for bad in ("", "|", "> " * 200 + "x", "- " * 200, "[a](", "**", "```"):
        assert markdown.parse(bad)


def test_delta_errors(spark):
    raw = ['{"Delta":1,"FormatBase":0,"Formats":[{"Style":1}]}', '{"Delta":2,"FormatBase":1}', '{"Delta":4,"FormatBase":1}']
    d = delta.parsed(spark.createDataFrame([("d", r) for r in raw], "doc string, raw string"), "doc", "raw")
    assert [r.ok for r in delta.checked(d).orderBy("Delta").collect()] == [True, True, False]
