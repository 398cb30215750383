"""Look-ups as joins: blocks, positions, controls, formats, references, and the
orders that readers see. Ranges are joined through an equal key, never crossed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def alive(blocks: DataFrame, refs: DataFrame, id_: str, on: str) -> DataFrame:
    """Each reference with found: whether its block is there and alive."""
    there = blocks.where("alive").select(F.col(id_).alias("_id"))
    return refs.join(there, F.col(on) == F.col("_id"), "left").withColumn("found", F.col("_id").isNotNull()).drop("_id")


def block_info(blocks: DataFrame, id_: str, parent: str) -> DataFrame:
    """Every block with its number of living children."""
    kids = blocks.where("alive").groupBy(F.col(parent).alias("_p")).agg(F.count("*").alias("n"))
    return blocks.join(kids, F.col(id_) == F.col("_p"), "left").withColumn("n_children", F.coalesce("n", F.lit(0))).drop("_p", "n")


def child_at(blocks: DataFrame, refs: DataFrame, parent: str, id_: str, index: str) -> DataFrame:
    """refs (parent, index) with child: the living child at that place, or null."""
    ord_ = F.row_number().over(W.partitionBy(parent).orderBy("ord")) - 1
    kids = blocks.where("alive").select(parent, ord_.alias(index), F.col(id_).alias("child"))
    return refs.join(kids, [parent, index], "left")


def run_texts(paragraphs: DataFrame, text: str, runs: str) -> DataFrame:
    """A row for each run (start, end in bytes) of a paragraph, with its text."""
    r = F.posexplode(runs).alias("run", "r")
    rows = paragraphs.select("*", r)
    piece = F.substr(F.col(text).cast("binary"), F.col("r.start") + 1, F.col("r.end") - F.col("r.start")).cast("string")
    return rows.withColumns({"start": F.col("r.start"), "end": F.col("r.end"), "run_text": piece}).drop("r", runs, text)


def position_valid(text: Column, offset: Column) -> Column:
    """A position is within the text and not inside a character."""
    raw = text.cast("binary")
    inside = F.hex(F.substr(raw, offset + 1, F.lit(1))).rlike("^[89AB]")
    return F.coalesce((offset >= 0) & (offset <= F.octet_length(text)) & ~F.coalesce(inside, F.lit(False)), F.lit(False))


def range_valid(text: Column, start: Column, end: Column) -> Column:
    return position_valid(text, start) & position_valid(text, end) & (start <= end)


def control_ranges(marks: DataFrame, flow: list[str], order: str) -> DataFrame:
    """Opens (step 1) and closes (step -1) of nested controls to ranges (id, depth, from,
    to): the n-th open of a depth ends at the n-th close of it. Controls that are
    never closed have a null end."""
    upto = W.partitionBy(*flow).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    deep = marks.withColumn("depth", F.sum("step").over(upto) + F.when(F.col("step") < 0, 1).otherwise(0))
    nth = deep.withColumn("nth", F.row_number().over(W.partitionBy(*flow, "depth", "step").orderBy(order)))
    keys = [*flow, "depth", "nth"]
    opens = nth.where("step > 0").select(*keys, "id", F.col(order).alias("from"))
    return opens.join(nth.where("step < 0").select(*keys, F.col(order).alias("to")), keys, "left").drop("nth")


def control_at(marks: DataFrame, positions: DataFrame, flow: list[str], order: str) -> DataFrame:
    """positions (flow, order, pos) with control: the innermost control that is open
    there. Its depth is the running sum of steps, and the control is the last one opened
    at that depth: two windows, no range join."""
    rows = marks.select(*flow, order, "step", "id", F.lit(None).cast("long").alias("pos")).unionByName(positions.select(*flow, order, F.lit(0).alias("step"), F.lit(None).cast(marks.schema["id"].dataType).alias("id"), F.col("pos").cast("long")))
    at = [order, F.col("pos").isNotNull()]  # marks first
    depth = F.sum("step").over(W.partitionBy(*flow).orderBy(*at).rowsBetween(W.unboundedPreceding, 0))
    deep = rows.withColumn("_depth", depth)
    last = F.last(F.when(F.col("step") > 0, F.col("id")), True).over(W.partitionBy(*flow, "_depth").orderBy(*at).rowsBetween(W.unboundedPreceding, 0))
    return deep.withColumn("control", F.when(F.col("_depth") > 0, last)).where("pos is not null").select(*flow, order, "pos", "control")


def masked(base: list[str], over: list[str], mask: Column) -> list[Column]:
    """Fields of over whose bit of the mask is set, and of base elsewhere."""
    return [F.when(F.shiftright(mask, k).bitwiseAND(F.lit(1)) == 1, F.col(o)).otherwise(F.col(b)).alias(b) for k, (b, o) in enumerate(zip(base, over, strict=True))]


def nearest(points: DataFrame, places: DataFrame, by: list[str], x: str, id_: str) -> DataFrame:
    """Each point with the place of its key that is nearest along x, the lesser id among
    equally near ones. The last place before in a sort of both, and in the reverse sort
    the last one after: a frame that ends at the end of its group is made anew, in the
    square of the group, for every row."""
    here = F.struct(F.col(x).alias("x"), F.col(id_).alias("id"))
    at = places.groupBy(*by, x).agg(F.min(id_).alias(id_)).select(*by, F.col(x), F.lit(0).alias("kind"), here.alias("place"), F.lit(None).cast("long").alias("point"))
    rows = at.unionByName(points.select(*by, F.col(x), F.lit(1).alias("kind"), F.lit(None).cast(at.schema["place"].dataType).alias("place"), F.col("point").cast("long")))
    back = W.partitionBy(*by).orderBy(x, "kind").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*by).orderBy(F.desc(x), F.desc("kind")).rowsBetween(W.unboundedPreceding, 0)
    both = rows.withColumns({"_b": F.last("place", True).over(back), "_a": F.last("place", True).over(ahead)}).where("kind = 1")
    left, right = F.col(x) - F.col("_b.x"), F.col("_a.x") - F.col(x)
    takes_left = F.col("_a").isNull() | (left < right) | ((left == right) & (F.col("_b.id") <= F.col("_a.id")))
    return both.select(*by, "point", F.when(F.col("_b").isNotNull() & takes_left, F.col("_b.id")).otherwise(F.col("_a.id")).alias(id_))


def topmost_at(boxes: DataFrame, points: DataFrame, page: str, cell: float) -> DataFrame:
    """points (page, point, x, y) with box: the last of the boxes (page, idx, x0, y0, x1,
    y1) that hold the point. Boxes are keyed by the cells of a grid that they touch, and
    cut to them. Of equal parts of a cell the last box counts, and none that lies below
    one that fills the cell; so a place meets few boxes however many lie over it."""
    def span(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))

    at = [page, "cx", "cy"]
    left, top = F.col("cx") * cell, F.col("cy") * cell
    whole = boxes.where("x0 <= x1 and y0 <= y1").groupBy(page, "x0", "y0", "x1", "y1").agg(F.max("idx").alias("idx"))
    keyed = whole.select("*", span("x0", "x1").alias("cx")).select("*", span("y0", "y1").alias("cy"))
    cut = keyed.select(*at, "idx", F.greatest("x0", left).alias("x0"), F.greatest("y0", top).alias("y0"), F.least("x1", left + cell).alias("x1"), F.least("y1", top + cell).alias("y1"))
    parts = cut.groupBy(*at, "x0", "y0", "x1", "y1").agg(F.max("idx").alias("idx"))
    fills = (F.col("x0") <= left) & (F.col("y0") <= top) & (F.col("x1") >= left + cell) & (F.col("y1") >= top + cell)
    seen = parts.withColumn("_fill", F.max(F.when(fills, F.col("idx"))).over(W.partitionBy(*at))).where("_fill is null or idx >= _fill").drop("_fill")
    asked = points.select(page, "x", "y").distinct().withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    hit = asked.join(seen, at).where("x between x0 and x1 and y between y0 and y1").groupBy(page, "x", "y").agg(F.max("idx").alias("box"))
    return points.join(hit, [page, "x", "y"], "left").select(page, "point", "box")


def resolved_format(runs: DataFrame, formats: DataFrame, styles: DataFrame, theme: dict, props: list[str]) -> DataFrame:
    """run -> format -> style -> theme: of each property the first that is set. formats
    (format, style, props), styles (style, props, resolved along their chains)."""
    f = formats.select("format", "style", *[F.col(p).alias(f"_f_{p}") for p in props])
    s = styles.select("style", *[F.col(p).alias(f"_s_{p}") for p in props])
    both = runs.join(f, "format", "left").join(s, "style", "left")
    return both.select(*runs.columns, *[F.coalesce(f"_f_{p}", f"_s_{p}", F.lit(theme.get(p))).alias(p) for p in props])


def page_of(refs: DataFrame, placed: DataFrame, on: str, page: str) -> DataFrame:
    """Page references: the first page that the target stands on, or ??."""
    first = placed.groupBy(on).agg(F.min(page).alias("_page"))
    return refs.join(first, on, "left").withColumn("page_ref", F.coalesce(F.col("_page").cast("string"), F.lit("??"))).drop("_page")


def by_key(cites: DataFrame, entries: DataFrame, key: str, id_: str) -> DataFrame:
    """Citations with the entry whose key is theirs, or else is theirs but for case; the
    first entry in file order wins either way."""
    exact = entries.groupBy(key).agg(F.min(id_).alias("_exact"))
    low = entries.groupBy(F.lower(key).alias("_low")).agg(F.min(id_).alias("_any"))
    both = cites.join(exact, key, "left").join(low, F.lower(key) == F.col("_low"), "left")
    return both.withColumn(id_, F.coalesce("_exact", "_any")).drop("_exact", "_any", "_low")


def by_language(tags: DataFrame, table: DataFrame, tag: str, prefix: str, value: str) -> DataFrame:
    """The value of the longest prefix of a language tag, whatever its case: a prefix ends
    where the tag does or at - or _; the empty prefix fits all; the first of equal
    prefixes wins. A tag has few such prefixes, so they are made and joined as equals."""
    low = F.lower(F.col(tag))
    ends = F.filter(F.sequence(F.lit(0), F.length(low)), lambda k: (k == 0) | (k == F.length(low)) | F.substr(low, k + 1, F.lit(1)).isin("-", "_"))
    made = tags.select(tag, F.explode(F.array_distinct(F.transform(ends, lambda k: F.substr(low, F.lit(1), k)))).alias("_p")).distinct()
    first = table.groupBy(F.lower(prefix).alias("_p")).agg(F.min_by(value, "ord").alias(value))
    best = made.join(first, "_p").groupBy(tag).agg(F.max_by(value, F.length("_p")).alias(value))
    return tags.join(best, tag, "left")


def by_family(uses: DataFrame, fonts: DataFrame, family: str, value: str) -> DataFrame:
    """The font table's entry for a family, ignoring case; the first wins."""
    first = fonts.groupBy(F.lower(family).alias("_f")).agg(F.min_by(value, "ord").alias(value))
    return uses.join(first, F.lower(family) == F.col("_f"), "left").drop("_f")


def outline(items: DataFrame, doc: str, id_: str, parent: str, ord_: str, title: str, depth: int = 64) -> DataFrame:
    """A tree of bookmarks flattened depth first: (doc, no, level, id, title). Deeper than
    depth is cut, which ends loops. One join a level."""
    base = items.select(doc, id_, parent, F.col(ord_).alias("_o"), title)
    level = base.where(F.col(parent).isNull()).select(doc, id_, title, F.array("_o").alias("path"))
    out, n = level, 1
    while n < depth:
        up = level.select(F.col(doc).alias("_d"), F.col(id_).alias("_id"), "path")
        level = base.join(up, (F.col(doc) == F.col("_d")) & (F.col(parent) == F.col("_id"))).select(doc, id_, title, F.concat("path", F.array("_o")).alias("path"))
        n += 1
        if level.isEmpty():
            break
        out = out.unionByName(level)
    no = F.row_number().over(W.partitionBy(doc).orderBy("path"))
    return out.select(doc, no.alias("no"), F.size("path").alias("level"), id_, title)


def unused(formats: DataFrame, runs: DataFrame, on: str) -> DataFrame:
    """Formats that no run has: left out when a document is saved."""
    return formats.join(runs.select(on), on, "left_anti")


def before(path_a: Column, off_a: Column, path_b: Column, off_b: Column) -> Column:
    """Document order of two positions: -1, 0 or 1, by path and then by offset; a block
    stands before what is inside it."""
    a, b = F.struct(path_a.alias("p"), off_a.alias("o")), F.struct(path_b.alias("p"), off_b.alias("o"))
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def cited_order(cites: DataFrame, entries: DataFrame, doc: str, key: str, order: str, all_: Column, chunk: int = 1024) -> DataFrame:
    """Entries as a document lists them: cited ones by their first citation, each once,
    then, where all are asked for, the others in file order (file_ord).

    A document that asks for all lists the whole file: that many rows are its result, but
    they are never sorted or dealt out. The file's entries are ranked once. Between two
    cited ones of a document lies a stretch of ranks, whose numbers follow from how many
    cited ones stand before it; stretches are cut at chunks of the file and met there."""
    first = cites.groupBy(doc, key).agg(F.min(order).alias("_at"))
    known = entries.select(key, "file_ord")
    listed = first.join(known, key).select(doc, key, F.row_number().over(W.partitionBy(doc).orderBy("_at", "file_ord")).alias("no"))

    file = ranked(known, ["file_ord", key], "_r").select(key, (F.col("_r") - 1).alias("_r"))
    docs = cites.where(all_).select(doc).distinct()
    had = cites.select(doc, key).join(docs, doc, "left_semi").distinct().join(file, key).select(doc, "_r")
    by = W.partitionBy(doc)
    # tasks whatever the stretches' bytes, as they are few and their rows many
    size, tasks = entries.count(), max(64, 4 * cites.sparkSession.sparkContext.defaultParallelism)
    chunk = max(1, min(chunk, size // (4 * tasks)))
    ends = had.unionByName(docs.select(doc, F.lit(-1).cast("long").alias("_r")))  # before the first entry
    seen = F.row_number().over(by.orderBy("_r")) - 1
    gaps = ends.select(doc, (F.col("_r") + 1).alias("_from"), F.coalesce(F.lead("_r").over(by.orderBy("_r")), F.lit(size)).alias("_to"), (F.count("*").over(by) - 1 - seen).alias("_shift"))
    gaps = gaps.where("_from < _to").select("*", F.explode(F.sequence(F.floor(F.col("_from") / chunk), F.floor((F.col("_to") - 1) / chunk))).alias("_chunk"))
    gaps = gaps.repartition(tasks, "_chunk")
    chunks = file.groupBy(F.floor(F.col("_r") / chunk).alias("_chunk")).agg(F.array_sort(F.collect_list(F.struct("_r", key))).alias("_e"))
    lo, start = F.greatest(F.col("_from"), F.col("_chunk") * chunk), F.col("_chunk") * chunk
    keys = F.slice(F.col(f"_e.{key}"), (lo - start + 1).cast("int"), (F.least(F.col("_to"), start + chunk) - lo).cast("int"))
    rest = gaps.join(chunks, "_chunk").select(doc, (lo + F.col("_shift") + 1).alias("_no"), F.posexplode(keys).alias("_i", key))
    return listed.unionByName(rest.select(doc, key, (F.col("_no") + F.col("_i")).cast("int").alias("no")))


def top_down(marks: DataFrame, page: str) -> DataFrame:
    """Marks of a page numbered top to bottom, left to right."""
    return marks.withColumn("no", F.row_number().over(W.partitionBy(page).orderBy("y", "x", "id")))


def capacity(rows: DataFrame, by: list[str], order: list[str], room: Column) -> DataFrame:
    """The rows that a buffer has room for, in order, with needed (how many there are) and
    fits: a caller whose buffer is too small learns the size that it needs."""
    n = F.count("*").over(W.partitionBy(*by))
    k = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumns({"needed": n, "_k": k}).where(F.col("_k") <= room).withColumn("fits", F.col("needed") <= room).drop("_k")


def missing_updates(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """What I have that they lack: updates (doc, client, clock) beyond the clocks of their
    state vector (doc, client, upto)."""
    both = mine.join(theirs, ["doc", "client"], "left")
    return both.where(F.col("clock") > F.coalesce("upto", F.lit(0))).drop("upto")


def shared_children(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Child lists of a shared tree made sound: entries (parent, at, child) whose child is
    missing or itself go, a child listed twice stays where it comes first, and of two
    parents it stays with the lesser."""
    there = entries.join(nodes.select("child"), "child", "left_semi").where("child <> parent")
    one = there.groupBy("child").agg(F.min(F.struct("parent", "at")).alias("p"))
    return one.select(F.col("p.parent").alias("parent"), F.col("p.at").alias("at"), "child")


def kept_children(before: Column, after: Column) -> Column:
    """Children that an edit of a list leaves in place: the length of the longest
    increasing run of old places (tails of increasing runs, each the least it can be)."""
    places = F.filter(F.transform(after, lambda c: F.array_position(before, c)), lambda p: p > 0)
    none = F.filter(F.array(F.lit(0).cast("long")), lambda x: F.lit(False))

    def put(tails: Column, p: Column) -> Column:
        k = F.size(F.filter(tails, lambda t: t < p))
        return F.concat(F.slice(tails, F.lit(1), k), F.array(p), F.slice(tails, k + 2, F.greatest(F.size(tails) - k - 1, F.lit(0))))

    return F.size(F.aggregate(places, none, put))


def undone_state(ops: DataFrame, block: str, serial: str, value: str, undone: Column) -> DataFrame:
    """The state after undo: of each block its latest change that isn't undone. A redo
    clears the mark and so brings the change back."""
    return ops.where(~undone).groupBy(block).agg(F.max_by(value, serial).alias(value))


def own_undo(ops: DataFrame, block: str, client: str, serial: str, steps: int) -> DataFrame:
    """Marks (undone) the last steps of each client's own changes to a block; what others
    did stays."""
    k = F.row_number().over(W.partitionBy(block, client).orderBy(F.col(serial).desc()))
    return ops.withColumn("undone", k <= steps)


def changes(ops: DataFrame, by: list[str], kind: str, at: str) -> DataFrame:
    """The change feed: each kind of change of an operation is told once, at its first."""
    return ops.groupBy(*by, kind).agg(F.min(at).alias(at))


def fingerprint(rows: DataFrame, doc: list[str], line: Column) -> DataFrame:
    """A digest of a document's state that doesn't depend on the order of its rows."""
    lines = rows.groupBy(*doc).agg(F.sort_array(F.collect_list(line)).alias("l"))
    return lines.select(*doc, F.sha2(F.array_join("l", "\n"), 256).alias("fingerprint"))


def bag_overlap(a: DataFrame, b: DataFrame, doc: list[str], word: str) -> DataFrame:
    """Share of the words of two versions that both have, as bags: shared over the larger."""
    count = lambda df, n: df.groupBy(*doc, word).agg(F.count("*").alias(n))
    both = count(a, "n").join(count(b, "m"), [*doc, word], "full_outer").fillna(0, ["n", "m"])
    sums = both.groupBy(*doc).agg(F.sum(F.least("n", "m")).alias("s"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    return sums.select(*doc, F.col("s").alias("shared"), (F.col("s") / F.greatest("n", "m")).alias("overlap"))


def stretch_stats(lines: DataFrame, by: list[str], r: str) -> DataFrame:
    """Of lines' stretch: mean size, greatest, and how many are beyond 1."""
    return lines.groupBy(*by).agg(F.avg(F.abs(r)).alias("mean_abs"), F.max(r).alias("max_r"), F.count_if(F.col(r) > 1).alias("beyond"))


def ranked(rows: DataFrame, order: list[str], as_: str, parts: int = 64, sample: int = 4096) -> DataFrame:
    """A number for every row in one order of all, without one task that sorts them all:
    ranges from a bounded sample, rows numbered within each, and the counts of the
    ranges before. Any bounds give the same numbers. order is a total one. A row's
    range is found by halving, in the JVM's compiled code: within a lambda its order
    would be made anew for every bound."""
    got = rows.select(*order).orderBy(F.xxhash64(*order)).limit(sample).collect()
    got = sorted((tuple(r) for r in got), key=lambda r: [(v is not None, v) for v in r])
    kinds = dict(rows.dtypes)
    cuts = list(dict.fromkeys(got[k * len(got) // parts] for k in range(1, parts))) if len(got) > parts else []
    key = F.struct(*order)

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        bound = F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, cuts[mid], strict=True)])
        return F.when(bound <= key, place(mid + 1, hi)).otherwise(place(lo, mid))

    cut = rows.withColumn("_part", place(0, len(cuts)))
    sizes = dict(cut.groupBy("_part").count().collect())  # parts rows at most
    before, passed = [], 0
    for k in range(len(cuts) + 1):
        before.append(passed)
        passed += sizes.get(k, 0)
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return cut.withColumn(as_, own + F.get(F.array(*[F.lit(n).cast("long") for n in before]), F.col("_part"))).drop("_part")


def prefix_sums(boxes: DataFrame, by: list[str], order: str, width: Column) -> DataFrame:
    """Adds x: the widths of all boxes before one."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return boxes.withColumn("x", F.coalesce(F.sum(width).over(w), F.lit(0)))


def category_count(points: DataFrame, categories: DataFrame, chart: str, series: str) -> DataFrame:
    """Of each chart the categories there are to show: as many as are named, or as its
    longest series has points."""
    longest = points.groupBy(chart, series).agg(F.count("*").alias("n")).groupBy(chart).agg(F.max("n").alias("n"))
    named = categories.groupBy(chart).agg(F.count("*").alias("m"))
    both = longest.join(named, chart, "full_outer")
    return both.select(chart, F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))).alias("categories"))


def kind_counts(rows: DataFrame, doc: str, kind: str, kinds: list[str]) -> DataFrame:
    """How many of each kind a document has: one partial aggregate."""
    return rows.groupBy(doc).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def note_bodies(links: DataFrame, notes: DataFrame, href: str, id_: str, body: str) -> DataFrame:
    """Links to a note (#id) with the note's body; the first note of an id."""
    first = notes.groupBy(id_).agg(F.min_by(body, "ord").alias(body))
    target = F.when(F.col(href).startswith("#"), F.substr(F.col(href), F.lit(2)))
    return links.join(first, target == F.col(id_), "left").drop(id_)


def by_label(refs: DataFrame, definitions: DataFrame, label: Column, defined: Column, target: str) -> DataFrame:
    """References with the target of the first definition whose label is theirs, both as
    labels are compared (functions.text.reference_label)."""
    first = definitions.groupBy(defined.alias("_label")).agg(F.min_by(target, "ord").alias("target"))
    return refs.join(first, label == F.col("_label"), "left").drop("_label")


def bibliography_latex(items: DataFrame, doc: str, order: str, key: str, text: Column) -> DataFrame:
    """A thebibliography environment of each document's items in order; its argument is
    as wide as the last number."""
    item = F.concat(F.lit("\\bibitem{"), F.col(key), F.lit("} "), text, F.lit("\n"))
    rows = items.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("t")))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: x["t"]), "")
    return rows.select(doc, F.concat(F.lit("\\begin{thebibliography}{"), F.size("r").cast("string"), F.lit("}\n"), body, F.lit("\\end{thebibliography}\n")).alias("latex"))


def next_mark(positions: DataFrame, marks: DataFrame, by: str) -> DataFrame:
    """positions (by, pos) with the marks (by, start) next after and last before them: two
    sorts of both and a window over each (a frame to the end would be quadratic)."""
    rows = positions.select(by, "pos", F.lit(None).cast("long").alias("start"), F.col("pos").alias("_at")).unionByName(marks.select(by, F.lit(None).cast("long").alias("pos"), F.col("start").cast("long"), F.col("start").alias("_at")))
    ahead, behind = (W.partitionBy(by).orderBy(at).rangeBetween(W.unboundedPreceding, -1) for at in (F.desc("_at"), F.asc("_at")))
    both = rows.withColumns({"next_start": F.min("start").over(ahead), "prev_start": F.max("start").over(behind)})
    return both.where("pos is not null").select(by, "pos", "next_start", "prev_start")
