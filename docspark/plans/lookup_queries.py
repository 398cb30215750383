"""Queries of look-ups, orders, sets and scalar values over the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import edits, lookups
from .common import table


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as blocks under their customers."""
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority", n.alias("ord"), (F.col("o_orderstatus") != "P").alias("alive"))


def block_by_id(spark: SparkSession, d: str) -> DataFrame:
    return lookups.alive(_orders(spark, d), table(spark, d, "part").select("p_partkey"), "o_orderkey", "p_partkey")


def block_info(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d).select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("parent"), "alive")
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("root").alias("parent"), F.lit(True).alias("alive"))
    return lookups.block_info(o.unionByName(c), "id", "parent")


def child_at(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 4).cast("int").alias("at"))
    return lookups.child_at(_orders(spark, d), refs, "o_custkey", "o_orderkey", "at")


def run_texts(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.octet_length(F.substring("text", 1, 7)), F.octet_length("text")
    runs = F.array(F.struct(F.lit(0).alias("start"), k.alias("end")), F.struct(k.alias("start"), n.alias("end")))
    return lookups.run_texts(table(spark, d, "conversations").select("conv_id", "turn", "text", runs.alias("runs")), "text", "runs").select("conv_id", "turn", "run", "run_text")


def position_validity(spark: SparkSession, d: str) -> DataFrame:
    o = (F.col("doc_id") % 50).cast("int")
    return table(spark, d, "documents").select("doc_id", lookups.position_valid(F.col("text"), o).alias("valid"), lookups.range_valid(F.col("text"), o, o + 10).alias("range_ok"))


def control_at(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    marks = o.select("o_custkey", F.col("o_orderkey").alias("at"), F.when(F.col("ord") % 4 < 2, 1).otherwise(-1).alias("step"), F.col("o_orderkey").alias("id"))
    asked = o.select("o_custkey", F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("pos"))
    return lookups.control_at(marks, asked, ["o_custkey"], "at").select("pos", "control")


def control_ranges(spark: SparkSession, d: str) -> DataFrame:
    marks = _orders(spark, d).select("o_custkey", F.col("o_orderkey").alias("at"), F.when(F.col("ord") % 4 < 2, 1).otherwise(-1).alias("step"), F.col("o_orderkey").alias("id"))
    return lookups.control_ranges(marks, ["o_custkey"], "at").select("id", "depth", "from", "to")


def masked_props(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"), (F.col("p_size") % 4).cast("int").alias("mask"))
    return p.select("p_partkey", *lookups.masked(["p_name", "p_brand"], ["p_type", "p_size"], F.col("mask")))


def nearest_place(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "customer").select(F.col("c_nationkey").alias("page"), F.col("c_acctbal").alias("x"), F.col("c_custkey").alias("point"))
    places = table(spark, d, "supplier").select(F.col("s_nationkey").alias("page"), F.col("s_acctbal").alias("x"), "s_suppkey")
    return lookups.nearest(points, places, ["page"], "x", "s_suppkey").select("point", "s_suppkey")


def topmost_box(spark: SparkSession, d: str) -> DataFrame:
    y = lambda c: F.floor(F.abs(F.col(c))) % 60
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("page"), F.col("s_suppkey").alias("idx"), (F.col("s_suppkey") % 50).alias("x0"), y("s_acctbal").alias("y0"))
    points = table(spark, d, "customer").select(F.col("c_nationkey").alias("page"), F.col("c_custkey").alias("point"), (F.col("c_custkey") % 70).alias("x"), y("c_acctbal").alias("y"))
    return lookups.topmost_at(s.withColumns({"x1": F.col("x0") + 20, "y1": F.col("y0") + 30}), points, "page", 16.0)


def resolved_format(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("format"))
    p = table(spark, d, "part")
    formats = p.select(F.col("p_partkey").alias("format"), F.col("p_size").alias("style"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("font"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey")).alias("size"))
    s = p.select(F.col("p_size").alias("style")).distinct()
    styles = s.select("style", F.when(F.col("style") % 2 == 0, F.concat(F.lit("S"), "style")).alias("font"), F.when(F.col("style") % 3 == 0, F.col("style").cast("long")).alias("size"))
    return lookups.resolved_format(runs, formats, styles, {"font": "Body", "size": 11}, ["font", "size"])


def page_references(spark: SparkSession, d: str) -> DataFrame:
    placed = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.floor(F.col("o_orderkey") / 100).alias("page"))
    return lookups.page_of(table(spark, d, "customer").select("c_custkey"), placed, "c_custkey", "page")


def citation_lookup(spark: SparkSession, d: str) -> DataFrame:
    k = F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 120).cast("string"), 9, "0"))
    cites = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.upper(k)).when(F.col("c_custkey") % 3 == 1, k).otherwise(F.lower(k)).alias("s_name"))
    return lookups.by_key(cites, table(spark, d, "supplier").select("s_name", "s_suppkey"), "s_name", "s_suppkey").select("c_custkey", "s_suppkey")


TAGS = ["en", "en-GB", "EN_us-x", "de", "de-AT-1996", "fr", "enx", "EN-gb-oed"]
PREFIXES = [("", 0, "any"), ("en", 1, "english"), ("en-GB", 2, "british"), ("de", 3, "german"), ("DE-at", 4, "austrian"), ("EN", 5, "late")]


def language_prefix(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "customer").select("c_custkey", F.get(F.array(*map(F.lit, TAGS)), (F.col("c_custkey") % 8).cast("int")).alias("tag"))
    return lookups.by_language(tags, spark.createDataFrame(PREFIXES, "prefix string, ord int, face string"), "tag", "prefix", "face").select("c_custkey", "face")


def font_table(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    uses = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("used"))
    fonts = p.select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("face"))
    return lookups.by_family(uses.withColumnRenamed("used", "family"), fonts, "family", "face").select("p_partkey", "face")


def outline_flat(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("doc"), F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("o"), F.col("r_name").alias("title"))
    n = table(spark, d, "nation")
    rows = n.select(F.col("n_regionkey").alias("doc"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_nationkey").cast("long").alias("o"), F.col("n_name").alias("title"))
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    kids = c.select(F.col("n_regionkey").alias("doc"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "n_nationkey").alias("parent"), F.col("c_custkey").cast("long").alias("o"), F.col("c_name").alias("title"))
    return lookups.outline(r.unionByName(rows).unionByName(kids), "doc", "id", "parent", "o", "title")


def unused_formats(spark: SparkSession, d: str) -> DataFrame:
    return lookups.unused(table(spark, d, "part").select("p_partkey"), table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


def document_order(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    a, b = F.array(F.col("l_linenumber").cast("int"), q), F.when(q % 2 == 0, F.array(F.lit(4), F.lit(25))).otherwise(F.array(F.col("l_linenumber").cast("int")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", lookups.before(a, F.lit(3), b, q % 5).alias("cmp"))


def cited_order(spark: SparkSession, d: str) -> DataFrame:
    cites = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")).alias("at"))
    entries = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_partkey").alias("file_ord"))
    return lookups.cited_order(cites, entries, "l_suppkey", "l_partkey", "at", F.col("l_suppkey") % 50 == 0)


def marks_top_down(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("page"), F.floor("c_acctbal").alias("y"), (F.col("c_custkey") % 10).alias("x"), F.col("c_custkey").alias("id"))
    return lookups.top_down(c, "page").select("id", "no")


def capacity_limit(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return lookups.capacity(o, ["o_custkey"], ["o_orderkey"], F.lit(9))


def state_difference(spark: SparkSession, d: str) -> DataFrame:
    clock = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("event_id"))
    mine = table(spark, d, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("client"), clock.alias("clock"), "event_id")
    theirs = table(spark, d, "events").where("event_type <> 'click'").groupBy(F.col("user_id").alias("doc"), F.col("event_type").alias("client")).agg(F.floor(F.count("*") / 2).alias("upto"))
    return lookups.missing_updates(mine, theirs)


def shared_children(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("parent"), F.col("l_orderkey").alias("at"), F.col("l_partkey").alias("child"))
    return lookups.shared_children(entries, table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("child")))


def children_kept(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("before"), F.sort_array(F.collect_list(F.struct("o_totalprice", "o_orderkey"))).alias("after"))
    return o.select("o_custkey", F.size("before").alias("n"), lookups.kept_children(F.col("before"), F.col("after.o_orderkey")).alias("kept"))


def undo_state(spark: SparkSession, d: str) -> DataFrame:
    return lookups.undone_state(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderkey") % 5 == 0)


def own_undo(spark: SparkSession, d: str) -> DataFrame:
    return lookups.own_undo(table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), "o_custkey", "o_orderpriority", "o_orderkey", 1).select("o_orderkey", "undone")


def change_feed(spark: SparkSession, d: str) -> DataFrame:
    return lookups.changes(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


def state_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return lookups.fingerprint(table(spark, d, "orders"), ["o_custkey"], F.concat_ws("=", "o_orderkey", "o_orderstatus"))


def bag_overlap(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("word"))
    got = lookups.bag_overlap(words.where("turn = 0"), words.where("turn = 1"), ["conv_id"], "word")
    return got.withColumn("overlap", F.round("overlap", 6))


def stretch_stats(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") / 32 - 1).alias("r"))
    return lookups.stretch_stats(r, ["l_returnflag"], "r").withColumn("mean_abs", F.round("mean_abs", 6))


def prefix_sums(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("at", "word"))
    return lookups.prefix_sums(words, ["conv_id", "turn"], "at", F.length("word") * 10 + 5).select("conv_id", "turn", "at", "x")


def category_count(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag")
    return lookups.category_count(points, table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity").distinct(), "l_suppkey", "l_returnflag")


def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return lookups.kind_counts(table(spark, d, "events"), "user_id", "event_type", ["click", "error", "view"])


def note_bodies(spark: SparkSession, d: str) -> DataFrame:
    href = F.concat(F.when(F.col("c_custkey") % 7 == 0, "x").otherwise("#"), F.lit("s"), F.col("c_custkey") % 130)
    notes = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("body"))
    return lookups.note_bodies(table(spark, d, "customer").select("c_custkey", href.alias("href")), notes, "href", "id", "body")


def link_references(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_partkey").alias("ord"))
    label = text.reference_label(F.concat(F.lit("  "), F.upper(F.replace("p_name", F.lit(" "), F.lit(" \t"))), F.lit(" ")))
    return lookups.by_label(p.select("p_partkey", "p_name"), p, label, text.reference_label(F.col("p_name")), "p_partkey").select("p_partkey", "target")


def bibliography_latex(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_regionkey", "n_name", F.concat(F.lit("n"), "n_nationkey").alias("key"))
    return lookups.bibliography_latex(n, "n_regionkey", "n_name", "key", text.latex_escaped(F.concat("n_name", F.lit(" & co"))))


def block_moves(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    return edits.renumbered(o, ["o_custkey"], [(F.col("ord") % 3 == 2).desc(), F.col("ord")]).select("o_orderkey", "ord")


def _v() -> Column:
    return F.col("p_partkey") * 7919 % 16_777_216


def css_values(spark: SparkSession, d: str) -> DataFrame:
    v, k = _v(), F.col("p_partkey") % 4
    short = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(v % 4096)), 3, "0"))
    rgb = F.format_string("rgb(%d, %d,%d)", F.floor(v / 65_536), F.floor(v / 256) % 256, v % 256)
    colour = F.when(k == 0, F.concat(F.lit("#"), F.lpad(F.hex(v), 6, "0"))).when(k == 1, short).when(k == 2, rgb).otherwise(F.when(F.col("p_size") % 2 == 0, " Navy ").otherwise("none"))
    unit = F.get(F.array(*[F.lit(u) for u in ("pt", "px", "in", "cm", "em", "%", "", "foo")]), (F.col("p_partkey") % 8).cast("int"))
    style = F.concat(F.lit("color: red; FONT-Size: 3pt;font-size : "), F.col("p_size"), F.lit("pt !Important"))
    return table(spark, d, "part").select("p_partkey", values.css_colour(colour).alias("colour"), F.round(values.css_length(F.concat("p_size", unit)), 6).alias("points"), values.css_property(style, "font-size").alias("size"))


def heading_ids(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("  { #p"), "p_partkey", F.lit(" .c k=v} "))))
    return table(spark, d, "part").select("p_partkey", values.heading_id(line).alias("x")).select("p_partkey", "x.text", "x.id")


def pdf_strings(spark: SparkSession, d: str) -> DataFrame:
    t = F.substring("text", 1, 400)
    return table(spark, d, "documents").select("doc_id", values.pdf_text(values.pdf_encoded(t)).alias("text"), values.pdf_text(F.unhex(F.lit("41E980A018"))).alias("own"))


def pdf_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", values.pdf_date(F.col("o_orderdate").cast("timestamp")).alias("stamp"))


def date_fields(spark: SparkSession, d: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ("DATE", "CREATEDATE", "SAVEDATE", "PRINTDATE"))), (F.col("o_orderkey") % 4).cast("int"))
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", values.date_field(kind, at, F.date_add(at, 1).cast("timestamp"), F.lit(None).cast("timestamp"), F.lit("2024-05-06 00:00:00").cast("timestamp")).alias("shown"))


def text_decode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.posexplode(values.decoded(F.col("text"))).alias("i", "c")).select("item_id", "i", "c.cp", "c.off")


def byte_sums(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", values.adler32(F.col("text")).alias("adler"), values.fnv1a(F.col("text")).alias("fnv"))


def whole_numbers(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("p_partkey") * 7919
    return table(spark, d, "part").select("p_partkey", values.whole_root(v).alias("root"), values.scaled(v - 3_000_000, F.lit(3), F.lit(7)).alias("scaled"))


def json_values(spark: SparkSession, d: str) -> DataFrame:
    json = F.to_json(F.struct("p_name", F.array("p_size", "p_partkey").alias("a")))
    p = table(spark, d, "part").select("p_partkey", json.alias("j"), F.array(F.array("p_partkey", "p_size"), F.array(F.col("p_size"))).alias("m"))
    j = F.col("j")
    return p.select("p_partkey", values.json_at(j, "p_name").alias("name"), values.int_or(values.json_at(j, "a", 1), -1).alias("second"), values.int_or(values.json_at(j, "a", 9), -1).alias("beyond"), values.int_or(values.json_at(j, "p_name"), -2).alias("word"), values.matrix_json(F.col("m")).alias("matrix"))


def json_strings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", values.json_string(F.concat("text", F.lit(' "q\\'), F.lit("\t\n"))).alias("json"))


def binary_numbers(spark: SparkSession, d: str) -> DataFrame:
    v = (F.col("p_partkey") - 700) * F.pow(F.lit(2.0), (F.col("p_size") % 40).cast("double")).cast("long")
    coded = table(spark, d, "part").select("p_partkey", v.alias("v"), values.bj_int(v).alias("raw"), values.half_float((F.col("p_partkey") * 31 % 63_488).cast("int")).alias("half"))
    return coded.select("p_partkey", F.substring("raw", 1, 1).cast("string").alias("marker"), F.octet_length("raw").alias("size"), values.bj_value(F.col("raw")).alias("back"), F.hex(F.substring("raw", 2, 1)).alias("low"), F.when(F.isnan("half") | (F.abs("half") > 65_504), None).otherwise(F.col("half")).alias("half"))


QUERIES = {f.__name__: f for f in (block_by_id, block_info, child_at, run_texts, position_validity, control_at, control_ranges, masked_props, nearest_place, topmost_box, resolved_format, page_references, citation_lookup, language_prefix, font_table, outline_flat, unused_formats, document_order, cited_order, marks_top_down, capacity_limit, state_difference, shared_children, children_kept, undo_state, own_undo, change_feed, state_fingerprint, bag_overlap, stretch_stats, prefix_sums, category_count, kind_counts, note_bodies, link_references, bibliography_latex, block_moves, css_values, heading_ids, pdf_strings, pdf_dates, date_fields, text_decode, byte_sums, whole_numbers, json_values, json_strings, binary_numbers)}

_O = "o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord, o_orderstatus <> 'P' AS alive FROM orders)"
_BYTES = "b AS (SELECT item_id, k, ('0x' || substr(hex(encode(text)), 2 * k - 1, 2))::INT AS x FROM benchmark, unnest(range(1, strlen(text) + 1)) AS r(k)), n AS (SELECT item_id, strlen(text) AS n FROM benchmark)"


def _list(x: list) -> str:
    return "[" + ", ".join(f"'{v}'" for v in x) + "]"


ORACLE = {
    "block_by_id": "SELECT p_partkey, p_partkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AS found FROM part",
    "block_info": f"WITH {_O}, a AS (SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS parent, alive FROM o UNION ALL SELECT 'c' || c_custkey, 'root', true FROM customer) SELECT id, parent, alive, (SELECT count(*) FROM a k WHERE k.alive AND k.parent = a.id) AS n_children FROM a",
    "child_at": f"WITH {_O}, k AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY ord) - 1 AS at FROM o WHERE alive) SELECT c_custkey AS o_custkey, c_custkey % 4 AS at, o_orderkey AS child FROM customer LEFT JOIN k ON c_custkey = o_custkey AND c_custkey % 4 = k.at",
    "run_texts": "SELECT conv_id, turn, 0 AS run, left(text, 7) AS run_text FROM conversations UNION ALL SELECT conv_id, turn, 1, substr(text, 8) FROM conversations",
    "position_validity": """WITH t AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n, doc_id % 50 AS o FROM documents),
v AS (SELECT doc_id, o <= n AND substr(h, 2 * o + 1, 1) NOT IN ('8', '9', 'A', 'B') AS a, o + 10 <= n AND substr(h, 2 * o + 21, 1) NOT IN ('8', '9', 'A', 'B') AS b FROM t) SELECT doc_id, a AS valid, a AND b AS range_ok FROM v""",
    "control_at": f"WITH {_O} SELECT o_orderkey AS pos, CASE ord % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey WHEN 2 THEN lag(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY ord) END AS control FROM o",
    "control_ranges": f"""WITH {_O}, l AS (SELECT *, lead(o_orderkey, 1) OVER w AS n1, lead(o_orderkey, 3) OVER w AS n3 FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY ord))
SELECT o_orderkey AS id, ord % 4 + 1 AS depth, o_orderkey AS "from", CASE ord % 4 WHEN 0 THEN n3 ELSE n1 END AS "to" FROM l WHERE ord % 4 < 2""",
    "masked_props": "SELECT p_partkey, CASE WHEN p_size % 4 IN (1, 3) THEN p_type ELSE p_name END AS p_name, CASE WHEN p_size % 4 >= 2 THEN p_size::VARCHAR ELSE p_brand END AS p_brand FROM part",
    "nearest_place": "SELECT point, s_suppkey FROM (SELECT c_custkey AS point, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS k FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey) WHERE k = 1",
    "topmost_box": """WITH s AS (SELECT s_nationkey AS page, s_suppkey AS idx, s_suppkey % 50 AS x0, floor(abs(s_acctbal))::INT % 60 AS y0 FROM supplier), c AS (SELECT c_nationkey AS page, c_custkey AS point, c_custkey % 70 AS x, floor(abs(c_acctbal))::INT % 60 AS y FROM customer)
SELECT c.page, point, max(idx) AS box FROM c LEFT JOIN s ON c.page = s.page AND x BETWEEN x0 AND x0 + 20 AND y BETWEEN y0 AND y0 + 30 GROUP BY 1, 2""",
    "resolved_format": "SELECT l_orderkey, l_linenumber, l_partkey AS format, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_size % 2 = 0 THEN 'S' || p_size ELSE 'Body' END AS font, CASE WHEN p_partkey % 5 = 0 THEN p_partkey WHEN p_size % 3 = 0 THEN p_size ELSE 11 END AS size FROM lineitem LEFT JOIN part ON l_partkey = p_partkey",
    "page_references": "SELECT c_custkey, coalesce((SELECT min(o_orderkey // 100) FROM orders WHERE o_custkey = c_custkey)::VARCHAR, '??') AS page_ref FROM customer",
    "citation_lookup": "SELECT c_custkey, s_suppkey FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 120",
    "language_prefix": f"""WITH t AS (SELECT c_custkey, {_list(TAGS)}[c_custkey % 8 + 1] AS tag FROM customer), p(prefix, ord, face) AS (VALUES {", ".join(map(str, PREFIXES))})
SELECT c_custkey, face FROM (SELECT c_custkey, face, row_number() OVER (PARTITION BY c_custkey ORDER BY length(prefix) DESC, ord) AS k FROM t JOIN p ON prefix = '' OR lower(tag) = lower(prefix) OR starts_with(lower(tag), lower(prefix) || '-') OR starts_with(lower(tag), lower(prefix) || '_')) WHERE k = 1""",
    "font_table": "SELECT p_partkey, face FROM part JOIN (SELECT p_brand AS b, arg_min(p_name, p_partkey) AS face FROM part GROUP BY 1) ON p_brand = b",
    "outline_flat": """WITH a AS (SELECT r_regionkey AS doc, 'r' || r_regionkey AS id, r_name AS title, [0] AS path FROM region UNION ALL SELECT n_regionkey, 'n' || n_nationkey, n_name, [0, n_nationkey] FROM nation
UNION ALL SELECT n_regionkey, 'c' || c_custkey, c_name, [0, n_nationkey, c_custkey] FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY path) AS no, len(path) AS level, id, title FROM a""",
    "unused_formats": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "document_order": """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN q % 2 = 1 THEN 1 WHEN l < 4 THEN -1 WHEN l > 4 THEN 1 WHEN q < 25 THEN -1 WHEN q > 25 THEN 1 WHEN 3 < q % 5 THEN -1 WHEN 3 > q % 5 THEN 1 ELSE 0 END AS cmp FROM (SELECT *, l_quantity::INT AS q, l_linenumber AS l FROM lineitem)""",
    "cited_order": """WITH f AS (SELECT l_suppkey, l_partkey, min(l_orderkey * 1000000 + l_partkey) AS pos FROM lineitem GROUP BY 1, 2),
u AS (SELECT l_suppkey, l_partkey, 0 AS k, pos FROM f UNION ALL SELECT s.l_suppkey, p_partkey, 1, p_partkey FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey % 50 = 0) s, part WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.l_suppkey = s.l_suppkey AND f.l_partkey = p_partkey))
SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY k, pos) AS no FROM u""",
    "marks_top_down": "SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal), c_custkey % 10, c_custkey) AS no FROM customer",
    "capacity_limit": "SELECT o_custkey, o_orderkey, n AS needed, n <= 9 AS fits FROM (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 9",
    "state_difference": "SELECT doc, client, clock, event_id FROM (SELECT user_id AS doc, event_type AS client, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS clock, CASE WHEN event_type = 'click' THEN 0 ELSE count(*) OVER (PARTITION BY user_id, event_type) // 2 END AS upto FROM events) WHERE clock > upto",
    "shared_children": 'SELECT parent, "at", child FROM (SELECT l_suppkey AS parent, l_orderkey AS "at", l_partkey AS child, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey, l_orderkey) AS k FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 10 AND l_suppkey <> l_partkey) WHERE k = 1',
    "children_kept": """WITH RECURSIVE s AS (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS i, o_orderkey AS p FROM orders),
r AS (SELECT c, i, p, 1 AS len FROM s UNION SELECT s.c, s.i, s.p, len + 1 FROM r JOIN s ON r.c = s.c AND s.i > r.i AND s.p > r.p) SELECT c AS o_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c) AS n, max(len) AS kept FROM r GROUP BY c""",
    "undo_state": "SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1",
    "own_undo": "SELECT o_orderkey, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS undone FROM orders",
    "change_feed": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2",
    "state_fingerprint": "SELECT o_custkey, sha256(string_agg(x, chr(10) ORDER BY x)) AS fingerprint FROM (SELECT o_custkey, o_orderkey || '=' || o_orderstatus AS x FROM orders) GROUP BY 1",
    "bag_overlap": """WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations WHERE turn < 2), c AS (SELECT conv_id, word, count(*) FILTER (turn = 0) AS n, count(*) FILTER (turn = 1) AS m FROM w GROUP BY 1, 2)
SELECT conv_id, sum(least(n, m)) AS shared, round(sum(least(n, m)) / greatest(sum(n), sum(m)), 6) AS overlap FROM c GROUP BY 1""",
    "stretch_stats": "SELECT l_returnflag, round(avg(abs(l_quantity / 32 - 1)), 6) AS mean_abs, max(l_quantity / 32 - 1) AS max_r, count(*) FILTER (l_quantity / 32 - 1 > 1) AS beyond FROM lineitem GROUP BY 1",
    "prefix_sums": "SELECT conv_id, turn, i - 1 AS at, sum(w) OVER (PARTITION BY conv_id, turn ORDER BY i) - w AS x FROM (SELECT conv_id, turn, i, length(ws[i]) * 10 + 5 AS w FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations), unnest(range(1, len(ws) + 1)) AS r(i))",
    "category_count": "SELECT l_suppkey, greatest(max(n), max(m)) AS categories FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_returnflag) JOIN (SELECT l_suppkey, count(DISTINCT (l_linenumber, l_quantity)) AS m FROM lineitem GROUP BY 1) USING (l_suppkey) GROUP BY 1",
    "kind_counts": "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1",
    "note_bodies": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'xs' ELSE '#s' END || c_custkey % 130 AS href, s_name AS body FROM customer LEFT JOIN supplier ON c_custkey % 7 <> 0 AND s_suppkey = c_custkey % 130",
    "link_references": "SELECT p_partkey, min(p_partkey) OVER (PARTITION BY lower(p_name)) AS target FROM part",
    "bibliography_latex": r"""SELECT n_regionkey, '\begin{thebibliography}{' || count(*) || '}' || chr(10) || string_agg('\bibitem{n' || n_nationkey || '} ' || replace(n_name, '_', '\_') || ' \& co' || chr(10), '' ORDER BY n_name) || '\end{thebibliography}' || chr(10) AS latex FROM nation GROUP BY 1""",
    "block_moves": f"WITH {_O} SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY ord % 3 = 2 DESC, ord) - 1 AS ord FROM o",
    "css_values": """WITH p AS (SELECT *, p_partkey * 7919 % 16777216 AS v FROM part) SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN ((v % 4096) // 256 * 17) * 65536 + (v // 16 % 16 * 17) * 256 + v % 16 * 17 WHEN 3 THEN CASE WHEN p_size % 2 = 0 THEN 128 END ELSE v END AS colour,
  round(p_size * [1, 0.75, 72, 72 / 2.54, 12, 0.12, 0.75, NULL][p_partkey % 8 + 1], 6) AS points, p_size || 'pt' AS size FROM p""",
    "heading_ids": "SELECT p_partkey, p_name AS text, CASE WHEN p_partkey % 3 <> 0 THEN 'p' || p_partkey END AS id FROM part",
    "pdf_strings": "SELECT doc_id, substr(text, 1, 400) AS text, 'Aé•€˘' AS own FROM documents",
    "pdf_dates": "SELECT o_orderkey, 'D:' || strftime(o_orderdate, '%Y%m%d%H%M%S') || 'Z' AS stamp FROM orders",
    "date_fields": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '5/6/2024' WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 2 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%-m/%-d/%Y') ELSE '' END AS shown FROM orders",
    "text_decode": "SELECT item_id, i - 1 AS i, unicode(substr(text, i, 1)) AS cp, strlen(left(text, i - 1)) AS off FROM benchmark, unnest(range(1, length(text) + 1)) AS r(i)",
    "byte_sums": f"""WITH RECURSIVE {_BYTES}, s AS (SELECT item_id, 0::BIGINT AS k, 1::BIGINT AS a, 0::BIGINT AS c, 2166136261::BIGINT AS h FROM benchmark
UNION ALL SELECT s.item_id, s.k + 1, (a + x) % 65521, (c + a + x) % 65521, (xor(h, x::BIGINT) * 16777619) & 4294967295 FROM s JOIN b ON s.item_id = b.item_id AND b.k = s.k + 1)
SELECT s.item_id, c * 65536 + a AS adler, h AS fnv FROM s JOIN n ON s.item_id = n.item_id AND s.k = n.n""",
    "whole_numbers": "SELECT p_partkey, floor(sqrt(p_partkey * 7919))::BIGINT AS root, round((p_partkey * 7919 - 3000000) * 3 / 7)::BIGINT AS scaled FROM part",
    "json_values": "SELECT p_partkey, p_name AS name, p_partkey AS second, -1 AS beyond, -2 AS word, '[[' || p_partkey || ',' || p_size || '],[' || p_size || ']]' AS matrix FROM part",
    "json_strings": r"""SELECT conv_id, turn, to_json(text || ' "q\' || chr(9) || chr(10))::VARCHAR AS json FROM conversations""",
    "binary_numbers": """WITH p AS (SELECT p_partkey, (p_partkey - 700) * pow(2, p_size % 40)::BIGINT AS v, p_partkey * 31 % 63488 AS b FROM part),
m AS (SELECT *, CASE WHEN v BETWEEN 0 AND 255 THEN 'U' WHEN v BETWEEN -128 AND 127 THEN 'i' WHEN v BETWEEN 0 AND 65535 THEN 'u' WHEN v BETWEEN -32768 AND 32767 THEN 'I' WHEN v BETWEEN 0 AND 4294967295 THEN 'm' WHEN v BETWEEN -2147483648 AND 2147483647 THEN 'l' ELSE 'L' END AS marker FROM p),
h AS (SELECT *, CASE WHEN b >= 32768 THEN -1.0 ELSE 1.0 END * CASE WHEN b // 1024 % 32 = 0 THEN b % 1024 / 1024 * pow(2, -14) ELSE (1 + b % 1024 / 1024) * pow(2, b // 1024 % 32 - 15) END AS hv FROM m)
SELECT p_partkey, marker, CASE marker WHEN 'U' THEN 2 WHEN 'i' THEN 2 WHEN 'u' THEN 3 WHEN 'I' THEN 3 WHEN 'm' THEN 5 WHEN 'l' THEN 5 ELSE 9 END AS size, v AS back, printf('%02X', (v & 255)::INT) AS low, CASE WHEN b // 1024 % 32 < 31 THEN hv END AS half FROM h""",
}
