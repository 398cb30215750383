"""Queries of byte codecs, markup, names, and readers of RTF, LaTeX and slides."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec, media, text
from ..operators import breaking
from ..sources import bibtex, markup, office
from .common import dealt, table

FILTERS = ["FlateDecode", "ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode", "LZWDecode", "ASCIIHexDecode RunLengthDecode"]


def _bits(codes: list[int], width: int = 9) -> bytes:
    n = sum(c << width * k for k, c in enumerate(reversed(codes)))
    size = width * len(codes)
    return (n << -size % 8).to_bytes(-(-size // 8), "big")


@F.pandas_udf(T.BinaryType())
def _filtered(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Bytes as a filter of FILTERS reads them."""
    import base64
    import zlib

    def one(s: str, k: int) -> bytes:
        raw = s.encode()
        run = bytes([len(raw) - 1]) + raw + b"\x80"
        return [zlib.compress(raw), raw.hex(" ").encode() + b">", b"<~" + base64.a85encode(raw) + b"~>", run, _bits([256, *raw, 257]), run.hex().encode()][k]

    for s, k in batches:
        yield pd.Series([one(a, b) for a, b in zip(s, k, strict=True)], dtype=object)


def stream_filters(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("p_partkey") % 6).cast("int")
    p = dealt(table(spark, d, "part"), "p_partkey").select("p_partkey", F.get(F.array(*map(F.lit, FILTERS)), k).alias("names"), _filtered("p_name", k).alias("raw"))
    return p.select("p_partkey", codec.stream_bytes("raw", "names").cast("string").alias("text"))


def gif_frames(spark: SparkSession, d: str) -> DataFrame:
    delay = F.concat(F.lpad(F.hex(F.col("p_size")), 2, "0"), F.lit("00"))
    frame = F.concat(F.lit("21F90400"), delay, F.lit("00002C0000000001000100000202440100"))
    raw = F.unhex(F.concat(F.lit("47494638396101000100800000000000FFFFFF21FE026869" + "00"), F.repeat(frame, (F.col("p_partkey") % 4).cast("int")), F.lit("3B")))
    return dealt(table(spark, d, "part"), "p_partkey").select("p_partkey", codec.gif_frames(raw).alias("delays"))


def jpeg_sizes(spark: SparkSession, d: str) -> DataFrame:
    two = lambda c: F.lpad(F.hex(c), 4, "0")
    raw = F.unhex(F.concat(F.lit("FFD8FFE000044A46FFC4000411" + "22FFC2001108"), two(F.col("p_size")), two(F.col("p_partkey") % 60_000), F.lit("03012200021101031101FFD9")))
    return dealt(table(spark, d, "part"), "p_partkey").select("p_partkey", media.jpeg_size(raw).alias("x")).select("p_partkey", "x.w", "x.h")


def xml_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    item = F.concat(F.lit('<n k="'), "n_nationkey", F.lit('">'), "n_name", F.lit("<e/>&amp;</n>"))
    files = n.groupBy("n_regionkey").agg(F.concat(F.lit("<?xml version='1.0'?><r>head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", item.alias("t")))), lambda x: x["t"]), ""), F.lit("</r>")).alias("xml"))
    return codec.xml_nodes(files, "n_regionkey", "xml").select("n_regionkey", "no", "parent", "depth", "tag", "text", F.col("attributes")["k"].alias("k"))


@F.pandas_udf(T.StringType())
def _decoded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(markup.decoded)


def entity_decode(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(text.html_escaped(F.col("p_name")), F.lit("&eacute;&#x41;&#"), (F.col("p_partkey") % 26 + 97).cast("string"), F.lit(";&nosuch; &amp"))
    return dealt(table(spark, d, "part"), "p_partkey").select("p_partkey", _decoded(t).alias("text"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(lambda x: [f"{kind}:{name}" + "".join(f"[{k}={v}]" for k, v in attrs.items()) for kind, name, attrs in markup.tokens(x)])


def markup_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("<!-- x --><P CLASS='a b' id="), "p_partkey", F.lit(">"), "p_name", F.lit(" < 3<br/><script>if (a<b) {}</script></p>"))
    return dealt(table(spark, d, "part"), "p_partkey").select("p_partkey", _tokens(t).alias("tokens"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _names(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(lambda x: [f"{n['first']}|{n['von']}|{n['last']}" for n in bibtex.names(x)])


def bib_names(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("Ada van der "), "p_brand", F.lit(" and {Barnes and "), "p_type", F.lit("} and von Beethoven, Ludwig and Knuth"))
    return dealt(table(spark, d, "part"), "p_partkey").select("p_partkey", _names(t).alias("names"))


def bib_years(spark: SparkSession, d: str) -> DataFrame:
    year = F.when(F.col("o_orderkey") % 3 == 0, F.lit("1066")).when(F.col("o_orderkey") % 3 == 1, F.lit(""))
    return table(spark, d, "orders").select("o_orderkey", text.year_of(year, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"))


def latex_text(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("\\documentclass{article} % x\n\\begin{document}\n\\section{"), "p_name", F.lit(" \\& co}\nCaf\\'e na\\\"{i}ve --- 50\\% % gone\nof it\n\n\\begin{itemize}\n\\item \\emph{"), "p_type", F.lit("}\n\\item two\n\\end{itemize}\n\\end{document} after"))
    return office.paragraphs(dealt(table(spark, d, "part"), "p_partkey").select("p_partkey", body.cast("binary").alias("content")), "p_partkey", "content", "latex").select("p_partkey", "ord", "role", "text")


def rtf_text(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("{\\rtf1{\\fonttbl{\\f0 Times;}}{\\*\\x gone}\\f0 "), "p_name", F.lit(" caf\\'e9 \\u945?\\{b\\}\\tab x\\par\n{\\b "), "p_type", F.lit("}\\line y\\emdash z\\par}"))
    return office.paragraphs(dealt(table(spark, d, "part"), "p_partkey").select("p_partkey", body.cast("binary").alias("content")), "p_partkey", "content", "rtf").select("p_partkey", "ord", "text")


@F.pandas_udf(T.BinaryType())
def _deck(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A package with two slides of a paragraph each."""
    slide = '<p:sld xmlns:p="p" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>{}</a:t></a:r><a:br/><a:r><a:t>end</a:t></a:r></a:p></p:sld>'

    def one(t: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k in (2, 1):
                z.writestr(f"ppt/slides/slide{k}.xml", slide.format(f"{t} {k}"))
        return out.getvalue()

    for t in texts:
        yield t.map(one)


def pptx_import(spark: SparkSession, d: str) -> DataFrame:
    files = dealt(table(spark, d, "part"), "p_partkey").select("p_partkey", _deck("p_name").alias("content"))
    return office.paragraphs(files, "p_partkey", "content", "pptx").select("p_partkey", "ord", "part", "text")


@F.pandas_udf(T.StructType([T.StructField("cubic", T.LongType()), T.StructField("tex", T.LongType())]))
def _badness(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for over, room in batches:
        pairs = list(zip(over.tolist(), room.tolist(), strict=True))
        yield pd.DataFrame({"cubic": [breaking.badness(a, b) for a, b in pairs], "tex": [breaking.tex_badness(a, b) for a, b in pairs]})


def badness_values(spark: SparkSession, d: str) -> DataFrame:
    return dealt(table(spark, d, "part"), "p_partkey").select("p_partkey", _badness(F.col("p_partkey") % 700, F.col("p_size") * 3).alias("x")).select("p_partkey", "x.cubic", "x.tex")


QUERIES = {f.__name__: f for f in (stream_filters, gif_frames, jpeg_sizes, xml_nodes, entity_decode, markup_tokens, bib_names, bib_years, latex_text, rtf_text, pptx_import, badness_values)}

ORACLE = {
    "stream_filters": "SELECT p_partkey, p_name AS text FROM part",
    "gif_frames": "SELECT p_partkey, list_transform(range(0, p_partkey % 4), lambda i: p_size) AS delays FROM part",
    "jpeg_sizes": "SELECT p_partkey, p_partkey % 60000 AS w, p_size AS h FROM part",
    "xml_nodes": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)
SELECT n_regionkey, 2 * k - 1 AS no, 0 AS parent, 1 AS depth, 'n' AS tag, n_name AS text, n_nationkey::VARCHAR AS k FROM n UNION ALL SELECT n_regionkey, 2 * k, 2 * k - 1, 2, 'e', '', NULL FROM n UNION ALL SELECT DISTINCT n_regionkey, 0, NULL, 0, 'r', 'head', NULL FROM nation""",
    "entity_decode": "SELECT p_partkey, p_name || 'éA' || chr((p_partkey % 26 + 97)::INT) || '&nosuch; &' AS text FROM part",
    "markup_tokens": "SELECT p_partkey, ['open:p[class=a b][id=' || p_partkey || ']', 'text:' || p_name || ' ', 'text:<', 'text: 3', 'empty:br', 'open:script', 'close:script', 'close:p'] AS tokens FROM part",
    "bib_names": "SELECT p_partkey, ['Ada|van der|' || p_brand, '||{Barnes and ' || p_type || '}', 'Ludwig|von|Beethoven', '||Knuth'] AS names FROM part",
    "bib_years": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '1066' ELSE year(o_orderdate)::VARCHAR END AS year FROM orders",
    "latex_text": "SELECT p_partkey, v.ord, v.role, v.text FROM part, LATERAL (VALUES (0, 'heading', p_name || ' & co'), (1, 'body', 'Café naïve — 50% of it'), (2, 'item', p_type), (3, 'item', 'two')) AS v(ord, role, text)",
    "rtf_text": "SELECT p_partkey, v.ord, v.text FROM part, LATERAL (VALUES (0, p_name || ' café α{b}' || chr(9) || 'x'), (1, p_type || chr(10) || 'y—z')) AS v(ord, text)",
    "pptx_import": "SELECT p_partkey, k - 1 AS ord, k AS part, p_name || ' ' || k || chr(10) || 'end' AS text FROM part, (VALUES (1), (2)) AS v(k)",
    "badness_values": """WITH p AS (SELECT p_partkey, p_partkey % 700 AS t, p_size * 3 AS s FROM part), r AS (SELECT *, least(100000, t * 1000 // s)::HUGEINT AS c, t * 297 // s AS x FROM p)
SELECT p_partkey, least(1000000000, c * c * c // 10000000) AS cubic, CASE WHEN t = 0 THEN 0 WHEN x > 1290 THEN 10000 ELSE (x * x * x + 131072) // 262144 END AS tex FROM r""",
}
