"""Scalar values: style sheets' colours and lengths, encodings, dates, JSON and its
binary form, checksums, whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named colours of style sheets (fixed values).
COLOURS = {"black": 0x000000, "silver": 0xC0C0C0, "gray": 0x808080, "white": 0xFFFFFF, "maroon": 0x800000, "red": 0xFF0000, "purple": 0x800080, "fuchsia": 0xFF00FF, "green": 0x008000, "lime": 0x00FF00, "olive": 0x808000, "yellow": 0xFFFF00, "navy": 0x000080, "blue": 0x0000FF, "teal": 0x008080, "aqua": 0x00FFFF}
#: Points in a unit of length (fixed values).
POINTS = {"pt": 1.0, "px": 0.75, "in": 72.0, "cm": 72 / 2.54, "mm": 72 / 25.4, "pc": 12.0}
#: Characters of PDFDocEncoding that differ from Latin-1 (fixed values).
PDF_DOC = dict(zip([*range(0x18, 0x20), *range(0x80, 0x9F), 0xA0], "˘ˇˆ˙˝˛˚˜•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž€", strict=True))


def css_colour(x: Column) -> Column:
    """#rgb, #rrggbb, rgb(r, g, b) or a name as a number; null for anything else."""
    low = F.lower(F.trim(x))
    long = F.when(low.rlike("^#[0-9a-f]{6}$"), F.substr(low, F.lit(2))).when(low.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(F.substr(low, F.lit(2)), "(.)", "$1$1"))
    part = lambda k: F.least(F.lit(255), F.regexp_extract(low, "^rgba?\\( *(\\d{1,3}) *, *(\\d{1,3}) *, *(\\d{1,3})", k).cast("int"))
    rgb = F.when(low.rlike("^rgba?\\( *\\d{1,3} *, *\\d{1,3} *, *\\d{1,3} *[,)]"), part(1) * 65_536 + part(2) * 256 + part(3))
    named = F.element_at(F.create_map(*[F.lit(v) for pair in COLOURS.items() for v in pair]), low)
    return F.coalesce(F.conv(long, 16, 10).cast("int"), rgb, named)


def css_length(x: Column, em: float = 12.0) -> Column:
    """A length in points; em, rem and per cent are of the font size em; a bare number is
    pixels. Null for anything else."""
    low = F.lower(F.trim(x))
    pattern = "^([+-]?(?:\\d+\\.?\\d*|\\.\\d+))(pt|px|in|cm|mm|pc|em|rem|%|)$"
    unit = F.regexp_extract(low, pattern, 2)
    per = F.element_at(F.create_map(*[F.lit(v) for pair in (POINTS | {"em": em, "rem": em, "%": em / 100, "": 0.75}).items() for v in pair]), unit)
    return F.when(low.rlike(pattern), F.regexp_extract(low, pattern, 1).cast("double") * per)


def css_property(style: Column, name: str) -> Column:
    """The last value of a property in a style attribute, without !important."""
    pairs = F.transform(F.split(style, ";"), lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("k"), F.trim(F.regexp_replace(F.regexp_replace(p, "^[^:]*:", ""), "(?i)!\\s*important\\s*$", "")).alias("v")))
    return F.try_element_at(F.filter(pairs, lambda p: p["k"] == name), F.lit(-1))["v"]


def heading_id(line: Column) -> Column:
    """Struct of text and id: a heading's {#id ...} attributes taken off its end."""
    pattern = "\\s*\\{\\s*#([^}\\s]+)[^}]*\\}\\s*$"
    return F.struct(F.regexp_replace(line, pattern, "").alias("text"), F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).alias("id"))


def pdf_text(raw: Column) -> Column:
    """A PDF text string: UTF-16BE or UTF-8 by its mark, else PDFDocEncoding."""
    other = F.translate(F.decode(raw, "ISO-8859-1"), "".join(map(chr, PDF_DOC)), "".join(PDF_DOC.values()))
    start = F.hex(F.substring(raw, 1, 3))
    return F.when(start.startswith("FEFF"), F.decode(F.substr(raw, F.lit(3)), "UTF-16BE")).when(start == "EFBBBF", F.decode(F.substr(raw, F.lit(4)), "UTF-8")).otherwise(other)


def pdf_encoded(text: Column) -> Column:
    """Text as a PDF text string: ASCII as it is, anything else UTF-16BE with its mark."""
    return F.when(text.rlike("^[\\x09\\x0A\\x0D\\x20-\\x7E]*$"), text.cast("binary")).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))


def pdf_date(at: Column) -> Column:
    """A moment in UTC as a PDF date."""
    return F.concat(F.lit("D:"), F.date_format(at, "yyyyMMddHHmmss"), F.lit("Z"))


def date_field(kind: Column, created: Column, saved: Column, printed: Column, now: Column, pattern: str = "M/d/yyyy") -> Column:
    """A date field's text: of now for DATE and TIME, else of the document's own dates;
    empty if the document has none."""
    at = F.when(kind.isin("DATE", "TIME"), now).when(kind == "CREATEDATE", created).when(kind == "SAVEDATE", saved).when(kind == "PRINTDATE", printed)
    return F.coalesce(F.date_format(at, pattern), F.lit(""))


def decoded(text: Column) -> Column:
    """The characters of a text: structs of code point and byte offset."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    none = F.struct(F.lit(0).alias("off"), F.filter(F.array(F.struct(F.lit(0).alias("cp"), F.lit(0).alias("off"))), lambda x: F.lit(False)).alias("out"))
    return F.aggregate(chars, none, lambda acc, c: F.struct((acc["off"] + F.octet_length(c)).alias("off"), F.concat(acc["out"], F.array(F.struct(F.ascii(c).alias("cp"), acc["off"].alias("off")))).alias("out")), lambda acc: acc["out"])


def _bytes(text: Column) -> Column:
    raw = F.hex(text.cast("binary"))
    n = F.octet_length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.conv(F.substr(raw, 2 * k - 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.filter(F.array(F.lit(0).cast("long")), lambda x: F.lit(False)))


def adler32(text: Column) -> Column:
    sums = F.aggregate(_bytes(text), F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), lambda s, x: F.struct(((s["a"] + x) % 65_521).alias("a"), ((s["b"] + s["a"] + x) % 65_521).alias("b")))
    return sums["b"] * 65_536 + sums["a"]


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of a text's bytes."""
    return F.aggregate(_bytes(text), F.lit(2_166_136_261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * 16_777_619).bitwiseAND(F.lit(0xFFFFFFFF)))


def whole_root(v: Column) -> Column:
    """The largest whole number whose square is at most v; 0 for negative v."""
    v = F.greatest(v, F.lit(0))
    near = F.floor(F.sqrt(v.cast("double"))).cast("long")
    return F.when(near * near > v, near - 1).when((near + 1) * (near + 1) <= v, near + 1).otherwise(near)


def scaled(v: Column, by: Column, of: Column) -> Column:
    """v * by / of in whole numbers, rounded half away from zero."""
    product = v.cast("long") * by.cast("long")
    return F.signum(product).cast("long") * F.floor((F.abs(product) * 2 + of) / (2 * of)).cast("long")


def json_at(json: Column, *path: str | int) -> Column:
    """A value by names and places (from 0) as text; null if there is none."""
    return F.get_json_object(json, "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path))


def int_or(value: Column, default: int) -> Column:
    return F.coalesce(value.try_cast("long"), F.lit(default).cast("long"))


def matrix_json(rows: Column) -> Column:
    """An array of arrays of whole numbers as JSON text."""
    return F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, lambda v: v.cast("string")), ","), F.lit("]"))), ","), F.lit("]"))


def json_string(text: Column) -> Column:
    """Text as a JSON string: quotes, backslashes and controls escaped."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return F.concat(F.lit('"'), out, F.lit('"'))


def bj_int(v: Column) -> Column:
    """A whole number in binary JSON: the marker of the smallest type that holds it, and
    its bytes, the lowest first."""
    def little(n: int) -> Column:
        return F.concat(*[F.lpad(F.hex(F.shiftright(v, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(n)])

    types = (("U", 1, 0, 255), ("i", 1, -128, 127), ("u", 2, 0, 65_535), ("I", 2, -32_768, 32_767), ("m", 4, 0, 2**32 - 1), ("l", 4, -(2**31), 2**31 - 1))
    coded = None
    for marker, size, low, high in types:
        held, value = v.between(low, high), F.concat(F.lit(f"{ord(marker):02X}"), little(size))
        coded = F.when(held, value) if coded is None else coded.when(held, value)
    return F.unhex(coded.otherwise(F.concat(F.lit(f"{ord('L'):02X}"), little(8))))


def bj_value(raw: Column) -> Column:
    """The number of bj_int()."""
    marker = F.substr(raw, F.lit(1), F.lit(1)).cast("string")
    byte = lambda k: F.conv(F.hex(F.substr(raw, F.lit(k + 2), F.lit(1))), 16, 10).cast("long")

    def number(n: int, signed: bool) -> Column:
        total = sum((F.shiftleft(byte(k), 8 * k) for k in range(1, n)), byte(0))
        return F.when(total >= 1 << (8 * n - 1), total - (1 << 8 * n)).otherwise(total) if signed and n < 8 else total

    out = F.when(marker == "U", number(1, False))
    for m, n, signed in (("i", 1, True), ("u", 2, False), ("I", 2, True), ("m", 4, False), ("l", 4, True), ("L", 8, True)):
        out = out.when(marker == m, number(n, signed))
    return out


def half_float(bits: Column) -> Column:
    """The value of a 16-bit float."""
    sign = F.when(F.shiftright(bits, 15).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
    exponent, part = F.shiftright(bits, 10).bitwiseAND(F.lit(31)), bits.bitwiseAND(F.lit(1023)).cast("double")
    tiny = part / 1024 * F.lit(2.0**-14)
    return sign * F.when(exponent == 0, tiny).when(exponent < 31, (1 + part / 1024) * F.pow(F.lit(2.0), (exponent - 15).cast("double"))).when(part == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
