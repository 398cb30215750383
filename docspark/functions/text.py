"""Text as documents hold it: units, labels, escapes, keys. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .detect import SPACE


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def clean(text: Column) -> Column:
    """Without control characters but tab and line feed, and without U+FFFC."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B-\\x1F\\x{FFFC}]", "")


def collapsed(text: Column) -> Column:
    """White space (not the no-break space) as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r\\x00]+", " "))


def reference_label(text: Column) -> Column:
    """A link or footnote label as its definition is looked up: folded, collapsed, at
    most 127 bytes of ASCII."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.substring(F.trim(F.regexp_replace(folded, f"{SPACE}+", " ")), 1, 127)


def purified(text: Column) -> Column:
    """A bibliography's sort text: lowered letters and digits, a command as its last
    letter, space and comma as a space, all else gone."""
    bare = F.regexp_replace(text, "\\\\[A-Za-z]*([A-Za-z])", "$1")
    bare = F.regexp_replace(bare, "\\\\[^A-Za-z]?", "")
    kept = F.regexp_replace(bare, "[\\x00-\\x1F!-+\\--/:-@\\[-`{-\\x7F]", "")
    lowered = F.translate(kept, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.translate(lowered, ",", " ")


def html_escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def markdown_escaped(text: Column) -> Column:
    return F.regexp_replace(text, "([\\\\`*_\\[\\]<>#|~$])", "\\\\$1")


def rtf_escaped(text: Column) -> Column:
    """Backslashes and braces marked; every UTF-16 unit beyond ASCII as a signed number
    with a question mark for old readers."""
    def unit(raw: Column, k: Column) -> Column:
        n = F.conv(F.substr(raw, 4 * k + 1, F.lit(4)), 16, 10).cast("int")
        return F.concat(F.lit("\\u"), F.when(n > 32_767, n - 65_536).otherwise(n).cast("string"), F.lit("?"))

    def one(c: Column) -> Column:
        raw = F.hex(F.encode(c, "UTF-16BE"))
        wide = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.length(raw) / 4 - 1, F.lit(0)).cast("int")), lambda k: unit(raw, k)), "")
        return F.when(c.isin("\\", "{", "}"), F.concat(F.lit("\\"), c)).when(F.ascii(c) < 128, c).otherwise(wide)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def latex_escaped(text: Column) -> Column:
    marked = F.regexp_replace(text, "\\\\", "\x01")
    marked = F.regexp_replace(marked, "([#$%&_{}])", "\\\\$1")
    for a, b in (("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}"), ("\x01", "\\textbackslash{}")):
        marked = F.replace(marked, F.lit(a), F.lit(b))
    return marked


def may_be_rtl(text: Column) -> Column:
    """Conservative test before the bidirectional algorithm: any character of a
    right-to-left block, or a direction control."""
    return text.rlike("[\\x{0590}-\\x{08FF}\\x{200F}\\x{202B}\\x{202E}\\x{2067}\\x{FB1D}-\\x{FDFF}\\x{FE70}-\\x{FEFF}\\x{10800}-\\x{10FFF}\\x{1E800}-\\x{1EFFF}]")


#: Parts of font names that tell a family's class; earlier classes win (fixed values).
MONO = ["mono", "courier", "consol", " code", "typewriter", "menlo", "fixed", "terminal", "lucida console"]
SANS = ["arial", "helvetica", "calibri", "carlito", "verdana", "tahoma", "segoe", "gothic", "futura", "gill", "frutiger", "avenir", "roboto", "lato", "ubuntu", "cantarell", "inter", "aptos", "franklin", "trebuchet", "geneva", "lucida grande", "myriad", "optima", "univers", "candara", "corbel", "noto sans", "simhei", "yahei", "jhenghei", "heiti", "dengxian", "gulim", "dotum", "malgun", "meiryo", "黑", "等线", "ゴシック", "고딕"]
SERIF = ["serif", "times", "roman", "georgia", "garamond", "cambria", "minion", "palatino", "baskerville", "caslon", "book antiqua", "century", "bookman", "charter", "mincho", "song", "ming", "batang", "明朝", "宋"]


def font_class(family: Column) -> Column:
    """Struct of class (mono, sans or serif) and sure."""
    low = F.lower(family)
    has = lambda names: low.rlike("|".join(names))
    sans = has(SANS) | (F.contains(low, F.lit("sans")) & ~F.contains(low, F.lit("serif")))
    kind = F.when(has(MONO), "mono").when(sans, "sans").when(has(SERIF), "serif")
    return F.struct(F.coalesce(kind, F.lit("serif")).alias("class"), kind.isNotNull().alias("sure"))


#: A date picture's letters as a date pattern's; others are the same in both (fixed values).
PICTURE = {"dddd": "EEEE", "ddd": "EEE", "AM/PM": "a", "am/pm": "a"}


def date_pattern(picture: str) -> str:
    """A document's date picture as a Spark date pattern; quoted text stays quoted."""
    import re

    def part(m: re.Match) -> str:
        x = m[0]
        if x[0] == "'":
            return x
        return PICTURE.get(x, x if re.fullmatch("d{1,2}|M{1,4}|yy|yyyy|h{1,2}|H{1,2}|m{1,2}|s{1,2}", x) else f"'{x}'" if x.isalpha() else x)

    return re.sub("'[^']*'|[Aa][Mm]/[Pp][Mm]|d+|M+|y+|h+|H+|m+|s+|[A-Za-z]|.", part, picture)


def date_picture(at: Column, picture: str) -> Column:
    return F.date_format(at, date_pattern(picture))


def year_of(year: Column, date: Column) -> Column:
    """A bibliography entry's year: the field, or the first four of its date."""
    return F.coalesce(F.nullif(year, F.lit("")), F.nullif(F.regexp_extract(date, "^\\d.{3}", 0), F.lit("")))
