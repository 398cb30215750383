"""Numbers as documents print them: list labels, notes, charts and axes. All are
column expressions over whole numbers or doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits and words of the number formats.
ROMAN = [["", "m", "mm", "mmm"], ["", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"], ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"], ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]]
CARDINAL = ["Zero", "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine", "Ten", "Eleven", "Twelve", "Thirteen", "Fourteen", "Fifteen", "Sixteen", "Seventeen", "Eighteen", "Nineteen"]
ORDINAL = ["Zeroth", "First", "Second", "Third", "Fourth", "Fifth", "Sixth", "Seventh", "Eighth", "Ninth", "Tenth", "Eleventh", "Twelfth", "Thirteenth", "Fourteenth", "Fifteenth", "Sixteenth", "Seventeenth", "Eighteenth", "Nineteenth"]
TENS = ["", "", "Twenty", "Thirty", "Forty", "Fifty", "Sixty", "Seventy", "Eighty", "Ninety"]
TENTHS = ["", "", "Twentieth", "Thirtieth", "Fortieth", "Fiftieth", "Sixtieth", "Seventieth", "Eightieth", "Ninetieth"]
HAN = "零一二三四五六七八九"
STEMS = "甲乙丙丁戊己庚辛壬癸"
SYMBOLS = "*†‡§"

FORMATS = ["decimal", "loweralpha", "upperalpha", "lowerroman", "upperroman", "none", "decimalzero", "ordinal", "circled", "fullwidth", "cjkcounting", "cjktraditional", "cardinaltext", "ordinaltext", "symbol"]


def _pick(values: list[str], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def _div(v: Column, by: int) -> Column:
    return F.floor(v / by)


def lower_roman(v: Column) -> Column:
    """Empty from 4000 on."""
    parts = [_pick(row, _div(v, 10 ** (3 - k)) % 10 if k else _div(v, 1000)) for k, row in enumerate(ROMAN)]
    return F.when(v >= 4000, "").otherwise(F.concat(*parts))


def lower_alpha(v: Column) -> Column:
    """Bijective base 26: z, aa, ab. The letter of place k is there once v passes all
    numbers of k letters; seven letters hold every 32-bit number."""
    parts, passed = [], 0
    for k in range(7):
        parts.append(F.when(v > passed, F.char(_div(v - 1 - passed, 26**k) % 26 + 97)).otherwise(""))
        passed = passed * 26 + 26
    return F.concat(*reversed(parts))


def _words(v: Column, small: list[str], round_: list[str]) -> Column:
    low = F.lower(_pick(small, v % 10))
    return F.when(v < 20, _pick(small, v)).when(v % 10 == 0, _pick(round_, _div(v, 10))).otherwise(F.concat_ws("-", _pick(TENS, _div(v, 10)), low))


def han_counting(v: Column) -> Column:
    """Up to 99999: one zero for a gap within, ten without its one at the front. Each
    place is told by its digit and the one above it alone."""
    parts = []
    for power, unit in ((4, "万"), (3, "千"), (2, "百"), (1, "十"), (0, "")):
        d, above = _div(v, 10**power) % 10, _div(v, 10 ** (power + 1)) % 10
        gap = F.when((v >= 10 ** (power + 1)) & (above == 0), HAN[0]).otherwise("")
        digit = F.when((v >= 10) & (v < 20) & F.lit(power == 1), "").otherwise(_pick(list(HAN), d))
        parts.append(F.when(d == 0, "").otherwise(F.concat(gap, digit, F.lit(unit))))
    return F.concat(*parts)


def format_number(v: Column, fmt: str) -> Column:
    """A counter in one of FORMATS. Numbers below 1, and those past what a format
    has, are decimal."""
    text = v.cast("string")
    kinds = {
        "decimal": text,
        "none": F.lit(""),
        "loweralpha": lower_alpha(v),
        "upperalpha": F.upper(lower_alpha(v)),
        "lowerroman": lower_roman(v),
        "upperroman": F.upper(lower_roman(v)),
        "decimalzero": F.lpad(text, F.greatest(F.lit(2), F.length(text)), "0"),
        "ordinal": F.concat(text, F.when((v % 100).between(11, 13), "th").otherwise(F.coalesce(_pick(["th", "st", "nd", "rd"], v % 10), F.lit("th")))),
        "circled": F.when(v <= 20, _pick([chr(0x2460 + k) for k in range(20)], v - 1)).otherwise(text),
        "fullwidth": F.translate(text, "0123456789", "０１２３４５６７８９"),
        "cjkcounting": F.when(v < 100_000, han_counting(v)).otherwise(text),
        "cjktraditional": F.when(v <= 10, _pick(list(STEMS), v - 1)).otherwise(text),
        "cardinaltext": F.when(v < 100, _words(v, CARDINAL, TENS)).otherwise(text),
        "ordinaltext": F.when(v < 100, _words(v, ORDINAL, TENTHS)).otherwise(text),
        "symbol": F.repeat(_pick(list(SYMBOLS), (v - 1) % 4), F.least(F.lit(8), _div(v - 1, 4) + 1).cast("int")),
    }
    return F.when(v <= 0, text).otherwise(kinds[fmt])


def format_by(v: Column, fmt: Column) -> Column:
    """format_number with the format in a column."""
    out = v.cast("string")
    for name in FORMATS:
        out = F.when(fmt == name, format_number(v, name)).otherwise(out)
    return out


def task_label(label: Column, task: Column, bullet: Column) -> Column:
    """A checklist's box (task 1 open, 2 done) replaces a bullet and follows a number."""
    box = F.when(task == 2, "☑").otherwise("☐")
    return F.when(F.coalesce(task, F.lit(0)) == 0, label).when(bullet, box).otherwise(F.concat_ws(" ", label, box))


def chart_number(v: Column, code: str) -> Column:
    """A value by a chart's format code: decimals after the point, commas for groups,
    per cent; only the section before a semicolon counts."""
    if not code or code == "General":
        near = F.abs(v - F.floor(v + 0.5)) < 1e-9 * (F.abs(v) + 1)
        return F.when(near, F.format_string("%.0f", v)).otherwise(F.format_string("%.6g", v))
    section = code.split(";")[0]
    left, _, right = section.partition(".")
    digits = min(10, len(right) - len(right.lstrip("0#")))
    scaled = v * 100 if "%" in section else v
    # ties that the number holds exactly go to the even digit, as in C
    scaled = F.when(scaled * 1024 == F.floor(scaled * 1024), F.bround(scaled, digits)).otherwise(scaled)
    shown = F.format_string(f"%{',' if ',' in left else ''}.{digits}f", scaled)
    return F.concat(shown, F.lit("%")) if "%" in section else shown


def nice_axis(lo: Column, hi: Column) -> Column:
    """Struct of a, b and step: an axis over lo..hi in steps of 1, 2, 5 or 10 times a
    power of ten, about eight of them."""
    hi = F.when(hi <= lo, lo + F.when(lo == 0, F.lit(1.0)).otherwise(F.abs(lo))).otherwise(hi)
    raw = (hi - lo) / 8
    size = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    unit = raw / size
    step = F.when(unit < 1.5, 1).when(unit < 3, 2).when(unit < 7, 5).otherwise(10) * size
    a = F.floor(lo / step + 1e-9) * step
    b = F.ceil(hi / step - 1e-9) * step
    return F.struct(a.alias("a"), F.when(b <= a, a + step).otherwise(b).alias("b"), step.alias("step"))
