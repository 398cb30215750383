"""Unicode segmentation and direction as Arrow UDFs over the regex module's
character properties: graphemes, line breaks, embedding levels."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def grapheme_starts(text: str) -> list[int]:
    """Byte offsets at which extended grapheme clusters begin."""
    import regex

    out, at = [], 0
    for g in regex.findall(r"\X", text):
        out.append(at)
        at += len(g.encode())
    return out


#: Line-break classes that the rules below name; all others are AL.
CLASSES = "BK CR LF NL SP ZW WJ GL CL CP OP QU EX IS SY NU PR PO HY BA BB B2 IN ID EB EM CM ZWJ RI HL NS CJ JL JV JT H2 H3".split()


def _class(c: str, cache: dict[str, str] = {}) -> str:  # noqa: B006
    if c not in cache:
        import regex

        cache[c] = next((k for k in CLASSES if regex.fullmatch(rf"\p{{Line_Break={k}}}", c)), "AL")
        cache[c] = {"CJ": "NS"}.get(cache[c], cache[c])
    return cache[c]


def line_breaks(text: str) -> list[int]:
    """For each byte offset 1..n: 0 no break, 1 allowed, 2 mandatory, before it."""
    points = list(text)
    n = len(text.encode())
    out = [0] * (n + 1)
    if not points:
        return [2]
    classes = [_class(c) for c in points]
    at = 0
    before = ""  # class to the left, combining marks and spaces aside
    spaces, regional, number = False, 0, False
    for k, c in enumerate(classes):
        if k:
            out[at] = _between(classes[k - 1], before, c, tuple(classes[k + 1 : k + 2]), spaces, regional % 2, number)
        if c == "SP":
            spaces = True
        elif c in ("CM", "ZWJ") and before and not spaces and before not in ("BK", "CR", "LF", "NL", "ZW"):
            pass
        else:
            number = c == "NU" or (number and c in ("SY", "IS", "CL", "CP") and not spaces)
            regional = regional + 1 if c == "RI" and not spaces else int(c == "RI")
            before, spaces = ("AL" if c in ("CM", "ZWJ") else c), False
        at += len(points[k].encode())
    out[n] = 2
    return out


LETTERS = ("AL", "HL")
#: Class pairs between which no break is allowed.
PAIRS = {
    **{(a, "NU"): 0 for a in LETTERS}, **{("NU", a): 0 for a in LETTERS},
    **{("PR", a): 0 for a in ("ID", "EB", "EM", *LETTERS, "NU", "OP", "HY")}, **{(a, "PO"): 0 for a in ("ID", "EB", "EM", *LETTERS)},
    **{("PO", a): 0 for a in (*LETTERS, "NU", "OP")}, **{(a, "PR"): 0 for a in LETTERS},
    **{(a, b): 0 for a in LETTERS for b in LETTERS}, ("HY", "NU"): 0, ("IS", "NU"): 0, ("NU", "NU"): 0, ("SY", "NU"): 0, ("EB", "EM"): 0,
    **{("IS", a): 0 for a in LETTERS}, **{(a, "OP"): 0 for a in (*LETTERS, "NU")}, **{("CP", a): 0 for a in (*LETTERS, "NU")},
    ("SY", "HL"): 0,
    **{("JL", a): 0 for a in ("JL", "JV", "H2", "H3")}, **{(a, b): 0 for a in ("JV", "H2") for b in ("JV", "JT")}, **{(a, "JT"): 0 for a in ("JT", "H3")},
}


@lru_cache(100_000)
def _between(left: str, before: str, c: str, after: tuple[str, ...], spaces: bool, regional: int, number: bool) -> int:
    """The rule for a place: left is the character before it, before the class that
    counts, spaces whether spaces stand between."""
    if left in ("BK", "LF", "NL") or (left == "CR" and c != "LF"):
        return 2
    if c in ("BK", "CR", "LF", "NL", "SP", "ZW"):
        return 0
    if before == "ZW":
        return 1
    if left == "ZWJ":
        return 0
    if c in ("CM", "ZWJ") and not spaces:
        return 0
    right = "AL" if c in ("CM", "ZWJ") else c
    if right == "WJ" or (before == "WJ" and not spaces) or (before == "GL" and not spaces):
        return 0
    if right == "GL" and not spaces and before not in ("BA", "HY"):
        return 0
    if right in ("CL", "CP", "EX", "SY") or (right == "IS" and not (spaces and after == ("NU",))):
        return 0
    if before == "OP" or (before == "QU" and right == "OP") or (before in ("CL", "CP") and right == "NS") or (before == "B2" and right == "B2"):
        return 0
    if spaces:
        return 1
    if right == "QU" or before == "QU" or right in ("BA", "HY", "NS") or before == "BB":
        return 0
    if right == "IN":
        return 0
    if number and right in ("PO", "PR"):
        return 0
    if before == "RI" and right == "RI" and regional:
        return 0
    return PAIRS.get((before, right), 1)


def base_direction(text: str) -> int:
    """1 if all strong characters run right to left, 2 if some do, else 0."""
    kinds = {unicodedata.bidirectional(c) for c in text}
    right, left = kinds & {"R", "AL"}, "L" in kinds
    if right and left:
        return 2
    return int(bool(right))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def graphemes(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in text:
        yield t.fillna("").map(grapheme_starts)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def breaks(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in text:
        yield t.fillna("").map(line_breaks)


@F.pandas_udf(T.IntegerType())
def direction(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in text:
        yield t.fillna("").map(base_direction)
