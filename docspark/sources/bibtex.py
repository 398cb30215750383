"""BibTeX files to entries (ord, type, key, fields). Macros, months, # joins,
parenthesised entries, comments, and the newer field names are read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Months as macros, and newer field names with the older ones (fixed values).
MONTHS = {"jan": "January", "feb": "February", "mar": "March", "apr": "April", "may": "May", "jun": "June", "jul": "July", "aug": "August", "sep": "September", "oct": "October", "nov": "November", "dec": "December"}
RENAMED = {"journaltitle": "journal", "location": "address"}

_NAME = re.compile(r"[^\s\"#%'(),={}]+")


class _Reader:
    def __init__(self, text: str):
        self.text, self.at, self.macros = text, 0, dict(MONTHS)

    def skip(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def take(self, chars: str) -> str | None:
        self.skip()
        if self.at < len(self.text) and self.text[self.at] in chars:
            self.at += 1
            return self.text[self.at - 1]
        return None

    def name(self) -> str:
        self.skip()
        m = _NAME.match(self.text, self.at)
        self.at = m.end() if m else self.at
        return m[0] if m else ""

    def balanced(self, close: str) -> str:
        """Up to close outside braces, past it."""
        depth, start = 0, self.at
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == close and depth == 0:
                self.at += 1
                return self.text[start : self.at - 1]
            depth += (c == "{") - (c == "}")
            self.at += 1
        return self.text[start:]

    def value(self) -> str:
        parts = []
        while True:
            opened = self.take('{"')
            if opened:
                parts.append(self.balanced("}" if opened == "{" else '"'))
            else:
                word = self.name()
                parts.append(self.macros.get(word.lower(), word))
            if not self.take("#"):
                return re.sub(r"\s+", " ", "".join(parts)).strip()

    def entries(self) -> Iterator[tuple[str, str, dict[str, str]]]:
        while (at := self.text.find("@", self.at)) >= 0:
            self.at = at + 1
            kind = self.name().lower()
            opened = self.take("{(")
            if not opened:
                continue
            close = "}" if opened == "{" else ")"
            if kind in ("comment", "preamble"):
                self.balanced(close)
            elif kind == "string":
                name = self.name().lower()
                if self.take("="):
                    self.macros[name] = self.value()
                self.take(close)
            else:
                key, fields = self.name(), {}
                while self.take(","):
                    field = self.name().lower()
                    if not field or not self.take("="):
                        break
                    fields.setdefault(RENAMED.get(field, field), self.value())
                self.take(close)
                yield kind, key, fields


def entries(files: DataFrame, file_id: str, text: str) -> DataFrame:
    """file_id, ord, type, key, fields."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, *e) for i, t in zip(f[file_id], f[text], strict=True) for k, e in enumerate(_Reader(t or "").entries())]
            yield pd.DataFrame(rows, columns=[file_id, "ord", "type", "key", "fields"])

    kind = dict(files.dtypes)[file_id]
    return files.select(file_id, text).mapInPandas(run, f"{file_id} {kind}, ord int, type string, key string, fields map<string,string>")


def names(text: str) -> list[dict[str, str]]:
    """A list of names, split at `and` outside braces, as first, von and last."""
    parts, depth, start = [], 0, 0
    for m in re.finditer(r"[{}]|\s+and\s+", text):
        if m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
        elif depth == 0:
            parts.append(text[start : m.start()])
            start = m.end()
    parts.append(text[start:])
    out = []
    for part in filter(None, map(str.strip, parts)):
        pieces = [p.strip() for p in re.split(r",(?![^{]*})", part)]
        words = re.findall(r"(?:\{[^{}]*\}|[^\s{}])+", pieces[0])
        if len(pieces) > 1:
            first = pieces[-1]
            k = next((i for i, w in enumerate(words) if not w[0].islower()), len(words))
            von, last = words[:k], words[k:]
        else:
            low = [i for i, w in enumerate(words[:-1]) if w[0].islower()]
            a = low[0] if low else len(words) - 1
            b = low[-1] + 1 if low else a
            first, von, last = " ".join(words[:a]), words[a:b], words[b:]
        out.append({"first": first, "von": " ".join(von), "last": " ".join(last)})
    return out


def crossrefs(bib: DataFrame, by: list[str]) -> DataFrame:
    """Entries with the fields of the one they cross-refer to that they have not; its
    title stands for a missing booktitle. Exact keys first, then regardless of case.
    Empty fields count as missing."""
    full = bib.withColumn("fields", F.map_filter("fields", lambda k, v: v != ""))
    target = full.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("key").alias("_key"), "fields")
    exact = target.select(*[f"_{c}" for c in by], "_key", F.col("fields").alias("_exact")).dropDuplicates([*[f"_{c}" for c in by], "_key"])
    folded = target.groupBy(*[f"_{c}" for c in by], F.lower("_key").alias("_low")).agg(F.first("fields").alias("_any"))
    ref = F.col("fields")["crossref"]
    on = lambda other: [F.col(c) == other[f"_{c}"] for c in by]
    one = full.withColumn("_ref", ref).join(exact, [*on(exact), F.col("_ref") == exact._key], "left").drop(*[f"_{c}" for c in by], "_key")
    two = one.join(folded, [*on(folded), F.lower("_ref") == folded._low], "left").drop(*[f"_{c}" for c in by])
    parent = F.coalesce("_exact", "_any", F.create_map().cast("map<string,string>"))
    own = F.col("fields")
    title = F.when(F.map_contains_key(parent, "title") & ~F.map_contains_key(own, "booktitle"), F.create_map(F.lit("booktitle"), parent["title"])).otherwise(F.create_map().cast("map<string,string>"))
    with_title = F.map_concat(own, title)
    rest = lambda m: F.map_filter(parent, lambda k, v: ~F.map_contains_key(m, k) & ((k != "title") | F.map_contains_key(own, "booktitle")))
    return two.select(*by, "ord", "type", "key", F.map_concat(with_title, rest(with_title)).alias("fields"))
