"""HTML pages to rows: blocks in reading order, and links. One page is parsed at a
time within its partition; nothing is shuffled."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from .markup import tokens

# What elements are.
SKIPPED = set("head script style noscript template svg math object iframe select button".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside body center details div dl fieldset footer form header hgroup html main nav section summary".split())
PARAGRAPH = set("p dt dd address".split()) | {f"h{k}" for k in range(1, 7)}
LISTS = {"ul": "bullet", "menu": "bullet", "ol": "decimal"}
CELLS = ("td", "th")
MARKS = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "cite": "italic", "var": "italic", "dfn": "italic", "u": "underline", "ins": "underline", "s": "strike", "strike": "strike", "del": "strike", "sup": "super", "sub": "sub", "code": "code", "kbd": "code", "samp": "code", "tt": "code", "mark": "mark"}
DEPTH = 128

BLOCKS = "ord int, kind string, role string, level int, list_level int, list_kind string, task int, quote_depth int, table_no int, row_no int, col_no int, col_span int, row_span int, header boolean, div_class string, text string, links array<struct<href:string,text:string>>, marks array<struct<start:int,end:int,mark:string>>"


@dataclass
class _Open:
    name: str
    attrs: dict[str, str]
    state: dict = field(default_factory=dict)


class _Builder:
    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.stack: list[_Open] = []
        self.para: dict | None = None
        self.tables = 0

    # where we are
    def within(self, *names: str) -> _Open | None:
        for o in reversed(self.stack):
            if o.name in names:
                return o
            if o.name in ("td", "th", "figure") and not (set(names) & {"td", "th", "tr", "table", "figure", "blockquote"}):
                return None
        return None

    def start(self) -> dict:
        if self.para is None:
            quotes = sum(o.name == "blockquote" for o in self.stack)
            lists = [o for o in self.stack if o.name in LISTS]
            heading = next((o for o in reversed(self.stack) if re.fullmatch("h[1-6]", o.name)), None)
            item, cell = self.within("li"), next((o for o in reversed(self.stack) if o.name in CELLS), None)
            div = next((o.attrs["class"] for o in reversed(self.stack) if o.name == "div" and o.attrs.get("class")), None)
            role = "body"
            if heading:
                role = "title" if "title" in heading.attrs.get("class", "").split() else "heading"
            elif self.within("pre"):
                role = "code"
            elif self.within("caption", "figcaption"):
                role = "caption"
            elif self.within("dt"):
                role = "term"
            elif self.within("dd"):
                role = "definition"
            elif quotes:
                role = "quote"
            first = item is not None and not item.state.get("begun")
            if item is not None:
                item.state["begun"] = True
            self.para = {
                "kind": "paragraph", "role": role, "level": int(heading.name[1]) if heading else 0,
                "list_level": min(8, len(lists) - 1) if lists and item else None, "list_kind": LISTS[lists[-1].name] if lists and first else None,
                "task": item.state.get("task", 0) if first else 0, "quote_depth": min(9, quotes), "div_class": div, "text": "", "links": [], "marks": [],
                **({k: cell.state[k] for k in ("table_no", "row_no", "col_no", "col_span", "row_span", "header")} if cell and cell.state else {}),
            }
        return self.para

    def end(self) -> None:
        if self.para is not None:
            text = self.para["text"]
            if self.para["role"] != "code":
                self.para["text"] = text.rstrip(" ")
            size = len(self.para["text"])
            for o in self.stack:
                if "from" in o.state:
                    self.mark(o)
                    o.state["from"] = 0
            self.para["marks"] = [m for m in self.para["marks"] if m["start"] < min(size, m["end"])]
            self.rows.append(self.para)
            self.para = None

    def mark(self, o: _Open) -> None:
        if self.para is not None and o.name in MARKS:
            self.para["marks"].append({"start": o.state["from"], "end": len(self.para["text"]), "mark": MARKS[o.name]})

    def add(self, text: str) -> None:
        text = re.sub("[\x00-\x08\x0b-\x1f￼]", lambda m: " " if m[0] in "\x0b\x0c\r\x00" else "", text)
        if self.within("pre"):
            self.start()["text"] += text
        else:
            text = re.sub("[ \t\n]+", " ", text)
            if self.para is None or not self.para["text"] or self.para["text"][-1] in " \n":
                text = text.lstrip(" ")
            if not text:
                return
            self.start()["text"] += text
        link = next((o for o in reversed(self.stack) if o.name == "a" and "link" in o.state), None)
        if link:
            if link.state["link"] is None or self.para is not link.state["para"]:
                link.state["link"] = {"href": link.attrs["href"], "text": ""}
                link.state["para"] = self.para
                self.para["links"].append(link.state["link"])
            link.state["link"]["text"] += text

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            o = self.stack.pop()
            if o.name in MARKS and "from" in o.state:
                self.mark(o)
            if o.name in PARAGRAPH | BLOCK | set(LISTS) | set(CELLS) | {"li", "pre", "blockquote", "table", "tr", "figure", "figcaption", "caption"}:
                self.end()

    def close(self, name: str) -> None:
        barrier = {"td", "th", "table", "figure"}
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].name == name:
                self.pop_to(k)
                return
            if self.stack[k].name in barrier and name not in {"table", "td", "th", "tr", "figure"}:
                return

    def open(self, name: str, attrs: dict[str, str], empty: bool) -> None:
        if name == "br":
            self.start()["text"] += "\n"
            return
        if name == "hr":
            self.end()
            self.rows.append({"kind": "break", "role": "rule", "text": ""})
            return
        if name == "input" and attrs.get("type") == "checkbox" and (item := self.within("li")):
            item.state["task"] = 2 if "checked" in attrs else 1
            return
        if name in VOID:
            return
        if name in PARAGRAPH | BLOCK | set(LISTS) | {"li", "pre", "blockquote", "table", "figure", "figcaption", "caption", "tr", "td", "th"}:
            if name in PARAGRAPH and self.within("p"):
                self.close("p")
            if name == "li" and self.within("li", *LISTS) and self.within("li", *LISTS).name == "li":
                self.close("li")
            if name in CELLS:
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k].name in CELLS:
                        self.pop_to(k)
                        break
                    if self.stack[k].name in ("tr", "table"):
                        break
            self.end()
        if empty or len(self.stack) >= DEPTH:
            return
        o = _Open(name, attrs)
        if name == "table":
            self.tables += 1
            o.state = {"table": self.tables, "row": -1}
        elif name in CELLS and (t := next((x for x in reversed(self.stack) if x.name == "table"), None)):
            number = lambda a: int(attrs[a]) if attrs.get(a, "").isdigit() and 0 < int(attrs[a]) <= 1024 else 1
            if t.state["row"] < 0:
                t.state.update(row=0, col=0)
            o.state = {"table_no": t.state["table"], "row_no": t.state["row"], "col_no": t.state["col"], "col_span": number("colspan"), "row_span": number("rowspan"), "header": name == "th"}
            t.state["col"] += o.state["col_span"]
        elif name == "tr" and (t := next((x for x in reversed(self.stack) if x.name == "table"), None)):
            t.state.update(row=t.state["row"] + 1, col=0)
        elif name == "a" and attrs.get("href") and not attrs["href"].startswith("#"):
            o.state = {"link": None, "para": None}
        elif name in MARKS:
            o.state = {"from": len(self.para["text"]) if self.para else 0}
        self.stack.append(o)


def parse(text: str) -> list[dict]:
    """Blocks of a page. An empty page is one empty paragraph."""
    b, skip, depth = _Builder(), "", 0
    for kind, name, attrs in tokens(text or ""):
        if skip:
            if kind == "open" and name == skip:
                depth += 1
            elif kind == "close" and name == skip:
                depth -= 1
                if not depth:
                    skip = ""
        elif kind == "text":
            b.add(name)
        elif kind == "close":
            b.close(name)
        elif name in SKIPPED and kind == "open":
            skip, depth = name, 1
        else:
            b.open(name, attrs, kind == "empty" or name in VOID)
    b.pop_to(0)
    b.end()
    return b.rows or [{"kind": "paragraph", "role": "body", "level": 0, "text": ""}]


FIELDS = ["kind", "role", "level", "list_level", "list_kind", "task", "quote_depth", "table_no", "row_no", "col_no", "col_span", "row_span", "header", "div_class", "text", "links", "marks"]


def blocks(pages: DataFrame, page_id: str, html: str, parser=parse) -> DataFrame:
    """page_id, ord and a block's columns, for every block of every page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, *(r.get(c) for c in FIELDS)) for i, t in zip(f[page_id], f[html], strict=True) for k, r in enumerate(parser(t or ""))]
            out = pd.DataFrame(rows, columns=[page_id, "ord", *FIELDS])
            for c in ("level", "list_level", "task", "quote_depth", "table_no", "row_no", "col_no", "col_span", "row_span"):
                out[c] = out[c].astype("Int32")
            out["header"] = out["header"].astype("boolean")
            yield out

    kind = dict(pages.dtypes)[page_id]
    return pages.select(page_id, html).mapInPandas(run, f"{page_id} {kind}, {BLOCKS}")
