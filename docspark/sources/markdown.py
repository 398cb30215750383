"""Markdown to blocks, in the columns of the HTML source: front matter, ATX and
setext headings, fences, indented code, quotes, lists with tasks, pipe tables,
rules, and inline marks and links."""

from __future__ import annotations

import re

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:( {1,4})(?=\S)|$)")
_DELIM = re.compile(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_REF = re.compile(r" {0,3}\[([^\]\[]+)\]:\s*<?([^\s>]+)>?(?:\s+[\"'(].*[\"')])?\s*$")
_LINK = re.compile(r"\[([^\]\[]*)\](?:\(\s*<?([^()\s<>]*)>?(?:\s+\"[^\"]*\")?\s*\)|\[([^\]\[]*)\])?")
_STRONG = re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1")
_EM = re.compile(r"(?<![\w*])\*(?=[^\s*])(.+?)(?<=[^\s*])\*(?!\*)|(?<!\w)_(?=\S)(.+?)(?<=\S)_(?!\w)")
_STRIKE = re.compile(r"~~(?=\S)(.+?)(?<=\S)~~")
_CODE = re.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)


def label(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip().lower()


def inline(text: str, refs: dict[str, str]) -> tuple[str, list[dict], list[dict]]:
    """Plain text, links and marks of a paragraph's source."""
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\ue000{len(kept) - 1}\ue001"

    text = text.replace("\ue000", "").replace("\ue001", "")
    text = _CODE.sub(lambda m: "\ue010" + keep(re.sub(r"\s", " ", m[2]).strip() or m[2]) + "\ue011", text)
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: keep(m[1]), text)
    text = re.sub(r"(?: {2,}|\\)\n", "\ue012", text).replace("\n", " ").replace("\ue012", "\n")
    found: list[str] = []

    def link(m: re.Match) -> str:
        target = m[2] if m[2] is not None else refs.get(label(m[3] or m[1]))
        if target is None:
            return m[0]
        found.append(target)
        return f"\ue020{len(found) - 1}\ue021{m[1]}\ue022"

    text = _LINK.sub(link, text)
    for pattern, a, z in ((_STRONG, "\ue013", "\ue014"), (_EM, "\ue015", "\ue016"), (_STRIKE, "\ue017", "\ue018")):
        text = pattern.sub(lambda m, a=a, z=z, s=pattern is _STRONG: a + (m[2] if s else next(g for g in m.groups() if g is not None)) + z, text)
    out, marks, links, open_ = "", [], [], []
    names = {"\ue010": "code", "\ue013": "bold", "\ue015": "italic", "\ue017": "strike"}
    for part in re.findall("\ue000\\d+\ue001|\ue020\\d+\ue021|[\ue010-\ue018\ue022]|[^\ue000-\ue022]+", text):
        if part[0] == "\ue000":
            out += kept[int(part[1:-1])]
        elif part[0] == "\ue020":
            open_.append(("link", len(out), found[int(part[1:-1])]))
        elif part in names:
            open_.append((names[part], len(out), ""))
        elif "\ue010" <= part[0] <= "\ue022":
            if open_:
                kind, start, target = open_.pop()
                if kind == "link":
                    links.append({"href": target, "text": out[start:]})
                else:
                    marks.append({"start": start, "end": len(out), "mark": kind})
        else:
            out += part
    return out, links, marks


def cells(line: str) -> list[str]:
    line = line.strip().removeprefix("|")
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


class _Parser:
    def __init__(self, text: str):
        self.lines = re.split(r"\r\n|\n|\r", text)
        self.rows: list[dict] = []
        self.refs: dict[str, str] = {}
        self.tables = 0
        if self.lines and self.lines[0] == "---":
            end = next((i for i, x in enumerate(self.lines[1:], 1) if x in ("---", "...")), None)
            if end and end > 1:
                self.lines = self.lines[end + 1 :]
        fence = ""
        for i, x in enumerate(self.lines):
            if m := _FENCE.match(x):
                fence = "" if fence and m[1].startswith(fence) else fence or m[1]
            if not fence and (m := _REF.match(x.lstrip("> "))) and not m[1].startswith("^"):
                self.refs.setdefault(label(m[1]), m[2])
                self.lines[i] = ""

    def put(self, role: str, text: str, raw: bool = False, **more) -> None:
        shown, links, marks = (text, [], []) if raw else inline(text, self.refs)
        self.rows.append({"kind": "paragraph", "role": role, "level": 0, "quote_depth": 0, "text": shown, "links": links, "marks": marks} | more)

    def run(self, lines: list[str], quote: int, depth: int, item: dict) -> None:
        """Blocks of lines whose container marks are taken off. item: list columns for
        the next paragraph; later ones have the level alone."""
        i, para = 0, []

        def more() -> dict:
            out = {"quote_depth": min(9, quote), **item}
            item.pop("list_kind", None)
            item.pop("task", None)
            return out

        def flush(role: str = "", level: int = 0) -> None:
            if para:
                self.put(role or ("quote" if quote else "body"), "\n".join(x.strip() if k else x.lstrip() for k, x in enumerate(para)).rstrip(), level=level, **more())
                para.clear()

        while i < len(lines):
            x = lines[i]
            if not x.strip():
                flush()
            elif m := _FENCE.match(x):
                flush()
                body = []
                i += 1
                while i < len(lines) and not re.fullmatch(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*", lines[i]):
                    body.append(lines[i])
                    i += 1
                self.put("code", "\n".join(body), raw=True, **more())
            elif x.startswith("    ") and not para:
                body = []
                while i < len(lines) and (lines[i].startswith("    ") or not lines[i].strip()):
                    body.append(lines[i][4:])
                    i += 1
                self.put("code", "\n".join(body).rstrip("\n"), raw=True, **more())
                continue
            elif m := _ATX.match(x):
                flush()
                self.put("heading", m[2] or "", level=len(m[1]), **more())
            elif para and re.fullmatch(r" {0,3}(=+|-+)\s*", x):
                flush("heading", 1 if "=" in x else 2)
            elif _RULE.match(x):
                flush()
                self.rows.append({"kind": "break", "role": "rule", "text": ""})
            elif m := re.match(r" {0,3}> ?", x):
                flush()
                body = []
                while i < len(lines) and (lines[i].lstrip()[:1] == ">" or (lines[i].strip() and body and body[-1].strip() and not _ITEM.match(lines[i]) and not _FENCE.match(lines[i]))):
                    body.append(re.sub(r"^ {0,3}> ?", "", lines[i]))
                    i += 1
                if depth < 64:
                    self.run(body, quote + 1, depth + 1, dict(item))
                else:  # nested deeper, the lines are text
                    self.put("body", "\n".join(body), **more())
                continue
            elif (m := _ITEM.match(x)) and not (para and (not x[m.end() :].strip() or m[2][0].isdigit() and m[2][:-1] != "1")):
                flush()
                width = m.end() if x[m.end() :].strip() else len(m[1]) + len(m[2]) + 1
                body = [x[m.end() :]]
                i += 1
                while i < len(lines) and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip(" ")) >= width or (body[-1].strip() and not _ITEM.match(lines[i]) and not _FENCE.match(lines[i]) and not _ATX.match(lines[i]) and not lines[i].lstrip().startswith(">"))):
                    body.append(lines[i][width:] if lines[i][:width].strip() == "" else lines[i].lstrip())
                    i += 1
                task = re.match(r"\[([ xX])\] ", body[0])
                if task:
                    body[0] = body[0][4:]
                columns = {"list_level": min(8, item.get("list_level", -1) + 1), "list_kind": "decimal" if m[2][0].isdigit() else "bullet", "task": (2 if task[1] != " " else 1) if task else 0}
                if depth < 64:
                    self.run(body, quote, depth + 1, columns)
                else:
                    self.put("body", "\n".join(body), **more())
                continue
            elif "|" in x and not para and i + 1 < len(lines) and "-" in lines[i + 1] and _DELIM.match(lines[i + 1]) and len(cells(x)) == len(cells(lines[i + 1])):
                self.tables += 1
                width, row = len(cells(x)), 0
                while i < len(lines) and lines[i].strip() and (row or "|" in lines[i]):
                    if row != 1:
                        got = (cells(lines[i]) + [""] * width)[:width]
                        for k, c in enumerate(got):
                            self.put("body", c, table_no=self.tables, row_no=max(0, row - 1), col_no=k, col_span=1, row_span=1, header=row == 0, **more())
                    row += 1
                    i += 1
                continue
            else:
                para.append(x)
            i += 1
        flush()


def parse(text: str) -> list[dict]:
    p = _Parser(text)
    p.run(p.lines, 0, 0, {})
    return p.rows or [{"kind": "paragraph", "role": "body", "level": 0, "text": ""}]
