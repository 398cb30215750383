"""Markup tokens: tolerant, as documents from the web need it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import name2codepoint

#: Named entities that are read; any other stays a literal ampersand (fixed values).
NAMES = """amp lt gt quot nbsp copy reg trade mdash ndash hellip lsquo rsquo ldquo rdquo sbquo bdquo laquo raquo bull middot
times divide deg plusmn micro para sect euro pound yen cent shy ensp emsp thinsp zwj zwnj dagger Dagger larr rarr uarr darr
harr le ge ne asymp infin sum prod minus radic alpha beta gamma delta epsilon lambda mu pi sigma omega Delta Omega iexcl
iquest frac12 frac14 frac34 sup2 sup3 ordm ordf Agrave Aacute Auml Ccedil Egrave Eacute Ouml Uuml szlig agrave aacute acirc
auml aring ccedil egrave eacute ecirc euml iacute ntilde oacute ocirc ouml uacute uuml oslash Oslash aelig AElig"""
ENTITIES = {n: chr(name2codepoint[n]) for n in NAMES.split()} | {"apos": "'"}

_ENTITY = re.compile(r"&(?:#[xX]([0-9A-Fa-f]{1,29})|#([0-9]{1,30})|([A-Za-z0-9]{1,31}));?")
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9:._-]*")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose bodies are no text of the document.
RAW = ("script", "style", "title")


def decoded(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[3]:
            return ENTITIES.get(m[3], m[0])
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"

    return _ENTITY.sub(one, text) if "&" in text else text


def _tag_end(text: str, at: int) -> int:
    """The first > outside quotes, or the end of the text."""
    quote = ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == ">":
            return i
    return len(text)


def tokens(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, name or text, attributes): kind is text, open, close or empty. A < that
    begins no tag is text; comments, doctypes and instructions are not reported."""
    at, n = 0, len(text)
    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield "text", decoded(text[at:lt]), {}
        at = lt
        if at >= n:
            return
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            at = n if end < 0 else end + 3
        elif text.startswith("<![CDATA[", at):
            end = text.find("]]>", at)
            yield "text", text[at + 9 : n if end < 0 else end], {}
            at = n if end < 0 else end + 3
        elif text[at + 1 : at + 2] in ("!", "?"):
            end = text.find(">", at)
            at = n if end < 0 else end + 1
        elif m := _NAME.match(text, at + 2 if text[at + 1 : at + 2] == "/" else at + 1):
            name, end = m[0].lower(), _tag_end(text, m.end())
            if text[at + 1] == "/":
                yield "close", name, {}
                at = end + 1
                continue
            inner = text[m.end() : end]
            empty = inner.endswith("/")
            attrs = {a[1].lower(): decoded(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(inner[:-1] if empty else inner)}
            yield "empty" if empty else "open", name, attrs
            at = end + 1
            if name in RAW and not empty:
                close = re.compile(f"</{name}", re.I).search(text, at)
                at = close.start() if close else n
        else:
            yield "text", "<", {}
            at += 1
