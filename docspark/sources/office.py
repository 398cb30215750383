"""Packages of Office files (DOCX, PPTX), RTF and LaTeX to rows of paragraphs.
Each is read by itself; archives are bounded in what they may unpack to."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
LIMIT = 256 << 20


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if z.getinfo(name).file_size > LIMIT:
        raise ValueError(f"{name} is too large")
    raw = z.read(name)
    if b"<!DOCTYPE" in raw[:4096]:
        raise ValueError(f"{name} has a document type")
    return ElementTree.fromstring(raw)


def docx(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(role, level, part, text) in order; deleted runs are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for p in _part(z, "word/document.xml").iter(f"{WORD}p"):
            style = p.find(f"{WORD}pPr/{WORD}pStyle")
            name = style.get(f"{WORD}val", "") if style is not None else ""
            m = re.fullmatch(r"[Hh]eading ?([1-6])", name)
            text = "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(x.tag.removeprefix(WORD), "") for x in p.iter() if x.tag != f"{WORD}delText")
            yield ("heading" if m else "title" if name == "Title" else "body"), int(m[1]) if m else 0, 0, text


def pptx(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """Paragraphs by slide, in the slides' order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for k, (_, name) in enumerate(slides, 1):
            for p in _part(z, name).iter(f"{DRAW}p"):
                yield "body", 0, k, "".join(x.text or "" if x.tag == f"{DRAW}t" else "\n" for x in p.iter() if x.tag in (f"{DRAW}t", f"{DRAW}br"))


#: Groups of an RTF file that hold no text, and words that stand for a character (fixed values).
RTF_SKIP = set("fonttbl colortbl stylesheet info pict object header footer listtable listoverridetable generator themedata datastore".split())
RTF_CHARS = {"tab": "\t", "line": "\n", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}
_RTF = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")


def rtf(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    out, stack, skip, fallback, pending = "", [], False, 1, 0
    for m in _RTF.finditer(content.decode("latin-1")):
        word, number, code, symbol, brace, plain = m.groups()
        if brace == "{":
            stack.append((skip, fallback))
        elif brace == "}":
            skip, fallback = stack.pop() if stack else (False, 1)
        elif word in RTF_SKIP or symbol == "*":
            skip = True
        elif skip:
            continue
        elif word == "par":
            yield "body", 0, 0, out
            out = ""
        elif word == "uc":
            fallback = int(number or 1)
        elif word == "u" and number:
            n = int(number) % 65_536
            if 0xDC00 <= n < 0xE000 and out and 0xD800 <= ord(out[-1]) < 0xDC00:
                out = out[:-1] + chr(0x10000 + ((ord(out[-1]) - 0xD800) << 10) + n - 0xDC00)
            else:
                out += chr(n)
            pending = fallback
        elif word:
            out += RTF_CHARS.get(word, "")
        else:
            text = bytes([int(code, 16)]).decode("cp1252", "replace") if code else {"~": "\xa0", "_": "‑", "-": "\xad"}.get(symbol, symbol if symbol in ("\\", "{", "}") else "") if symbol else plain or ""
            taken = min(pending, len(text))
            out, pending = out + text[taken:], pending - taken
    if out.strip():
        yield "body", 0, 0, out.encode("utf-8", "replace").decode()


SECTIONS = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "c": "\u0327"}


def latex(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """Sections, items and paragraphs of the body; comments and unknown commands go,
    their arguments stay."""
    import unicodedata

    src = re.sub(r"(?<!\\)%[^\n]*\n?", "", content.decode("utf-8", "replace"))
    m = re.search(r"\\begin\{document\}(.*?)(?:\\end\{document\}|\Z)", src, re.S)
    src = m[1] if m else src

    def plain(s: str) -> str:
        s = re.sub(r"\\(['`^\"~c])\{?([A-Za-z])\}?", lambda a: unicodedata.normalize("NFC", a[2] + ACCENTS[a[1]]), s)
        s = s.replace("---", "—").replace("--", "–").replace("``", "“").replace("''", "”").replace("~", "\xa0").replace("\\\\", "\n")
        s = re.sub(r"\\(?:begin|end)\{[^}]*\}|\\[A-Za-z]+\*?(?:\[[^\]]*\])? ?", "", s)
        return re.sub(r"[ \t\r\f\v]+", " ", re.sub(r"\\([#$%&_{}])|[{}]", lambda a: a[1] or "", s)).strip()

    pattern = r"(\\(?:chapter|section|subsection|subsubsection|paragraph)\*?\{(?:[^{}]|\{[^{}]*\})*\}|\\item\b|\n[ \t]*\n)"
    role = "body"
    for part in re.split(pattern, src):
        if h := re.match(r"\\(chapter|section|subsection|subsubsection|paragraph)\*?\{(.*)\}\Z", part, re.S):
            yield "heading", SECTIONS[h[1]], 0, plain(h[2])
            role = "body"
        elif part == r"\item":
            role = "item"
        elif text := plain(part.replace("\n", " ")):
            yield role, 0, 0, text
            role = "body"


READERS = {"docx": docx, "pptx": pptx, "rtf": rtf, "latex": latex}


def paragraphs(files: DataFrame, key: str, content: str, fmt: str) -> DataFrame:
    """key, ord, role, level, part (a slide's number), text; a file that can't be read
    gives one row of role error."""
    reader = READERS[fmt]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple] = []
            for k, raw in zip(f[key], f[content], strict=True):
                try:
                    found = list(reader(bytes(raw or b"")))
                except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as e:
                    found = [("error", 0, 0, str(e))]
                rows += [(k, i, *x) for i, x in enumerate(found)]
            yield pd.DataFrame(rows, columns=[key, "ord", "role", "level", "part", "text"])

    return files.select(key, content).mapInPandas(run, f"{key} {dict(files.dtypes)[key]}, ord int, role string, level int, part int, text string")


def docx_bytes(paragraph_texts: list[str]) -> bytes:
    """The least package that word processors open."""
    from xml.sax.saxutils import escape

    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for t in paragraph_texts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{WORD[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def write_docx(blocks: DataFrame, key: str, texts: str) -> DataFrame:
    """key, content: a package from an ordered array of paragraphs; a null array has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "content": [docx_bytes([x or "" for x in (t if t is not None else ())]) for t in f[texts]]})

    return blocks.select(key, texts).mapInPandas(run, f"{key} {dict(blocks.dtypes)[key]}, content binary")
