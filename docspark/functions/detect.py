"""Which format a document is in, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: C's isspace, as a character class.
SPACE = "[ \\t\\n\\x0B\\f\\r]"
#: A line that begins a Markdown block, or an inline link or strong mark.
MARKDOWN = r"(?s)(?:\A|\n)(?:#[ #].|```.|[-*+] .|> .|\|(?:..+\||.\|.|\|..))|\*\*..|\]\(.."


def detect_format(text: Column) -> Column:
    """pptx, docx, rtf, jdata, html, markdown or text; null and blank are text."""
    s = F.regexp_replace(text, f"\\A\\x{{FEFF}}?{SPACE}*", "")
    where = F.instr(F.substring(s, 1, 209), "_DataInfo_")
    package = F.when(F.instr(text, "ppt/presentation.xml") > 0, "pptx").otherwise("docx")
    return (
        F.when(text.startswith("PK\x03\x04"), package)
        .when(s.startswith("{\\rtf"), "rtf")
        .when(s.startswith("{") & (where > 0) & (F.length(s) > F.greatest(where + 9, F.lit(12))), "jdata")
        .when(s.startswith("<"), "html")
        .when(s.rlike(MARKDOWN), "markdown")
        .otherwise("text")
    )


def utf8_or_latin(content: Column) -> Column:
    """Bytes to text: UTF-8 where they are valid, else Windows-1252."""
    plain = F.decode(content, "iso-8859-1")
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.translate(plain, C1, WINDOWS))


#: The C1 controls and what Windows-1252 has in their places (fixed values); the five it leaves open stay as they are.
C1 = "".join(map(chr, range(0x80, 0xA0)))
WINDOWS = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
