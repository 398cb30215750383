"""Colours of a theme, and sizes of pictures from their first bytes. The PNG and
GIF headers stand at fixed places and are read natively; a JPEG's has to be
looked for."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lum_adjusted(rgb: Column, mod: Column, off: Column) -> Column:
    """A colour with its lightness (of hue, saturation and lightness) scaled by mod and
    moved by off, both in thousandths of a per cent. Scaling lightness keeps hue and
    saturation, so each channel keeps its place between the least and the greatest."""
    r, g, b = (F.shiftright(rgb, s).bitwiseAND(F.lit(255)) / 255.0 for s in (16, 8, 0))

    def extremes(c: Column) -> Column:
        return _let(F.struct(c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"), F.greatest(c["r"], c["g"], c["b"]).alias("top"), F.least(c["r"], c["g"], c["b"]).alias("low")), moved)

    def moved(c: Column) -> Column:
        span, light = c["top"] - c["low"], (c["top"] + c["low"]) / 2
        saturation = F.when(span < 1e-9, 0.0).when(light > 0.5, span / (2 - c["top"] - c["low"])).otherwise(span / F.nullif(c["top"] + c["low"], F.lit(0.0)))
        new = F.least(F.lit(1.0), F.greatest(F.lit(0.0), light * mod / 100_000 + off / 100_000))
        return _let(F.struct(span.alias("span"), saturation.alias("sat"), new.alias("new")), lambda m: coloured(c, m))

    def coloured(c: Column, m: Column) -> Column:
        # half of what the channels are apart; twice it is exact, so that a channel is one
        # division away from its colour and halves are rounded as its SQL rounds them
        half = F.when(m["new"] < 0.5, m["new"] * m["sat"]).otherwise(m["sat"] * (1 - m["new"]))
        return _let(half, lambda h: sum((channel(c, m, h, k) * by for k, by in (("g", 256), ("b", 1))), channel(c, m, h, "r") * 65_536))

    def channel(c: Column, m: Column, half: Column, k: str) -> Column:
        return F.floor(F.when(m["span"] < 1e-9, m["new"]).otherwise(m["new"] - half + 2 * half * (c[k] - c["low"]) / F.nullif(m["span"], F.lit(0.0))) * 255 + 0.5).cast("int")

    return _let(F.struct(r.alias("r"), g.alias("g"), b.alias("b")), extremes)


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _number(content: Column, at: int, n: int, little: bool = False) -> Column:
    raw = F.hex(F.substring(content, at + 1, n))
    if little:
        raw = F.concat(F.substring(raw, 3, 2), F.substring(raw, 1, 2))
    return F.conv(raw, 16, 10).cast("int")


@F.pandas_udf(T.StructType([T.StructField("w", T.IntegerType()), T.StructField("h", T.IntegerType())]))
def jpeg_size(content: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Width and height from the first frame header; zero if there is none."""
    for part in content:
        rows = []
        for raw in part:
            w = h = 0
            at, raw = 2, raw or b""
            while at + 9 < len(raw) and raw[at] == 0xFF:
                if raw[at + 1] in range(0xC0, 0xD0) and raw[at + 1] not in (0xC4, 0xC8, 0xCC):
                    h, w = int.from_bytes(raw[at + 5 : at + 7], "big"), int.from_bytes(raw[at + 7 : at + 9], "big")
                    break
                at += 2 + int.from_bytes(raw[at + 2 : at + 4], "big")
            rows.append((w, h))
        yield pd.DataFrame(rows, columns=["w", "h"])


def image_info(content: Column) -> Column:
    """Struct of mime, w and h for PNG and GIF; a JPEG has its mime, and jpeg_size its size."""
    head = F.hex(F.substring(content, 1, 16))
    size = F.octet_length(content)
    png = head.startswith("89504E470D0A1A0A") & head.endswith("49484452") & (size >= 24)
    gif = (head.startswith("474946383761") | head.startswith("474946383961")) & (size >= 10)
    jpeg = head.startswith("FFD8") & (size >= 4)
    mime = F.when(png, "image/png").when(gif, "image/gif").when(jpeg, "image/jpeg")
    w = F.when(png, _number(content, 16, 4)).when(gif, _number(content, 6, 2, True))
    h = F.when(png, _number(content, 20, 4)).when(gif, _number(content, 8, 2, True))
    return F.struct(mime.alias("mime"), w.alias("w"), h.alias("h"))
