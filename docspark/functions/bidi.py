"""The Unicode bidirectional algorithm (UAX #9): embedding levels and visual order of a
paragraph, from the character properties of the standard library."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Deepest explicit level.
DEEPEST = 125
REMOVED = {"RLE", "LRE", "RLO", "LRO", "PDF", "BN"}
ISOLATES = {"LRI", "RLI", "FSI"}
NEUTRAL = {"B", "S", "WS", "ON", "PDI", *ISOLATES}


def _pairs() -> tuple[dict[str, str], dict[str, str]]:
    """Opening brackets with their closing ones, by names that differ in one word."""
    opens, closes = {}, {}
    for cp in (*range(0x28, 0x2E00), *range(0x2E00, 0x3020), *range(0xFE59, 0xFE5F), *range(0xFF08, 0xFF64)):
        c = chr(cp)
        if unicodedata.category(c) == "Ps" and unicodedata.bidirectional(c) == "ON":
            other = unicodedata.name(c, "").replace("LEFT", "RIGHT")
            try:
                end = unicodedata.lookup(other)
            except KeyError:
                continue
            if end != c and unicodedata.category(end) == "Pe":
                # the canonical form of angle brackets stands for both
                opens[c], closes[end] = unicodedata.normalize("NFD", end), unicodedata.normalize("NFD", end)
    return opens, closes


_BRACKETS: list[tuple[dict[str, str], dict[str, str]]] = []


def _first_strong(kinds: list[str], start: int, stop: int) -> int | None:
    """Level of the first strong character, what stands in isolates aside."""
    depth = 0
    for k in kinds[start:stop]:
        if k in ISOLATES:
            depth += 1
        elif k == "PDI":
            depth = max(0, depth - 1)
        elif not depth and k in ("L", "R", "AL"):
            return int(k != "L")
    return None


def _matching(kinds: list[str]) -> dict[int, int]:
    out, stack = {}, []
    for i, k in enumerate(kinds):
        if k in ISOLATES:
            stack.append(i)
        elif k == "PDI" and stack:
            out[stack.pop()] = i
    return out


def levels(text: str, base: int | None = None) -> list[int]:
    """The level of each character; base None takes it from the text."""
    original = [unicodedata.bidirectional(c) or "L" for c in text]
    kinds, n = list(original), len(text)
    if base is None:
        base = _first_strong(kinds, 0, n) or 0
    ends = _matching(kinds)
    level = [base] * n
    # explicit levels: a stack of (level, override, isolate)
    stack: list[tuple[int, str | None, bool]] = [(base, None, False)]
    over_isolates = over_embeddings = valid = 0
    for i, k in enumerate(original):
        top, override, _ = stack[-1]
        if k in ("RLE", "LRE", "RLO", "LRO", *ISOLATES):
            isolate, right = k in ISOLATES, k in ("RLE", "RLO", "RLI")
            if k == "FSI":
                right = bool(_first_strong(original, i + 1, ends.get(i, n)))
            level[i] = top
            if isolate and override:
                kinds[i] = override
            up = (top + 1) | 1 if right else (top + 2) & ~1
            if up <= DEEPEST and not over_isolates and not over_embeddings:
                valid += isolate
                stack.append((up, {"RLO": "R", "LRO": "L"}.get(k), isolate))
            elif isolate:
                over_isolates += 1
            elif not over_isolates:
                over_embeddings += 1
        elif k == "PDI":
            if over_isolates:
                over_isolates -= 1
            elif valid:
                over_embeddings = 0
                while not stack[-1][2]:
                    stack.pop()
                stack.pop()
                valid -= 1
            level[i] = stack[-1][0]
            if stack[-1][1]:
                kinds[i] = stack[-1][1]
        elif k == "PDF":
            level[i] = top
            if over_isolates:
                pass
            elif over_embeddings:
                over_embeddings -= 1
            elif len(stack) > 1 and not stack[-1][2]:
                stack.pop()
        elif k == "B":
            level[i] = base
        else:
            level[i] = top
            if override and k != "BN":
                kinds[i] = override
    _resolve(text, original, kinds, level, base, ends)
    # separators, and white space before them or at the end, go back to the base
    back = True
    for i in range(n - 1, -1, -1):
        k = original[i]
        if k in ("B", "S"):
            level[i], back = base, True
        elif k in ("WS", "PDI", *ISOLATES, *REMOVED):
            if back:
                level[i] = base
        else:
            back = False
    return level


def _resolve(text: str, original: list[str], kinds: list[str], level: list[int], base: int, ends: dict[int, int]) -> None:
    """Weak, paired and neutral types and implicit levels, by isolating run sequences."""
    kept = [i for i, k in enumerate(original) if k not in REMOVED]
    runs: list[list[int]] = []
    for i in kept:
        if runs and level[runs[-1][-1]] == level[i] and not (original[runs[-1][-1]] in ISOLATES and runs[-1][-1] in ends) and not (original[i] == "PDI" and i in ends.values()):
            runs[-1].append(i)
        else:
            runs.append([i])
    begins = {r[0]: r for r in runs}
    for run in runs:
        if original[run[0]] == "PDI" and run[0] in ends.values():
            continue  # it goes on a run that an isolate ends
        sequence = list(run)
        while original[sequence[-1]] in ISOLATES and sequence[-1] in ends and ends[sequence[-1]] in begins:
            sequence += begins[ends[sequence[-1]]]
        _sequence(text, original, kinds, level, base, sequence, kept, ends)
    for i, k in enumerate(original):
        if k in REMOVED:  # as the character before
            level[i] = level[i - 1] if i else base


def _sequence(text: str, original: list[str], kinds: list[str], level: list[int], base: int, seq: list[int], kept: list[int], ends: dict[int, int]) -> None:
    own = level[seq[0]]
    before = max((i for i in kept if i < seq[0]), default=None)
    after = None if original[seq[-1]] in ISOLATES and seq[-1] not in ends else min((i for i in kept if i > seq[-1]), default=None)
    side = lambda other: "R" if max(own, base if other is None else level[other]) % 2 else "L"
    sos, eos = side(before), side(after)
    t = [kinds[i] for i in seq]
    n = len(t)
    # weak types
    last, strong = sos, sos
    for j in range(n):
        if t[j] == "NSM":
            t[j] = "ON" if j and (t[j - 1] == "PDI" or t[j - 1] in ISOLATES) else last
        if t[j] == "EN" and strong == "AL":
            t[j] = "AN"
        if t[j] in ("L", "R", "AL"):
            strong = t[j]
        last = t[j]
    t = ["R" if k == "AL" else k for k in t]
    for j in range(1, n - 1):
        if t[j] == "ES" and t[j - 1] == t[j + 1] == "EN":
            t[j] = "EN"
        elif t[j] == "CS" and t[j - 1] == t[j + 1] and t[j - 1] in ("EN", "AN"):
            t[j] = t[j - 1]
    j = 0
    while j < n:
        if t[j] == "ET":
            k = j
            while k < n and t[k] == "ET":
                k += 1
            if (j and t[j - 1] == "EN") or (k < n and t[k] == "EN"):
                t[j:k] = ["EN"] * (k - j)
            j = k
        else:
            j += 1
    strong = sos
    for j in range(n):
        if t[j] in ("ES", "ET", "CS"):
            t[j] = "ON"
        if t[j] in ("L", "R"):
            strong = t[j]
        elif t[j] == "EN" and strong == "L":
            t[j] = "L"
    _brackets(text, original, seq, t, sos, "R" if own % 2 else "L")
    # neutrals take what stands on both sides, else the embedding
    as_strong = lambda k: "R" if k in ("R", "EN", "AN") else k
    j = 0
    while j < n:
        if t[j] in NEUTRAL:
            k = j
            while k < n and t[k] in NEUTRAL:
                k += 1
            left, right = as_strong(t[j - 1]) if j else sos, as_strong(t[k]) if k < n else eos
            t[j:k] = [left if left == right else "R" if own % 2 else "L"] * (k - j)
            j = k
        else:
            j += 1
    for i, k in zip(seq, t, strict=True):
        level[i] += (k in ("L", "EN", "AN")) if own % 2 else {"R": 1, "AN": 2, "EN": 2}.get(k, 0)


def _brackets(text: str, original: list[str], seq: list[int], t: list[str], sos: str, embedding: str) -> None:
    """Paired brackets take a direction together."""
    if not _BRACKETS:
        _BRACKETS.append(_pairs())
    opens, closes = _BRACKETS[0]
    stack, found = [], []
    for j, i in enumerate(seq):
        c = text[i]
        if t[j] != "ON":
            continue
        if c in opens:
            if len(stack) == 63:
                return
            stack.append((opens[c], j))
        elif c in closes:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == closes[c]:
                    found.append((stack[k][1], j))
                    del stack[k:]
                    break
    as_strong = lambda k: "R" if k in ("R", "EN", "AN") else k if k == "L" else None
    for a, b in sorted(found):
        inside = {as_strong(k) for k in t[a + 1 : b]} - {None}
        if embedding in inside:
            kind = embedding
        elif inside:
            before = next((s for k in reversed(t[:a]) if (s := as_strong(k))), sos)
            kind = before if before != embedding else embedding
        else:
            continue
        for j in (a, b):
            t[j] = kind
            for k in range(j + 1, len(t)):  # marks on a bracket go with it
                if original[seq[k]] != "NSM":
                    break
                t[k] = kind


def visual(text: str, base: int | None = None) -> str:
    """The text in the order in which it is seen from left to right, mirrored characters
    and removed controls aside."""
    order, level = list(range(len(text))), levels(text, base)
    for step in range(max(level, default=0), min((x for x in level if x % 2), default=1) - 1, -1):
        i = 0
        while i < len(order):
            if level[order[i]] >= step:
                j = i
                while j < len(order) and level[order[j]] >= step:
                    j += 1
                order[i:j] = order[i:j][::-1]
                i = j
            else:
                i += 1
    return "".join(text[i] for i in order)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def bidi_levels(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in text:
        yield t.fillna("").map(levels)


@F.pandas_udf(T.StringType())
def visual_order(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in text:
        yield t.fillna("").map(visual)
