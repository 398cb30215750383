"""Breaking paragraphs into lines and columns into pages. Widths are whole numbers
of a fixed metric, so results are the same everywhere. First fit is a native
fold; the dynamic programs are Arrow UDFs over one paragraph a row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metric: a character, and a space's natural width, stretch and shrink.
CHAR, SPACE, STRETCH, SHRINK = 10, 10, 5, 3
# Fixed values of the cost model.
LINE, ADJACENT, TWO_HYPHENS, LAST_HYPHEN, HYPHEN = 10, 10_000, 10_000, 5_000, 50
WORST = 1_000_000_000
OVERFULL = 1 << 50


def badness(over: int, room: int) -> int:
    """Cost of stretching or shrinking by over where room is normal: a cube, uncapped."""
    if over == 0:
        return 0
    if room <= 0:
        return WORST
    return min(WORST, min(100_000, over * 1000 // room) ** 3 // 10_000_000)


def tex_badness(over: int, room: int) -> int:
    """TeX's approximation of a hundred times the cube, at most 10000."""
    if over == 0:
        return 0
    if room <= 0:
        return 10_000
    r = over * 297 // room if over <= 7_230_584 else over // (room // 297) if room >= 1_663_497 else over
    return 10_000 if r > 1290 else (r**3 + (1 << 17)) >> 18


@dataclass
class Paragraph:
    """Boxes by width; joint[k] is what stands between box k and the next: a space
    (False) or a place for a hyphen (True)."""

    boxes: list[int]
    joints: list[bool]

    @classmethod
    def of(cls, text: str, points=None) -> Paragraph:
        """Words by code points; points(word) gives places for hyphens within a word."""
        boxes, joints = [], []
        for word in text.split():
            cuts = [0, *(points(word) if points else []), len(word)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                boxes.append(CHAR * (b - a))
                joints.append(b < len(word))
        return cls(boxes, joints[:-1])

    def __post_init__(self) -> None:
        self.wide, self.gaps = [0], [0]
        for k, w in enumerate(self.boxes):
            self.wide.append(self.wide[-1] + w)
            self.gaps.append(self.gaps[-1] + (k < len(self.joints) and not self.joints[k]))

    def measure(self, a: int, b: int) -> tuple[int, int, int]:
        """Natural width, stretch and shrink of a line of boxes a..b-1."""
        n = self.gaps[b - 1] - self.gaps[a]
        hyphen = CHAR if b < len(self.boxes) and self.joints[b - 1] else 0
        return self.wide[b] - self.wide[a] + n * SPACE + hyphen, n * STRETCH, n * SHRINK

    def flagged(self, b: int) -> bool:
        return 0 < b < len(self.boxes) and self.joints[b - 1]


def line_cost(p: Paragraph, a: int, b: int, width: int, bad=badness) -> tuple[int, int] | None:
    """Fitness class (0 very loose .. 3 tight) and demerits, or None if too long."""
    natural, stretch, shrink = p.measure(a, b)
    last = b == len(p.boxes)
    if natural <= width:
        cost = 0 if last else bad(width - natural, stretch)
        fit = 0 if cost > 99 else 1 if cost > 12 else 2
    elif natural - width > shrink:
        return None
    else:
        cost = bad(natural - width, shrink)
        fit = 3 if cost > 12 else 2
    d = (LINE + cost) ** 2
    if p.flagged(b):
        d += HYPHEN**2
        if p.flagged(a):
            d += TWO_HYPHENS
    if last and p.flagged(a):
        d += LAST_HYPHEN
    return fit, d


def total_fit(p: Paragraph, width: int, bad=badness, lines: int | None = None) -> tuple[list[int], int]:
    """Breaks (box counts at line ends) of least demerits, and these. With lines, of
    the breaks whose number of lines is closest to it. The state of a break is its
    line's class, and its number of lines only where that is asked for."""
    n = len(p.boxes)
    if not n:
        return [], 0
    if bad is badness and not any(p.joints):
        return _fit_words(p.boxes, width, lines)
    best: list[dict[tuple[int, int], tuple[int, int, tuple[int, int] | None]]] = [{} for _ in range(n + 1)]
    best[0][2, 0] = (0, -1, None)
    count = lines is not None
    for b in range(1, n + 1):
        for a in range(b - 1, -1, -1):
            natural, _, shrink = p.measure(a, b)
            if natural - shrink > width:
                break
            found = line_cost(p, a, b, width, bad)
            if found is None:
                continue
            fit, d = found
            for (f, k), (total, _, _) in best[a].items():
                t = total + d + (ADJACENT if a and abs(f - fit) > 1 else 0)
                key = (fit, k + 1 if count else 0)
                if key not in best[b] or t < best[b][key][0]:
                    best[b][key] = (t, a, (f, k))
        if not best[b]:  # a box wider than the line stands alone
            for (f, k), (total, _, _) in best[b - 1].items():
                key = (2, k + 1 if count else 0)
                if key not in best[b] or total + OVERFULL < best[b][key][0]:
                    best[b][key] = (total + OVERFULL, b - 1, (f, k))
    pick = min(best[n], key=lambda s: (abs(s[1] - lines) if count else 0, best[n][s][0]))
    demerits, breaks, b, state = best[n][pick][0], [], n, pick
    while b > 0:
        breaks.append(b)
        _, a, prev = best[b][state]
        b, state = a, prev
    return breaks[::-1], demerits


#: Class and demerits of lines of whole words that aren't the last, by line width and
#: then by natural width and spaces: paragraphs of one width share nearly all.
_LINES: dict[int, dict[tuple[int, int], tuple[int, int]]] = {}


def _word_line(natural: int, gaps: int, width: int, last: bool) -> tuple[int, int]:
    if natural <= width:
        cost = 0 if last else badness(width - natural, gaps * STRETCH)
        fit = 0 if cost > 99 else 1 if cost > 12 else 2
    else:
        cost = badness(natural - width, gaps * SHRINK)
        fit = 3 if cost > 12 else 2
    return fit, (LINE + cost) ** 2


def _fit_words(boxes: list[int], width: int, lines: int | None) -> tuple[list[int], int]:
    """total_fit() where only spaces are broken at: widths come from one running sum, and
    a state is one number, its class and four times its line count."""
    known = _LINES.setdefault(width, {})
    if len(known) > 1_000_000:
        known.clear()
    n, count = len(boxes), lines is not None
    at = [0] * (n + 1)
    for k, w in enumerate(boxes):
        at[k + 1] = at[k] + w + SPACE
    best: list[dict[int, tuple[int, int, int]]] = [{2: (0, -1, -1)}]
    for b in range(1, n + 1):
        here: dict[int, tuple[int, int, int]] = {}
        end, last = at[b] - SPACE, b == n
        for a in range(b - 1, -1, -1):
            natural, gaps = end - at[a], b - a - 1
            if natural - gaps * SHRINK > width:
                break
            line = _word_line(natural, gaps, width, True) if last else known.get((natural, gaps))
            if line is None:
                line = known[natural, gaps] = _word_line(natural, gaps, width, False)
            fit, d = line
            for state, (total, _, _) in best[a].items():
                t = total + d
                if a and not -2 < (state & 3) - fit < 2:
                    t += ADJACENT
                key = fit + (state & ~3) + 4 if count else fit
                old = here.get(key)
                if old is None or t < old[0]:
                    here[key] = (t, a, state)
        if not here:  # a word wider than the line stands alone
            for state, (total, _, _) in best[b - 1].items():
                key = 2 + (state & ~3) + 4 if count else 2
                if key not in here or total + OVERFULL < here[key][0]:
                    here[key] = (total + OVERFULL, b - 1, state)
        best.append(here)
    pick = min(best[n], key=lambda s: (abs((s >> 2) - lines) if count else 0, best[n][s][0]))
    total, breaks, b, state = best[n][pick][0], [], n, pick
    while b > 0:
        breaks.append(b)
        _, b, state = best[b][state]
    return breaks[::-1], total


#: Totals from here on are left to whole numbers without a bound.
_HUGE = 1 << 62


@lru_cache(16)
def _line_tables(width: int) -> tuple[np.ndarray, ...]:
    """Class and demerits by spaces and natural width, of a line and of a last line;
    -1 where the line is too long. A word has a character at least."""
    most = (width + CHAR) // (CHAR + SPACE - SHRINK) + 2
    size = width + most * SHRINK + 1
    out = [np.full((most, size), -1, np.int64) for _ in range(4)]
    for gaps in range(most):
        for natural in range(width + gaps * SHRINK + 1):
            for k, last in enumerate((False, True)):
                out[k][gaps, natural], out[2 + k][gaps, natural] = _word_line(natural, gaps, width, last)
    return tuple(out)


def fit_many(paragraphs: list[np.ndarray], width: int) -> list[tuple[list[int], int, int]]:
    """Of paragraphs given by their words' widths: breaks and demerits of total_fit(), and
    the demerits of first fit. The same program word by word for all paragraphs at once,
    so that a step is a few operations on whole arrays."""
    fit_t, fit_last, cost_t, cost_last = _line_tables(width)
    most, size = fit_t.shape
    order = sorted(range(len(paragraphs)), key=lambda k: -len(paragraphs[k]))
    out: list[tuple[list[int], int, int]] = [([], 0, 0)] * len(paragraphs)
    for i in range(0, len(order), 256):
        part = [k for k in order[i : i + 256] if len(paragraphs[k])]
        if not part:
            continue
        sizes = np.array([len(paragraphs[k]) for k in part])
        n, rows = int(sizes[0]), len(part)
        at = np.zeros((rows, n + 1), np.int64)
        for r, k in enumerate(part):
            at[r, 1 : sizes[r] + 1] = np.cumsum(paragraphs[k] + SPACE)
        cost = np.full((n + 1, 4, rows), _HUGE)
        first = np.full((n + 1, 4, rows), 99, np.int8)  # in which turn a state was found
        back = np.zeros((n + 1, 4, rows), np.int32)
        came = np.zeros((n + 1, 4, rows), np.int8)
        cost[0, 2], first[0, 2] = 0, 0
        begin, was, greedy = np.zeros(rows, np.int64), np.full(rows, 2), np.zeros(rows, np.int64)
        for b in range(1, n + 1):
            m = int(np.searchsorted(-sizes, -b, "right"))  # paragraphs with a word b
            last, w = sizes[:m] == b, min(b, most)
            starts = np.arange(b - 1, b - 1 - w, -1)
            natural = (at[:m, b] - SPACE - at[:m, starts].T).clip(max=size - 1)
            gaps = (b - 1 - starts)[:, None]
            fit = np.where(last, fit_last[gaps, natural], fit_t[gaps, natural])
            own = np.where(last, cost_last[gaps, natural], cost_t[gaps, natural])
            total, state, turn = np.full(fit.shape, _HUGE), np.zeros(fit.shape, np.int8), np.full(fit.shape, 99, np.int8)
            apart = np.where(starts > 0, ADJACENT, 0)[:, None]
            for f in range(4):
                t = cost[starts, f, :m] + apart * (np.abs(fit - f) > 1)
                when = first[starts, f, :m]
                better = (t < total) | ((t == total) & (when < turn))
                np.copyto(total, t, where=better)
                np.copyto(turn, when, where=better)
                state[better] = f
            total = np.where((fit >= 0) & (total < _HUGE), np.minimum(total + own, _HUGE), _HUGE)
            each = np.arange(m)
            for f in range(4):
                mine = fit == f
                t = np.where(mine, total, _HUGE)
                pick = t.argmin(0)
                cost[b, f, :m], back[b, f, :m], came[b, f, :m] = t[pick, each], starts[pick], state[pick, each]
                first[b, f, :m] = np.where(mine.any(0), mine.argmax(0), 99)
            alone = np.flatnonzero(~(fit >= 0).any(0))  # a word wider than the line
            if len(alone):
                t, when = cost[b - 1][:, alone], first[b - 1][:, alone]
                least = t.min(0)
                pick = np.where(t == least, when, 100).argmin(0)
                cost[b, 2, alone], back[b, 2, alone], came[b, 2, alone] = np.minimum(least + OVERFULL, _HUGE), b - 1, pick
                first[b, 2, alone] = 0
            # first fit: the line ends here if the next word doesn't fit, or there is none
            more = at[:m, min(b + 1, n)] - SPACE - at[each, begin[:m]]
            ends = np.flatnonzero(last | (more > width))
            if len(ends):
                a = begin[ends]
                wide, g = at[ends, b] - SPACE - at[ends, a], np.minimum(b - 1 - a, most - 1)
                x = wide.clip(max=size - 1)
                f, d = (np.where(last[ends], y[g, x], z[g, x]) for y, z in ((fit_last, fit_t), (cost_last, cost_t)))
                fits = wide <= width
                greedy[ends] = np.minimum(greedy[ends] + np.where(fits, d + ADJACENT * ((a > 0) & (np.abs(f - was[ends]) > 1)), OVERFULL), _HUGE)
                was[ends], begin[ends] = np.where(fits, f, 2), b
        for r, k in enumerate(part):
            b = int(sizes[r])
            t = cost[b, :, r]
            if t.min() >= _HUGE or greedy[r] >= _HUGE:
                p = Paragraph(paragraphs[k].tolist(), [False] * (b - 1))
                out[k] = (*_fit_words(p.boxes, width, None), demerits(p, first_fit(p, width), width))
                continue
            f = int(np.where(t == t.min(), first[b, :, r], 100).argmin())
            breaks, best = [], int(t.min())
            while b > 0:
                breaks.append(b)
                b, f = int(back[b, f, r]), int(came[b, f, r])
            out[k] = (breaks[::-1], best, int(greedy[r]))
    return out


#: Places of fit_lines() held at once, and the most of one paragraph; 14 bytes each.
_PLACES, _LONGEST = 4_000_000, 16_000_000
#: Totals from here on count as equal, and those that no breaks have.
_LARGE, _NONE = 1 << 61, 1 << 62


def fit_lines(paragraphs: list[np.ndarray], width: int, lines: list[int]) -> list[tuple[list[int], int]]:
    """Breaks and demerits of total_fit() with lines, of paragraphs given by their words'
    widths. The program of fit_many() with states by line count too. What a line of each
    class adds to is chosen once for a place, not for every line that begins there.
    Paragraphs that can't have so many lines, or with totals beyond whole numbers of 64
    bits, are left to the program for one."""
    order = sorted((k for k, p in enumerate(paragraphs) if len(p)), key=lambda k: -len(paragraphs[k]))
    out: list[tuple[list[int], int] | None] = [None if len(p) else ([], 0) for p in paragraphs]
    i = 0
    while i < len(order):
        n, top, part = len(paragraphs[order[i]]), 0, []
        for k in order[i : i + 256]:
            top = max(top, lines[k])
            if part and (n + 1) * (top + 1) * 4 * (len(part) + 1) > _PLACES:
                break
            part.append(k)
        i += len(part)
        part = [k for k in part if 0 < lines[k] <= len(paragraphs[k])]
        if part and (len(paragraphs[part[0]]) + 1) * (max(lines[k] for k in part) + 1) * 4 <= _LONGEST:
            for k, found in zip(part, _fit_part([paragraphs[k] for k in part], width, [lines[k] for k in part]), strict=True):
                out[k] = found
    return [_fit_words(p.tolist(), width, n) if x is None else x for x, p, n in zip(out, paragraphs, lines, strict=True)]


def _fit_part(paragraphs: list[np.ndarray], width: int, lines: list[int]) -> list[tuple[list[int], int] | None]:
    """fit_lines() of a few paragraphs, longest first."""
    fit_t, fit_last, cost_t, cost_last = _line_tables(width)
    most, size = fit_t.shape
    sizes = np.array([len(p) for p in paragraphs])
    n, rows, top = int(sizes[0]), len(sizes), max(lines) + 1
    at = np.zeros((rows, n + 1), np.int64)
    for r, p in enumerate(paragraphs):
        at[r, 1 : len(p) + 1] = np.cumsum(p + SPACE)
    # by place, class of the next line, lines so far and row: the least total, and its class
    ahead, chosen = np.full((n + 1, 4, top, rows), _NONE), np.zeros((n + 1, 4, top, rows), np.int8)
    ahead[0, :, 0], chosen[0, :, 0] = 0, 2
    # by place, class of the line that ends there, lines and row: where it began, and after which class
    back, came = np.zeros((n + 1, 4, top, rows), np.int32), np.zeros((n + 1, 4, top, rows), np.int8)
    ends: list[tuple[int, int] | None] = [None] * rows  # class and total at the end of the text
    cost, first = np.full((4, top, rows), _NONE), np.full((4, top, rows), 9999, np.int16)
    cost[2, 0], first[2, 0] = 0, 0
    for b in range(1, n + 1):
        m = int(np.searchsorted(-sizes, -b, "right"))  # paragraphs with a word b
        last, w, high = sizes[:m] == b, min(b, most), min(b, top - 1)
        starts = np.arange(b - 1, b - 1 - w, -1)
        natural = (at[:m, b] - SPACE - at[:m, starts].T).clip(max=size - 1)
        gaps = (b - 1 - starts)[:, None]
        fit = np.where(last, fit_last[gaps, natural], fit_t[gaps, natural])
        own = np.where(last, cost_last[gaps, natural], cost_t[gaps, natural])
        was, was_first = cost, first
        cost, first = np.full((4, top, m), _NONE), np.full((4, top, m), 9999, np.int16)
        kk, each = np.arange(high)[:, None], np.arange(m)
        for f in range(4):
            turns = np.flatnonzero((fit == f).any(1))
            if not len(turns):
                continue
            t = ahead[starts[turns], f, :high, :m]
            there = (fit[turns] == f)[:, None] & (t < _NONE)
            t = np.where(there, np.minimum(t + own[turns][:, None], _LARGE), _NONE)
            pick = t.argmin(0)
            a = starts[turns[pick]]
            cost[f, 1 : high + 1] = t[pick, kk, each]
            back[b, f, 1 : high + 1, :m] = a
            came[b, f, 1 : high + 1, :m] = chosen[a, f, kk, each]
            first[f, 1 : high + 1] = np.where(there.any(0), turns[there.argmax(0)], 9999)
        alone = np.flatnonzero(~(fit >= 0).any(0))  # a word wider than the line
        if len(alone):
            t, when = was[:, :high][:, :, alone], was_first[:, :high][:, :, alone]
            least = t.min(0)
            cost[2, 1 : high + 1, alone] = np.where(least < _NONE, np.minimum(least + OVERFULL, _LARGE), _NONE).T
            back[b, 2, 1 : high + 1, alone] = b - 1
            came[b, 2, 1 : high + 1, alone] = np.where(t == least, when, 10_000).argmin(0).T
            first[2, 1 : high + 1, alone] = np.where(least < _NONE, 0, 9999).T
        for g in range(4):  # of equal totals the class that came first
            best, turn, of = np.full((top, m), _NONE), np.full((top, m), 10_000, np.int16), np.zeros((top, m), np.int8)
            for f in range(4):
                t = np.where(cost[f] < _NONE, np.minimum(cost[f] + (ADJACENT if abs(f - g) > 1 else 0), _LARGE), _NONE)
                better = (t < best) | ((t == best) & (first[f] < turn))
                np.copyto(best, t, where=better)
                np.copyto(turn, first[f], where=better)
                of[better] = f
            ahead[b, g, :, :m], chosen[b, g, :, :m] = best, of
        for r in np.flatnonzero(last):
            t = cost[:, lines[r], r]
            f = int(np.where(t == t.min(), first[:, lines[r], r], 10_000).argmin())
            ends[r] = f, int(t[f])
    out: list[tuple[list[int], int] | None] = []
    for r, (f, total) in enumerate(ends):
        b, k, breaks = int(sizes[r]), lines[r], []
        while b > 0 and total < _LARGE:
            breaks.append(b)
            b, f, k = int(back[b, f, k, r]), int(came[b, f, k, r]), k - 1
        out.append((breaks[::-1], total) if total < _LARGE else None)
    return out


def first_fit(p: Paragraph, width: int) -> list[int]:
    out, a, n = [], 0, len(p.boxes)
    while a < n:
        b = a + 1
        while b < n and p.measure(a, b + 1)[0] <= width:
            b += 1
        out.append(b)
        a = b
    return out


def demerits(p: Paragraph, breaks: list[int], width: int, bad=badness) -> int:
    total, a, before = 0, 0, 2
    for b in breaks:
        found = line_cost(p, a, b, width, bad)
        if found is None:
            total, before = total + OVERFULL, 2
        else:
            total += found[1] + (ADJACENT if a and abs(found[0] - before) > 1 else 0)
            before = found[0]
        a = b
    return total


def optimal_pages(heights: list[int], height: int, stretch: list[int]) -> list[int]:
    """Column breaks of least cost over lines of given heights: squares of ten plus the
    badness of a column's gap over the stretch it holds; the last column is free."""
    n = len(heights)
    cost: list[float] = [0, *[float("inf")] * n]
    back = [0] * (n + 1)
    for b in range(1, n + 1):
        full, give = 0, 0
        for a in range(b - 1, -1, -1):
            full += heights[a]
            give += stretch[a]
            if full > height and a < b - 1:
                break
            gap = 0 if b == n else badness(max(0, height - full), give)
            c = cost[a] + (10 + gap) ** 2
            if c < cost[b]:
                cost[b], back[b] = c, a
    out, b = [], n
    while b:
        out.append(b)
        b = back[b]
    return out[::-1]


def fitted(paras: DataFrame, key: list[str], text: str, width: int, looseness: int = 0) -> DataFrame:
    """key, lines, breaks, demerits of total fit and greedy_demerits of first fit."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            boxes = [np.fromiter(map(len, (t or "").split()), np.int64) * CHAR for t in f[text]]
            found = fit_many(boxes, width)
            loose = fit_lines(boxes, width, [len(x[0]) + looseness for x in found]) if looseness else found
            rows = [(len(breaks), breaks, d, best[2]) for best, (breaks, d, *_) in zip(found, loose, strict=True)]
            out = f[key].copy()
            out[["lines", "breaks", "demerits", "greedy_demerits"]] = pd.DataFrame(rows, columns=list("abcd"), index=f.index) if rows else None
            yield out

    kinds = dict(paras.dtypes)
    # a few files, or row groups, would be a few cores' work
    paras = paras.select(*key, text).repartition(max(32, 3 * paras.sparkSession.sparkContext.defaultParallelism), *key)
    schema = ", ".join(f"{c} {kinds[c]}" for c in key) + ", lines int, breaks array<int>, demerits long, greedy_demerits long"
    return paras.mapInPandas(run, schema)


def first_fit_starts(text: Column, width: int) -> Column:
    """The words (from 0) that begin a line under first fit: one fold over the words'
    lengths, in the JVM."""
    words = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    sizes = F.transform(words, lambda w, i: F.struct((F.length(w) * CHAR).alias("w"), i.alias("i")))
    start = F.struct(F.lit(0).alias("x"), F.array().cast("array<int>").alias("starts"))
    step = lambda acc, s: F.when(
        (s["i"] > 0) & (acc["x"] + SPACE + s["w"] <= width), F.struct((acc["x"] + SPACE + s["w"]).alias("x"), acc["starts"].alias("starts"))
    ).otherwise(F.struct(s["w"].alias("x"), F.concat(acc["starts"], F.array(s["i"])).alias("starts")))
    return F.aggregate(sizes, start, step, lambda acc: acc["starts"])


def hyphen_points(words: DataFrame, word: str, patterns: DataFrame, left: int = 2, right: int = 3, longest: int = 12) -> DataFrame:
    """word, points: places (letters before) at which a hyphen may stand. Every
    substring of .word. is looked up among the patterns (letters, digits: an array
    with one digit more than letters); the highest digit at a place counts, odd ones
    break. Patterns are joined by their letters, words are made distinct first."""
    distinct = words.select(F.col(word).alias("word")).where(F.length(word).between(left + right, 250)).distinct()
    dotted = F.concat(F.lit("."), F.lower("word"), F.lit("."))
    n = F.length("word") + 2
    subs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - i)), lambda j: F.struct(i.alias("at"), F.substr(dotted, i + 1, j).alias("letters")))))
    looked = distinct.select("word", F.explode(subs).alias("s")).select("word", "s.*").join(patterns, "letters")
    places = looked.select("word", "at", F.posexplode("digits").alias("k", "d")).groupBy("word", (F.col("at") + F.col("k") - 1).alias("p")).agg(F.max("d").alias("d"))
    good = places.where((F.col("d") % 2 == 1) & (F.col("p") >= left) & (F.col("p") <= F.length("word") - right))
    return good.groupBy("word").agg(F.array_sort(F.collect_list("p")).alias("points"))
