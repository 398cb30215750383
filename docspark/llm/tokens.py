"""Exact byte-level BPE by the tokenizers library, with a memo of words.

The pre-tokeniser of this family never lets a token run over the place before
a single space or line feed that stands between characters which aren't white
space, nor over the place after such a line feed. So a text may be cut there
and its words encoded apart. Words repeat: most come from a bounded memo, the
others go to the library together, one to a line, or if they are Latin letters
alone, which are one piece, straight to its model; marks behind letters are a piece of
their own. Splitting, the distinct words
and their places in the memo are Arrow's work; only words that the memo lacks become
objects of Python. The ids are the library's own for the whole text, which the tests
compare.
"""

from __future__ import annotations

import re
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space in the widest sense of any regex dialect, besides space and line feed.
_OTHER = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]")

#: Marks that are one piece, however many, where they stand between letters and white space.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())

#: The id that ends every document.
END = 2
END_BYTES = END.to_bytes(4, "little")


def plain(text: str) -> bool:
    """True if every space and line feed stands alone between other characters
    and there is no other white space: then the text may be cut at each."""
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or _OTHER.search(text))


class Memo:
    """Words as Arrow strings, and their ids in one row, word k's from ends[k] to
    ends[k + 1]."""

    def __init__(self) -> None:
        self.words = pa.array([], pa.string())
        self.flat, self.ends = np.zeros(1 << 10, "<u4"), np.zeros(1 << 10, np.int64)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each of some distinct words stands, or -1. The table of hashes is of these
        words, which are far fewer."""
        found = pc.index_in(self.words, value_set=words)
        at = np.full(len(words), -1, np.int64)
        at[found.drop_null().to_numpy()] = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        return at

    def add(self, words: pa.Array, flat: np.ndarray, size: np.ndarray, keep: int) -> None:
        """The ids of more words; of these, the first ``keep`` stay beyond the next call."""
        n = len(self.words)
        first = self.ends[n]
        self.flat = _room(self.flat, first + len(flat))
        self.ends = _room(self.ends, n + 1 + len(size))
        self.flat[first : first + len(flat)] = flat
        self.ends[n + 1 : n + 1 + len(size)] = first + np.cumsum(size)
        if keep:
            self.words = pa.concat_arrays([self.words, words.slice(0, keep)])


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x with room for n numbers, and for half as many again when it grows."""
    if n <= len(x):
        return x
    more = np.zeros(n + n // 2, x.dtype)
    more[: len(x)] = x
    return more


def _stretches(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the stretches, one after another, and where each ends among them."""
    ends = np.cumsum(size)
    at = np.repeat(start - ends + size, size)
    at += np.arange(len(at))
    return at, ends


class WordEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes,
    without the end id. At most ``memo`` words of at most ``longest`` characters
    are kept, so memory is bounded: some 45 bytes each."""

    def __init__(self, path: str, memo: int = 1_000_000, longest: int = 40):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Added tokens are found across words: a text that holds one goes to the library whole.
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.limit, self.longest = memo, longest
        self.inner = Memo()  # words after a space
        self.heads = Memo()  # words that begin a line
        self.tails = Memo()  # marks after letters
        self.feed = self._whole(["\n"])[0]
        self.lines = len(self.feed) == 4  # the cuts need a line feed that is one id
        self.model = self.tokenizer.model
        self.letters = self._letters()
        every = "".join(map(chr, self.letters or ())).strip()
        marks = re.escape(MARKS)
        self.of_letters, self.to_marks, self.of_marked = f"^[{every}]+$", f"^[{every}]+", f"^[{every}]+[{marks}]+$"

    def _letters(self) -> dict[int, str] | None:
        """What the pre-tokeniser makes of a space and of each Latin letter; nothing if it
        cuts between them, or not between them and marks that end a word, or the text is
        changed before."""
        split = self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer is not None or split is None:
            return None
        every = [chr(c) for c in range(0x250) if chr(c).isalpha()]
        out = {ord(c): "".join(x for x, _ in split.pre_tokenize_str(c)) for c in [" ", *every]}
        for space in ("", " "):
            text = space + "".join(every)
            for marks in ("", MARKS, *MARKS):
                if [x for x, _ in split.pre_tokenize_str(text + marks)] != [text.translate(out), *([marks] if marks else [])]:
                    return None
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: pa.Array, space: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words without white space, each after ``space``, in one row, and how
        many each has."""
        if self.letters is None:
            return self._by_lines(words.to_pylist(), space)
        alone = pc.match_substring_regex(words, self.of_letters).to_numpy(zero_copy_only=False)
        before, tokenize, letters, number = space.translate(self.letters), self.model.tokenize, self.letters, attrgetter("id")
        ids: list[int] = []
        count: list[int] = []
        for w in words.filter(pa.array(alone)).to_pylist():
            got = tokenize(before + (w if w.isascii() else w.translate(letters)))
            ids += map(number, got)
            count.append(len(got))
        flat, size = np.asarray(ids, "<u4"), np.asarray(count, np.int64)
        if alone.all():
            return flat, size
        more, sizes = self._by_lines(words.filter(pa.array(~alone)).to_pylist(), space)
        start, every = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        every[alone], every[~alone] = size, sizes
        start[alone], start[~alone] = np.cumsum(size) - size, len(flat) + np.cumsum(sizes) - sizes
        return np.concatenate([flat, more])[_stretches(start, every)[0]], every

    def _by_lines(self, words: list[str], space: str, group: int = 512) -> tuple[np.ndarray, np.ndarray]:
        feed = int.from_bytes(self.feed, "little")
        flat, size = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for i in range(0, len(words), group):
            part = words[i : i + group]
            ids = np.frombuffer(self._whole([space + ("\n" + space).join(part)])[0], "<u4")
            cuts = np.flatnonzero(ids == feed)
            if len(cuts) != len(part) - 1:
                raise ValueError("the vocabulary merges line feeds with words")
            flat.append(np.delete(ids, cuts))
            size.append(np.diff(cuts, prepend=-1, append=len(ids)) - 1)
        return np.concatenate(flat), np.concatenate(size)

    def _found(self, memo: Memo, words: pa.Array, space: str) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of some distinct words begin in the memo's row, and how many
        there are. What the memo lacks comes from the library and stays if there's room."""
        at, known = memo.places(words), len(memo.words)
        lacks = np.flatnonzero(at < 0)
        if len(lacks):
            new = words.take(pa.array(lacks))
            fits = pc.utf8_length(new).to_numpy() <= self.longest
            order = np.argsort(~fits, kind="stable")
            new = new.take(pa.array(order))
            memo.add(new, *self._words(new, space), min(int(fits.sum()), max(0, self.limit - known)))
            at[lacks[order]] = known + np.arange(len(new))
        return memo.ends[at], memo.ends[at + 1] - memo.ends[at]

    def _ids(self, memo: Memo, words: pa.Array, space: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in one row, and how many each has. Letters and marks
        after them are two pieces, looked up apart."""
        if self.letters is None:
            start, size = self._found(memo, words, space)
            return memo.flat[_stretches(start, size)[0]], size
        marked = pc.match_substring_regex(words, self.of_marked)
        stem = pc.if_else(marked, pc.ascii_rtrim(words, MARKS), words).dictionary_encode()
        start, size = (x[stem.indices.to_numpy()] for x in self._found(memo, stem.dictionary, space))
        tail = pc.replace_substring_regex(words.filter(marked), self.to_marks, "").dictionary_encode()
        tail_start, tail_size = (x[tail.indices.to_numpy()] for x in self._found(self.tails, tail.dictionary, ""))
        marked, more = marked.to_numpy(zero_copy_only=False), np.zeros(len(words), np.int64)
        more[marked] = tail_size
        # the marks' ids are written over the places that are too many for the letters
        at, ends = _stretches(start, size + more)
        out = memo.flat.take(at, mode="clip")
        out[_stretches(ends[marked] - tail_size, tail_size)[0]] = self.tails.flat[_stretches(tail_start, tail_size)[0]]
        return out, size + more

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text: those of its distinct words, laid out for all places at
        once."""
        out: list[bytes] = [b""] * len(texts)
        cut, odd = [], []
        for i, t in enumerate(texts):
            if t:
                (cut if self.lines and plain(t) and not any(x in t for x in self.added) else odd).append(i)
        for k, x in zip(odd, self._whole([texts[k] for k in odd]), strict=True):
            out[k] = x
        if not cut:
            return out
        spaced = pc.replace_substring(pa.array([texts[i] for i in cut], pa.large_string()), "\n", " \n ")
        split = pc.split_pattern(spaced, " ")
        coded = split.values.dictionary_encode()
        words, code = coded.dictionary.cast(pa.string()), coded.indices.to_numpy()
        bounds = split.offsets.to_numpy().astype(np.int64)
        del spaced, split
        n = len(words)
        # the first word of a text or line has no space before it
        feed = code == pc.index(words, "\n").as_py()
        head = np.zeros(len(code), bool)
        head[bounds[:-1]] = True
        head[1:] |= feed[:-1]
        firsts = np.flatnonzero(np.bincount(code[head], minlength=n))
        inner = np.flatnonzero(np.bincount(code[~head & ~feed], minlength=n))
        ids, size = self._ids(self.inner, words.take(pa.array(inner)), " ")
        head_ids, head_size = self._ids(self.heads, words.take(pa.array(firsts)), "")
        # words after a space, those that begin a line, the line feed
        flat = np.concatenate([ids, head_ids, np.frombuffer(self.feed, "<u4")])
        size = np.concatenate([size, head_size, [1]])
        start = np.cumsum(size) - size
        after, first_of = np.zeros(n, np.int64), np.zeros(n, np.int64)
        after[inner], first_of[firsts] = np.arange(len(inner)), len(inner) + np.arange(len(firsts))
        place = after[code]
        place[head] = first_of[code[head]]
        place[feed] = len(size) - 1
        del words, code, coded, feed, head
        # laid out for some texts at a time, so that places take little memory
        first = 0
        while first < len(cut):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + 100_000, "right")) - 1)
            part = place[bounds[first] : bounds[last]]
            at, ends = _stretches(start[part], size[part])
            raw = flat[at].tobytes()
            cuts = (np.concatenate([[0], ends])[bounds[first : last + 1] - bounds[first]] * 4).tolist()
            for k in range(first, last):
                out[cut[k]] = raw[cuts[k - first] : cuts[k - first + 1]]
            first = last
        pa.default_memory_pool().release_unused()
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def forget() -> None:
    _ENCODERS.clear()


def encoder(path: str) -> WordEncoder:
    """One per worker process: its memo outlives a task."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
