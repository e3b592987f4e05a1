"""Pre-token words of byte-level tokenizers, and a bounded memory of what an encoder made of them.

Words repeat, so a worker encodes each word once and afterwards only looks it up: a word becomes a number by one
dictionary access, and the ids of a whole batch are then gathered by numpy from one flat table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex

#: The pattern that byte-level tokenizers of this family split texts by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words that a worker remembers, and their characters on average at most. Beyond either, those used most often since they
#: came stay, half as many at most, so the memory is bounded on any corpus.
REMEMBERED = 300_000
WORD_CHARS = 16
#: Characters of text that are looked up together.
LOOKUP_CHARS = 2_000_000

BEYOND_BMP = re.compile("[\U00010000-\U0010ffff]")


def _class(pattern: str) -> str:
    """The characters below U+10000 that a pattern of the regex module matches, as ranges."""
    codes = [ord(c) for c in regex.findall(pattern, "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000)))))]
    cuts = np.flatnonzero(np.diff(codes) != 1) + 1
    runs = [(int(r[0]), int(r[-1])) for r in np.split(np.array(codes), cuts)]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


@lru_cache(maxsize=2)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Cuts a text by the pattern. Python's own ``re`` is twice as fast as ``regex`` once the properties in the
    pattern are written as character classes, which it handles well for characters below U+10000."""
    whole = regex.compile(pattern)
    if pattern != PATTERN:
        return whole.findall
    space, letter, number = _class(r"\s"), _class(r"\p{L}"), _class(r"\p{N}")
    plain = re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
        rf"|[{space}]+(?![^{space}])|[{space}]+"
    )

    def split(text: str) -> list[str]:
        return (whole if BEYOND_BMP.search(text) else plain).findall(text)

    return split


class Numbers(dict):
    """Words to numbers in the order of their first use."""

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        return k


class Encoder:
    """Encodes texts by a splitter and ``solve``, which gets each new word once, many at a time."""

    def __init__(
        self, split: Callable[[str], list[str]], solve: Callable[[list[str]], Sequence[Sequence[int]]], most: int = REMEMBERED
    ):
        self.split, self.solve, self.most = split, solve, most
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.uses, self.chars = np.zeros(0, np.int64), 0

    def _thin_out(self) -> None:
        """Keeps the words used most often, older uses counting half."""
        order = np.argsort(-self.uses, kind="stable")[: self.most // 2]
        words = list(self.numbers)
        sizes = np.fromiter((len(words[k]) for k in order.tolist()), np.int64, len(order))
        fits = (self.uses[order] > 1) & (np.cumsum(sizes) <= self.most // 2 * WORD_CHARS)
        order = np.sort(order[fits])
        own = np.diff(self.starts)[order]
        ends = np.cumsum(own)
        flat = self.flat[np.repeat(self.starts[order] - (ends - own), own) + np.arange(int(own.sum()))]
        self.numbers = Numbers(zip((words[k] for k in order.tolist()), range(len(order)), strict=True))
        self.starts, self.flat = np.concatenate([[0], ends]), flat
        self.uses, self.chars = self.uses[order] >> 1, int(sizes[fits].sum())

    def _solve_new(self) -> None:
        known = len(self.starts) - 1
        if len(self.numbers) == known:
            return
        new = list(islice(self.numbers, known, None))
        found = self.solve(new)
        self.chars += sum(map(len, new))
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) + self.starts[-1]
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1] - self.starts[-1]))
        self.starts, self.flat = np.concatenate([self.starts, ends]), np.concatenate([self.flat, flat])

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids in order."""
        if len(self.numbers) > self.most or self.chars > self.most * WORD_CHARS:
            self._thin_out()
        cut = [list(map(self.numbers.__getitem__, self.split(t))) for t in texts]
        self._solve_new()
        words = np.fromiter(map(len, cut), np.int64, len(cut))
        used = np.fromiter(chain.from_iterable(cut), np.int64, int(words.sum()))
        uses = np.bincount(used, minlength=len(self.numbers))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        begin = self.starts[used]
        sizes = self.starts[used + 1] - begin
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(begin - (ends - sizes), sizes) + np.arange(total)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words)])]
        return np.diff(upto), flat


def in_parts(texts: Sequence[str], most: int = LOOKUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters; a longer text is a range of its own."""
    begin = chars = 0
    for k, text in enumerate(texts):
        chars += len(text)
        if chars >= most or k == len(texts) - 1:
            yield begin, k + 1
            begin, chars = k + 1, 0


def list_array(sizes: np.ndarray, flat: np.ndarray) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
