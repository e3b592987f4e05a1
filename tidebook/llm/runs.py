"""Periodic runs of words, by longest common extensions from suffix trees.

A run is a stretch of words with smallest period q (words q apart are the same) that no neighbouring word extends. By
the runs theorem the longest Lyndon word at some place of a run, in one of two opposite orders of the words, is its
period (its L-root). So every place gives two candidates: the Lyndon word that reaches to the next smaller suffix, in
either order. A candidate is extended to both sides by longest common extensions: forward ones from the suffix tree of
the words, backward ones from that of the reversed words. Trees are built by Ukkonen's algorithm; an Euler tour over
a tree meets the leaves in the order of the suffixes, and the lowest node between two leaves is a range minimum in
constant time.

Trees need some microseconds and hundreds of bytes a word, so they are built for the stretches that can hold a run at
all (``stretches``): a run of length >= max(SHORTEST, TIMES * q) repeats each of its sequences of ``GRAM`` words at
distance q. Words outside any sequence that repeats within a quarter of its stretch are in no such run; what is left is
cut again until nothing changes. This leaves out no run, at any size, and a text that is one repetition is one tree.

Documents are independent: one pass of Arrow batches without a shuffle, a task holding the trees of one stretch.

Rows: null or empty text, or text without words, has no runs and the empty rest; repeated rows give a row each; a
run of greatest length has ties broken by start, then period; an empty table gives an empty result; other columns
stay, except those that the result names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidebook.llm.frames import replaced, with_field

SHORTEST = 6
TIMES = 4
#: With runs of at least TIMES periods and SHORTEST words, all sequences of so many words in a run repeat at its period.
GRAM = 5
#: What words are cut by: ASCII white space.
SPACE = re.compile("[\x20\x09-\x0d]+")


def words_of(text: str | None) -> list[str]:
    return [w for w in SPACE.split(text) if w] if text else []


def nearest(codes: np.ndarray) -> np.ndarray:
    """Distance of each code to the nearest equal one; the number of codes if there is none."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    gap = np.where(codes[order[1:]] == codes[order[:-1]], order[1:] - order[:-1], n)
    out = np.full(n, n)
    out[order[1:]] = gap
    out[order[:-1]] = np.minimum(out[order[:-1]], gap)
    return out


def stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words outside which no run of the least length and number of periods is."""
    n = len(words)
    if n < SHORTEST:
        return []
    grams = np.zeros(n - GRAM + 1, np.int64)
    for k in range(GRAM):
        if k:
            grams = np.unique(grams * (words.max() + 1) + words[k : n - GRAM + 1 + k], return_inverse=True)[1]
        else:
            grams = words[: n - GRAM + 1].astype(np.int64)
    apart = nearest(grams)
    alive = apart < n
    while True:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], alive.astype(np.int8), [0]])))
        begins, ends = edges[::2], edges[1::2]
        # Sequences that begin at begins .. ends - 1 cover the words begins .. ends + GRAM - 2; touching stretches are one.
        if not len(begins):
            return []
        stops = ends + GRAM - 1
        new = np.concatenate([[True], begins[1:] > stops[:-1]])
        first = begins[new]
        last = stops[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(stops) - 1]])]
        size = np.zeros(len(alive), np.int64)
        which = np.cumsum(new) - 1
        size[alive] = np.repeat((last - first)[which], ends - begins)
        keep = alive & (apart * TIMES <= size)
        if (keep == alive).all():
            fine = last - first >= SHORTEST
            return list(zip(first[fine].tolist(), last[fine].tolist(), strict=True))
        alive = keep


class SuffixTree:
    """Ukkonen's tree of a row of numbers >= 0, closed by a number of its own that is less than all others."""

    def __init__(self, row: Sequence[int]):
        text = [w + 1 for w in row] + [0]
        n = len(text)
        wide = max(text) + 1
        start, end, link, edge = [0], [0], [0], {}  # nodes: their edge's range of text, suffix link; (node, number) to node
        node, at, length, waiting = 0, 0, 0, 0
        for k, w in enumerate(text):
            waiting += 1
            last = 0
            while waiting:
                if not length:
                    at = k
                key = node * wide + text[at]
                child = edge.get(key)
                if child is None:
                    edge[key] = len(start)
                    start.append(k)
                    end.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    size = min(end[child], k + 1) - start[child]
                    if length >= size:
                        at += size
                        length -= size
                        node = child
                        continue
                    begin = start[child]
                    if text[begin + length] == w:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = len(start)
                    start.append(begin)
                    end.append(begin + length)
                    link.append(0)
                    edge[key] = split
                    edge[split * wide + w] = split + 1
                    start.append(k)
                    end.append(n)
                    link.append(0)
                    start[child] = begin + length
                    edge[split * wide + text[begin + length]] = child
                    if last:
                        link[last] = split
                    last = split
                waiting -= 1
                if not node and length:
                    length -= 1
                    at = k - waiting + 1
                else:
                    node = link[node]
        self.n = n
        keys = np.fromiter(edge.keys(), np.int64, len(edge))
        child = np.fromiter(edge.values(), np.int64, len(edge))
        self.parent, self.first, self.child = keys // wide, keys % wide, child
        self.size = np.minimum(np.array(end), n) - np.array(start)

    def tour(self, falling: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order in which an Euler tour meets their leaves (by rising or falling numbers, the end always
        first), and the depth of the lowest node it passes between each two of them."""
        rank = np.where(self.first > 0, -self.first, -1 - self.first.max()) if falling else self.first
        order = np.lexsort((rank, self.parent))
        parent, child = self.parent[order], self.child[order].tolist()
        n_nodes = len(self.size)
        begin = np.searchsorted(parent, np.arange(n_nodes + 1)).tolist()
        size = self.size.tolist()
        suffixes, lows = [], []
        n = self.n
        path, depth, lowest = [(begin[0], begin[1])], [0], 0
        while path:
            k, stop = path[-1]
            if k == stop:
                path.pop()
                depth.pop()
                if depth and depth[-1] < lowest:
                    lowest = depth[-1]
                continue
            path[-1] = (k + 1, stop)
            own = child[k]
            deep = depth[-1] + size[own]
            if begin[own] == begin[own + 1]:
                if suffixes:
                    lows.append(lowest)
                suffixes.append(n - deep)
                lowest = depth[-1]
            else:
                path.append((begin[own], begin[own + 1]))
                depth.append(deep)
        return np.array(suffixes), np.array(lows, np.int64)


class Extensions:
    """Longest common prefixes of suffixes, each in constant time."""

    def __init__(self, tree: SuffixTree):
        self.suffixes, lows = tree.tour()
        self.rank = np.empty(tree.n, np.int64)
        self.rank[self.suffixes] = np.arange(tree.n)
        self.table = [lows.astype(np.int32)]
        while len(self.table[-1]) > 1 << len(self.table) - 1:
            half = 1 << len(self.table) - 1
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of different suffixes, given by where they begin."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            row = self.table[k]
            out[own] = np.minimum(row[low[own]], row[high[own] - (1 << k)])
        return out


def next_smaller(ranks: list[int]) -> np.ndarray:
    """For each place the next one of smaller rank."""
    out = [0] * len(ranks)
    stack: list[int] = []
    for k in range(len(ranks) - 1, -1, -1):
        own = ranks[k]
        while stack and ranks[stack[-1]] > own:
            stack.pop()
        out[k] = stack[-1] if stack else len(ranks)
        stack.append(k)
    return np.array(out)


def runs_of(row: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of the runs of a row of numbers >= 0, by start, then period: runs of at least
    ``shortest`` words and ``times`` (two or more) periods."""
    n = len(row)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    tree = SuffixTree(row.tolist())
    forward = Extensions(tree)
    falling = np.empty(tree.n, np.int64)
    falling[tree.tour(falling=True)[0]] = np.arange(tree.n)
    del tree
    backward = Extensions(SuffixTree(row[::-1].tolist()))
    found = []
    for ranks in (forward.rank, falling):
        at = np.arange(n)
        after = next_smaller(ranks.tolist())[:n]  # the closing number is less than all, so there is one
        period = after - at
        right = forward.common(at, after)
        left = backward.common(n - at, n - after)
        start, stop = at - left, after + right
        good = (stop - start >= shortest) & (stop - start >= times * period)
        found.append(np.stack([start[good], (stop - start)[good], period[good]], 1))
    every = np.unique(np.concatenate(found), axis=0)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def find_runs(words: Sequence[str]) -> np.ndarray:
    """(start, length, period) of all runs of at least SHORTEST words and TIMES periods."""
    known: dict[str, int] = {}
    row = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    parts = []
    for begin, end in stretches(row):
        own = runs_of(np.unique(row[begin:end], return_inverse=True)[1])
        own[:, 0] += begin
        parts.append(own)
    return np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)


def kept_words(words: Sequence[str], runs: np.ndarray) -> list[str]:
    """The words that no run contains after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


FOUND = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length and period in words, by start, then period) and ``collapsed``,
    the words outside repeated periods, joined by one space."""
    schema = docs.schema
    for name, kind in (("n_words", T.LongType()), ("runs", RUNS), ("collapsed", T.StringType())):
        schema = with_field(schema, name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, rest = [], [], []
            for value in batch.column(text).to_pylist():
                words = words_of(value)
                own = find_runs(words)
                sizes.append(len(words))
                found.append(own)
                rest.append(" ".join(kept_words(words, own) if len(own) else words))
            ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            flat = np.concatenate([*found, np.zeros((0, 3), np.int64)])
            each = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(FOUND))
            rows = replaced(batch, "n_words", pa.array(sizes, pa.int64()))
            rows = replaced(rows, "runs", pa.ListArray.from_arrays(ends, each))
            yield replaced(rows, "collapsed", pa.array(rest, pa.string()))

    return docs.mapInArrow(run, schema)
