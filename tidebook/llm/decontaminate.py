"""Benchmark decontamination by a prefix-filtered set join.

Benchmark items are cut into windows of ``WINDOW`` words (a shorter item is one window). A window's set of tokens is
its shingles of ``SHINGLE`` words (a shorter window is one token). A document that holds a window holds all its
tokens, so a prefix of one token is enough to find every such document; tokens are ordered by rarity, counted over all
documents, and each window is joined by its rarest. A document's shingle that meets a window's prefix token says where
the window would begin; it must lie within the document (position and length bounds), and then all its words are
compared, so that the result is exact.

Documents are read once to count and once to join, and never shuffled. The index is built from blocks of the benchmark
of about ``BLOCK_BYTES``; a larger benchmark takes more passes, one for each block, not a larger broadcast.

Rows: null text, of either side, has no words; an item without words has no window; an item with a null id is named
``null``; items of one id count once; repeated documents are judged each; an empty benchmark hits nothing; other
columns stay, except that ``n_words``, ``hits`` and ``items`` replace columns of these names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.components import kept
from tidebook.llm.frames import replaced, small_batches, tidied, with_field
from tidebook.llm.words import in_parts

WINDOW = 10
SHINGLE = 5
BLOCK_BYTES = 8_000_000

WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in WORD_BYTES else 0x20 for b in range(256))

HITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ITEMS = T.ArrayType(T.StringType())


def words(text: str) -> list[bytes]:
    """Lower-cased runs of digits, letters a to z and anything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


class Index:
    """Windows of some items and the trie of their shingles; ``join_by`` sets each window's prefix token."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, shingle: int = SHINGLE):
        self.items = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.items)}
        found: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
        for item, text in items:
            w = words(text)
            for k in range(max(1, len(w) - window + 1) if w else 0):
                found[tuple(w[k : k + window])].add(number[item])
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for seq in found for w in seq}))}
        self.window_items = [sorted(v) for v in found.values()]
        self.sizes = np.array([len(seq) for seq in found], np.int64)
        self.grid = np.zeros((len(found), window), np.int64)
        for k, seq in enumerate(found):
            self.grid[k, : len(seq)] = [self.vocabulary[w] for w in seq]
        self.depth = min(shingle, window)
        self.base = len(self.vocabulary) + 1
        # Level d of the trie: (node of the first d - 1 words) * base + word, sorted; a node's number is its place + 1.
        # Tokens, of any level, are numbered through: offsets[d] + node.
        self.levels: list[np.ndarray] = []
        self.offsets = [0]
        nodes: dict[tuple[int, int], np.ndarray] = {}
        for d in range(1, self.depth + 1):
            per_start = []
            for start in range(window):
                ok = (start + d <= self.sizes) & (d <= self.sizes)
                before = nodes[d - 1, start] if d > 1 else np.zeros(len(found), np.int64)
                word = self.grid[:, start + d - 1] if start + d <= window else np.zeros(len(found), np.int64)
                per_start.append((ok, before * self.base + word))
            keys = np.unique(np.concatenate([k[ok] for ok, k in per_start])) if len(found) else np.zeros(0, np.int64)
            self.levels.append(keys)
            self.offsets.append(self.offsets[-1] + len(keys))
            for start, (ok, key) in enumerate(per_start):
                nodes[d, start] = np.where(ok, np.searchsorted(keys, key) + 1, 0)
        self.tokens: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # windows, offsets in them, tokens
        for d in range(1, self.depth + 1):
            for start in range(window):
                own = np.flatnonzero((np.minimum(self.sizes, self.depth) == d) & (start + d <= self.sizes))
                token = self.offsets[d - 1] + nodes[d, start][own]
                self.tokens.append((own, np.full(len(own), start), token))
        self.n_tokens = self.offsets[-1] + 1
        self.join_by(np.zeros(self.n_tokens, np.int64))

    def join_by(self, counts: np.ndarray) -> None:
        """Takes each window's rarest token by these counts as its prefix."""
        window, start, token = (np.concatenate(x) for x in zip(*self.tokens, strict=True))
        order = np.lexsort((start, token, counts[token], window))
        first = np.unique(window[order], return_index=True)[1] if len(order) else np.zeros(0, np.int64)
        pick = order[first]
        pick = pick[np.argsort(token[pick], kind="stable")]
        self.post_window, self.post_start = window[pick], start[pick]
        self.posts = np.searchsorted(token[pick], np.arange(self.n_tokens + 1))
        self.counted = np.zeros(self.n_tokens, bool)
        self.counted[token] = True

    def number(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words of the texts as numbers (0: in no item), and how many each text has."""
        cut = [words(t) for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        get = self.vocabulary.get
        flat = np.fromiter((n for w in cut for n in map(get, w, repeat(0))), np.int64, int(sizes.sum()))
        return flat, sizes

    def matches(self, flat: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and tokens of all shingles in the row of words that are tokens; ``ends``: of each word's text."""
        at = np.flatnonzero(flat)
        node = np.zeros(len(at), np.int64)
        for d in range(1, self.depth + 1):
            inside = at + d <= ends[at]
            at, node = at[inside], node[inside]
            key = node * self.base + flat[at + d - 1]
            place = np.searchsorted(self.levels[d - 1], key)
            place[place == len(self.levels[d - 1])] = 0
            hit = self.levels[d - 1][place] == key if len(self.levels[d - 1]) else np.zeros(len(at), bool)
            at, node = at[hit], place[hit] + 1
            yield at, self.offsets[d - 1] + node

    def count(self, texts: list[str]) -> np.ndarray:
        """How often each token occurs in the texts."""
        total = np.zeros(self.n_tokens, np.int64)
        flat, sizes = self.number(texts)
        for _, token in self.matches(flat, np.repeat(np.cumsum(sizes), sizes)):
            total += np.bincount(token, minlength=self.n_tokens)
        return np.where(self.counted, total, 0)

    def join(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; then, for each occurrence of a window: text, first word, window."""
        flat, sizes = self.number(texts)
        text_end = np.cumsum(sizes)
        ends = np.repeat(text_end, sizes)
        begins = np.repeat(text_end - sizes, sizes)
        starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, token in self.matches(flat, ends):
            n = self.posts[token + 1] - self.posts[token]
            total = int(n.sum())
            post = np.repeat(self.posts[token] - (np.cumsum(n) - n), n) + np.arange(total)
            at = np.repeat(at, n)
            window = self.post_window[post]
            start = at - self.post_start[post]
            bound = (start >= begins[at]) & (start + self.sizes[window] <= ends[at])
            start, window = start[bound], window[bound]
            for t in range(int(self.sizes[window].max(initial=0))):
                more = t < self.sizes[window]
                same = np.ones(len(window), bool)
                same[more] = flat[start[more] + t] == self.grid[window[more], t]
                start, window = start[same], window[same]
                if not len(window):
                    break
            starts.append(start)
            windows.append(window)
        start, window = np.concatenate(starts), np.concatenate(windows)
        text = np.searchsorted(text_end, start, "right")
        return sizes, text, start - (text_end - sizes)[text], window


def merged(starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Sorted ranges that cover the given ones."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])
    return [{"start": int(a), "end": int(b)} for a, b in zip(starts[new], reach[last], strict=True)]


def blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's distinct rows, in parts of about so many bytes."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"))
    # Repeated rows have one hash, so they would all be in one part.
    rows = kept(rows.where("text is not null").distinct(), "benchmark")
    total = rows.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, r.text) for r in part.collect()]


def _counts(docs: DataFrame, text: str, index) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        total = np.zeros(own.n_tokens, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for begin, end in in_parts(texts):
                total += own.count(texts[begin:end])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["token", "n"])

    counted = docs.select(text).mapInArrow(tidied(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    total = np.zeros(index.value.n_tokens, np.int64)
    for row in counted.collect():  # at most a row for each token of the block
        total[row.token] = row.n
    return total


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (ranges of words inside occurring windows, ends exclusive, merged) and
    ``items`` (ids, as sorted strings, of the items with occurring windows)."""
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    out = docs
    parts = [docs]
    for k, items in enumerate(blocks(benchmark, item_id, item_text, block_bytes)):
        index = Index(items, window, shingle)
        index.join_by(_counts(docs, text, context.broadcast(index)))
        out = _joined(parts[-1] if k == 0 else kept(parts[-1], "decontaminated"), text, context.broadcast(index), k > 0)
        parts.append(out)
    return out


def _joined(docs: DataFrame, text: str, index, more: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for begin, end in in_parts(texts):
                rows = batch.slice(begin, end - begin)
                sizes, which, start, windows = own.join(texts[begin:end])
                hits: list[list] = [[] for _ in range(end - begin)]
                items: list[list] = [[] for _ in range(end - begin)]
                earlier = (rows.column("hits").to_pylist(), rows.column("items").to_pylist()) if more else None
                order = np.argsort(which, kind="stable")
                which, start, windows = which[order], start[order], windows[order]
                texts_hit, first, n = np.unique(which, return_index=True, return_counts=True)
                for t, at, m in zip(texts_hit.tolist(), first.tolist(), n.tolist(), strict=True):
                    s, w = start[at : at + m], windows[at : at + m]
                    hits[t] = merged(s, s + own.sizes[w])
                    items[t] = sorted({own.items[i] for x in set(w.tolist()) for i in own.window_items[x]})
                if earlier:
                    for t in range(end - begin):
                        if all_hits := hits[t] + earlier[0][t]:
                            a, b = (np.array([h[side] for h in all_hits]) for side in ("start", "end"))
                            hits[t] = merged(a, b)
                        items[t] = sorted({*items[t], *earlier[1][t]})
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                rows = replaced(rows, "n_words", pa.array(sizes))
                rows = replaced(rows, "hits", pa.array(hits, kind))
                yield replaced(rows, "items", pa.array(items, pa.list_(pa.string())))

    schema = docs.schema
    for name, kind in (("n_words", T.LongType()), ("hits", HITS), ("items", ITEMS)):
        schema = with_field(schema, name, kind)
    return docs.mapInArrow(tidied(run), schema)
