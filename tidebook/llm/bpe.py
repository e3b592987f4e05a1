"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Merges are not searched word by word. All words that a task hasn't met yet form one flat row of byte tokens; an
inverted index has, for each pair of neighbouring tokens that can merge, the positions in that row where the pair
stands. The pairs are replayed in rank order over all words at once, and each merge looks only at the two pairs it
touches. A word's merges don't depend on other words, so replaying a part of the vocabulary at a time gives what one
replay over the whole vocabulary would give, with memory bounded by ``REPLAY_BYTES``; nothing is shuffled.

Rows: null text counts as the empty text and gives no ids; an empty table gives an empty result; repeated rows are
encoded each; all other columns are kept as they are, except that ``ids`` (or ``decoded``) replaces a column of that
name.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidebook.llm.frames import replaced, small_batches, tidied, with_field
from tidebook.llm.words import Encoder, in_parts, list_array, splitter

#: Bytes of new words in one replay.
REPLAY_BYTES = 1 << 21
#: Words that a worker remembers.
REMEMBERED = 200_000
#: Pairs of tokens whose merge is remembered.
PAIRS = 60_000
#: Ids that are decoded together.
DECODED_IDS = 500_000


@lru_cache(maxsize=4)
def ranks_of(content: bytes) -> dict[bytes, int]:
    """Token to rank, from the content of a rank file (base64 token and decimal rank on each line)."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Replay:
    """Encodes words, given as bytes, by the ranks of their parts."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)]
        self.byte_pair = np.array(pairs, np.int32)
        self.joined: dict[int, int] = {}

    def rank(self, pair: int) -> int:
        """Rank of what two tokens, packed into one number, merge to; -1 if they don't."""
        found = self.joined.get(pair)
        if found is None:
            if len(self.joined) > PAIRS:
                self.joined.clear()
            both = self.token[pair >> 32] + self.token[pair & 0xFFFFFFFF]
            found = self.joined[pair] = self.ranks.get(both, -1)
        return found

    def encode(self, words: Sequence[bytes]) -> list[list[int]]:
        """Ids of each word; a word that is a token itself is not taken apart."""
        out: list[list[int] | None] = [[self.ranks[w]] if w in self.ranks else [] if not w else None for w in words]
        part: list[int] = []
        size = 0
        for k, done in enumerate(out):
            if done is None:
                part.append(k)
                size += len(words[k])
                if size >= REPLAY_BYTES:
                    self._replay(words, part, out)
                    part, size = [], 0
        self._replay(words, part, out)
        return out

    def _replay(self, words: Sequence[bytes], part: list[int], out: list) -> None:
        if not part:
            return
        row = np.frombuffer(b"".join(words[k] for k in part), np.uint8)
        sizes = np.array([len(words[k]) for k in part])
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(part), dtype=np.int32), sizes)
        ids = self.byte[row]
        after = np.arange(1, len(row) + 1, dtype=np.int32)
        after[ends - 1] = -1
        before = np.arange(-1, len(row) - 1, dtype=np.int32)
        before[ends - sizes] = -1
        merges_to = np.full(len(row), -1, np.int32)  # of the pair that begins here
        merges_to[:-1] = self.byte_pair[row[:-1], row[1:]]
        merges_to[ends - 1] = -1

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray) -> None:
            ranks = merges_to[places]
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, group in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts), strict=True):
                if rank in index:
                    index[rank].append(group)
                else:
                    index[rank] = [group]
                    heapq.heappush(heap, rank)

        if len(begin := np.flatnonzero(merges_to >= 0)):
            enter(begin)
        odd: set[int] = set()  # words in which a merge brought up a lower rank
        while heap:
            rank = heapq.heappop(heap)
            groups = index.pop(rank)
            at = np.unique(np.concatenate(groups)) if len(groups) > 1 else groups[0]
            at = at[merges_to[at] == rank]  # others went into another merge
            if len(at) > 1 and (overlaps := after[at[:-1]] == at[1:]).any():
                first = np.concatenate([[True], ~overlaps])  # of a run like "aaa", every second place merges
                since = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                at = at[since % 2 == 0]
            if not len(at):
                continue
            second = after[at]
            right = after[second]
            inner = right >= 0
            beside = right[inner]
            beside = beside[merges_to[beside] == rank]  # merges too, but word by word it would do so only afterwards
            if len(beside):
                between = np.array([self.rank(rank << 32 | x) for x in ids[beside].tolist()])
                odd.update(word[beside[(between >= 0) & (between < rank)]].tolist())
            ids[at], ids[second], merges_to[second] = rank, -1, -1
            after[at] = right
            before[right[inner]] = at[inner]
            left = before[at]
            touched = np.unique(np.concatenate([at, left[left >= 0]]))
            follower = after[touched]
            merges_to[touched[follower < 0]] = -1
            touched, follower = touched[follower >= 0], follower[follower >= 0]
            if not len(touched):
                continue
            pairs, which = np.unique(ids[touched].astype(np.int64) << 32 | ids[follower], return_inverse=True)
            new = np.array(list(map(self.rank, pairs.tolist())), np.int32)[which]
            merges_to[touched] = new
            if (lower := (new >= 0) & (new < rank)).any():
                odd.update(word[touched[lower]].tolist())
            if len(touched := touched[new >= 0]):
                enter(touched)

        alive = np.flatnonzero(ids >= 0)
        cuts = np.searchsorted(alive, ends)
        flat = ids[alive].tolist()
        begin = 0
        for k, end in zip(part, cuts.tolist(), strict=True):
            out[k] = flat[begin:end]
            begin = end
        for k in odd:
            out[part[k]] = self._alone(words[part[k]])

    def _alone(self, word: bytes) -> list[int]:
        """One word, merge by merge: for words whose merges don't come up in rank order."""
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        while True:
            ranks = [self.rank(a << 32 | b) for a, b in pairwise(ids)]
            best = min((r for r in ranks if r >= 0), default=-1)
            if best < 0:
                return ids
            k = ranks.index(best)
            ids[k : k + 2] = [best]


@lru_cache(maxsize=2)
def encoder(content: bytes, pattern: str) -> Encoder:
    """One for each worker process."""
    replay = Replay(ranks_of(content))
    return Encoder(splitter(pattern), lambda new: replay.encode([w.encode() for w in new]), REMEMBERED)


class TokenBytes:
    """The bytes of all tokens in one row, from which those of many ids are gathered at once."""

    def __init__(self, ranks: dict[bytes, int]):
        known = {rank: token for token, rank in ranks.items()}
        tokens = [known.get(k, b"") for k in range(max(known, default=-1) + 1)]
        self.row = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, lists: pa.ListArray) -> pa.Array:
        ids = lists.flatten().to_numpy()
        sizes = self.sizes[ids]
        if len(sizes) and not sizes.all():
            raise ValueError("an id that the vocabulary lacks")
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])
        row = self.row[at].tobytes()
        lengths = lists.value_lengths()
        upto = ends[np.concatenate([[0], np.cumsum(lengths.fill_null(0).to_numpy())])].tolist()
        null = lengths.is_null().to_pylist()
        return pa.array([None if n else row[a:b] for n, (a, b) in zip(null, pairwise(upto), strict=True)], pa.binary())


def encode(
    frame: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """``frame`` with the ids of each text, an array of int; with ``decoded``, also with the bytes that the ids stand for,
    made by the same worker. The rank file is read once, by the driver; its size is that of a vocabulary, whatever the
    tables hold."""
    small_batches(frame.sparkSession)
    with open(ranks_path, "rb") as f:
        content = frame.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(content.value, pattern)
        table = TokenBytes(ranks_of(content.value)) if decoded else None
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for begin, end in in_parts(texts):
                found = list_array(*own.encode(texts[begin:end]))
                rows = replaced(batch.slice(begin, end - begin), ids, found)
                yield rows if table is None else replaced(rows, decoded, table.decode(found))
        own.forget()  # workers outlive tasks; what comes next in them may need the memory

    schema = with_field(frame.schema, ids, T.ArrayType(T.IntegerType()))
    return frame.mapInArrow(tidied(run), with_field(schema, decoded, T.BinaryType()) if decoded else schema)


def decode(frame: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``frame`` with the bytes that the ids stand for; null for null ids, an error for an id the vocabulary lacks."""
    with open(ranks_path, "rb") as f:
        content = frame.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TokenBytes(ranks_of(content.value))
        for batch in batches:
            sizes = batch.column(ids).value_lengths().fill_null(0).to_numpy()
            ends = np.cumsum(sizes)
            cuts = np.searchsorted(ends, np.arange(DECODED_IDS, ends[-1] if len(ends) else 0, DECODED_IDS), "right")
            for begin, end in pairwise(sorted({0, *cuts.tolist(), batch.num_rows})):
                rows = batch.slice(begin, end - begin)
                yield replaced(rows, decoded, table.decode(rows.column(ids)))

    return frame.mapInArrow(tidied(run), with_field(frame.schema, decoded, T.BinaryType()))
