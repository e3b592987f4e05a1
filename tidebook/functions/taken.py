"""Lists of levels taken out of the texts of messages before those are parsed as JSON.

A list that is written as nearly all are, ``"field":[["price","quantity"],...]``, is tested as a text and read as numbers,
those of many messages at once. A short list that names its place stands in the text for it, so that what is parsed as JSON
stays small however many levels a message has.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.functions.jsonfields import text_at
from tidebook.functions.numbers import PLAIN_NUMBER

# Numbers are never NULL here; saying so spares a test of each.
_NUMBERS = T.StructType([T.StructField(name, T.DoubleType(), False) for name in ("price", "quantity")])
_LISTS = T.ArrayType(T.ArrayType(_NUMBERS, False), False)
TAKEN = T.StructType([T.StructField("rest", T.StringType()), T.StructField("lists", _LISTS)])
# Bytes of texts that are read together, so that what is made of them stays small.
CHUNK = 1 << 19
# Two plain decimals; the same with an empty list; and a text that no number leads with any other one. None has escapes or
# other letters than ASCII.
_PLAIN = rf'\["{PLAIN_NUMBER}","{PLAIN_NUMBER}"\]'
_LEVEL = rf'\["{PLAIN_NUMBER}","{PLAIN_NUMBER}"(?:,\[\])?\]'
_SKIPPED = r'\["(?:[ !#-,/:-\[\]-~][ !#-\[\]-~]*)?","[ !#-\[\]-~]*"(?:,\[\])?\]'
_PLAIN_LIST = rf"^\[{_PLAIN}(?:,{_PLAIN})*\]$"
_MIXED_LIST = rf"^\[(?:{_LEVEL}|{_SKIPPED})(?:,(?:{_LEVEL}|{_SKIPPED}))*\]$"
_SKIP = re.compile(f"{_SKIPPED},?".encode())


def _listed(text: bytes, keys: Sequence[bytes]) -> list[tuple[int, int]]:
    """Where lists of the fields begin and end, in order. Others than plain lists may end anywhere."""
    found = []
    for key in keys:
        start = text.find(key)
        if start >= 0:
            start += len(key) - 2
            end = text.find(b"]]", start)
            if text[end - 1 : end] == b"[":
                end = text.find(b"]]]", start) + 1
            if end > start:
                found.append((start, end + 2))
    return sorted(found)


def _matching(texts: list[bytes], pattern: str) -> np.ndarray:
    found = pa.array(texts, pa.binary()).cast(pa.string())
    return pc.match_substring_regex(found, pattern).to_numpy(zero_copy_only=False).astype(bool)


def _read(lists: list[bytes]) -> list[bytes | None]:
    """The texts without levels that are skipped and empty lists; None in place of those in other forms."""
    out: list[bytes | None] = list(lists)
    others = np.flatnonzero(~_matching(lists, _PLAIN_LIST)) if lists else []
    if len(others):
        for i, mixed in zip(others, _matching([lists[i] for i in others], _MIXED_LIST)):
            out[i] = _SKIP.sub(b"", lists[i]).replace(b",[]", b"").replace(b",]", b"]") if mixed else None
    return out


def _numbers(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of plain lists, and how many each has."""
    data = np.frombuffer(b"".join(lists), np.uint8)
    quotes = np.flatnonzero(data == 34)
    ends = np.cumsum([len(text) for text in lists], dtype=np.int64)
    counts = np.diff(np.searchsorted(quotes, ends), prepend=0) // 2
    if not len(quotes):
        return np.zeros(0), counts
    # numbers stand between the quotes in turn with what separates them
    offsets = quotes.astype(np.int32)
    offsets[0::2] += 1
    parts = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
    numbers = parts.take(pa.array(np.arange(0, len(parts), 2))).cast(pa.float64())
    return numbers.to_numpy(), counts


def _taken(texts: list[bytes | None], keys: Sequence[bytes]):
    """What is left of each text, or None, and how many lists it had; the numbers of the lists, and how many each has."""
    places = [[] if text is None or b"\\" in text else _listed(text, keys) for text in texts]
    read = iter(_read([text[a:b] for text, own in zip(texts, places) for a, b in own]))
    rest: list[bytes | None] = []
    held, lists = [], []
    for text, own in zip(texts, places):
        left, at, mine = b"", 0, []
        for (start, end), found in zip(own, [next(read) for _ in own]):
            if found is not None and start >= at:
                before = left + text[at:start]
                if before.count(b'"') % 2 == 0:  # not inside a text
                    left, at = before + b'["@%d"]' % len(mine), end
                    mine.append(found)
        if mine:
            left += text[at:]
        if left.count(b'"@') != len(mine):  # the message has such texts of its own
            mine = []
        rest.append(left if mine else None)
        held.append(len(mine))
        lists += mine
    return rest, np.array(held, np.int64), *_numbers(lists)


def take_lists(texts: pa.Array, fields: Sequence[str]) -> pa.StructArray:
    """(rest, lists) of each text; both NULL where nothing was taken."""
    keys = [f'"{field}":[['.encode() for field in fields]
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    parts, at = [], 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK)))
        parts.append(_taken(texts[at:end].cast(pa.binary()).to_pylist(), keys))
        at = end
    rest = [left for part in parts for left in part[0]]
    held, numbers, counts = (np.concatenate([np.zeros(0, t), *(p[k] for p in parts)]) for k, t in ((1, int), (2, float), (3, int)))
    levels = pa.StructArray.from_arrays([pa.array(numbers[0::2]), pa.array(numbers[1::2])], ["price", "quantity"])
    each = pa.ListArray.from_arrays(_offsets(counts // 2), levels)
    lists = pa.ListArray.from_arrays(_offsets(held), each, mask=pa.array(np.array([left is None for left in rest], bool)))
    return pa.StructArray.from_arrays([pa.array(rest, pa.binary()).cast(pa.string()), lists], ["rest", "lists"])


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.cumsum(np.append(0, sizes)), pa.int32())


def lists_taken(payload: Column, fields: Sequence[str]) -> Column:
    """``struct<rest, lists>``: the text without the lists that read, which :func:`taken_at` finds again."""
    names = tuple(fields)

    def take(texts: pa.Array) -> pa.Array:
        return take_lists(texts, names)

    return F.arrow_udf(take, TAKEN)(F.when(payload.contains('":[["'), payload))


def taken_at(lists: Column, doc: Column, path: str) -> Column:
    """The list that stood at a path; NULL where it wasn't taken."""
    mark = text_at(doc, f"{path}[0]")
    return F.when(lists.isNotNull() & mark.startswith("@"), F.get(lists, F.substr(mark, F.lit(2)).try_cast("int")))


def _sums(levels: pa.ListArray) -> pa.StructArray:
    counts = pc.fill_null(pc.list_value_length(levels), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    filled = counts > 0
    starts = (np.cumsum(counts) - counts)[filled]
    values = levels.flatten()
    columns = [pa.array(counts)]
    for name in ("price", "quantity"):
        sums = np.zeros(len(counts))
        if filled.any():
            sums[filled] = np.add.reduceat(values.field(name).to_numpy(zero_copy_only=False), starts)
        columns.append(pa.array(sums))
    return pa.StructArray.from_arrays(columns, ["levels", "price", "quantity"], mask=levels.is_null())


def level_sums(side: Column) -> Column:
    """``struct<levels, price, quantity>``: how many levels a side has, and the sums over them."""

    def sums(levels: pa.Array) -> pa.Array:
        return _sums(levels)

    return F.arrow_udf(sums, "struct<levels:bigint,price:double,quantity:double>")(side)
