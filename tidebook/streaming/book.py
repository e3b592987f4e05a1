"""Order books of a stream: levels as keyed state.

Channels share at most ``GROUPS`` groups of state, so that what a group costs in a micro-batch is not paid for each channel.
State holds the levels of a channel in parts of about ``PART_LEVELS``, so a micro-batch reads only channels it has rows of
and writes only the parts it changed, most often one; beside them the changes of the batch being buffered (which may
straddle micro-batches) and the last ``seq``. Rows of a micro-batch are put in order of channel and ``seq`` as columns of
numbers, stepped through one by one, and what is shown goes out in frames of bounded size. A row at or below the last ``seq`` is late and is returned unapplied with ``late = true``. For
bulk history use the batch form, which spreads a channel over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidebook import schemas
from tidebook.operators.fold import EVENT_COLUMNS, Book

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = schemas.SNAPSHOTS + ", late BOOLEAN"
NAMES = [f.split()[0] for f in OUTPUT.split(", ")]
#: Snapshots, and levels in them, of one frame that goes out.
FRAME_ROWS, FRAME_LEVELS = 2_000, 100_000
GROUPS = 1024
PART_LEVELS = 512
_LEVEL = "side STRING, price DOUBLE, size DOUBLE"


class Events:
    """Rows of one or more channels as columns of numbers: texts by their code, lists of levels only where there are some."""

    def __init__(self, frames: Iterator[pd.DataFrame]):
        self.codes: dict[str, int] = {}
        self.levels: dict[int, tuple] = {}
        parts: list[list[np.ndarray]] = []
        n = 0
        for frame in frames:
            parts.append([self._numbers(frame[c]) for c in EVENT_COLUMNS[:11]])
            with_levels = np.flatnonzero(frame["bid_levels"].notna() | frame["ask_levels"].notna())
            for k in with_levels.tolist():
                self.levels[n + k] = tuple(None if x is None else list(x) for x in (frame["bid_levels"].iloc[k], frame["ask_levels"].iloc[k]))
            n += len(frame)
        self.columns = [np.concatenate(c) for c in zip(*parts)]
        self.texts = {code: text for text, code in self.codes.items()}

    def _numbers(self, column: pd.Series) -> np.ndarray:
        if column.dtype == object and len(column) and isinstance(column.iloc[0], str):
            return np.fromiter((self.codes.setdefault(x, len(self.codes)) for x in column), np.int16, len(column))
        return column.to_numpy(np.float64, na_value=np.nan) if column.dtype == object else column.to_numpy()

    def in_order(self) -> Iterator[tuple]:
        """(channel_id, seq, exchange_ts, recv_us) and what a book takes of the event, by channel and ``seq``."""
        channel, seq, ts, recv, kind, side, mark, has_price, has_size, price, size = self.columns
        for k in np.lexsort((seq, channel)).tolist():
            bids, asks = self.levels.get(k, (None, None))
            names = (self.texts[int(kind[k])], self.texts.get(int(side[k])), self.texts.get(int(mark[k])))
            stamp = None if np.isnan(ts[k]) else int(ts[k])
            yield (int(channel[k]), int(seq[k]), stamp, int(recv[k])), (*names, bool(has_price[k]), bool(has_size[k]), float(price[k]), float(size[k]), bids, asks)


class _Frame:
    """Snapshots that go out together."""

    def __init__(self):
        self.rows, self.levels = [], 0

    def takes(self, row: tuple) -> bool:
        """Whether it is full with this row."""
        self.rows.append(row)
        self.levels += len(row[5]) + len(row[7])
        return len(self.rows) >= FRAME_ROWS or self.levels >= FRAME_LEVELS

    def given(self) -> pd.DataFrame:
        out = pd.DataFrame(self.rows, columns=NAMES)
        self.rows, self.levels = [], 0
        return out


class BookProcessor(StatefulProcessor):
    """One channel a key, one state entry for each level: for a few channels with very deep books."""

    def __init__(self, depth: int | None):
        self.depth = depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "side STRING, price DOUBLE", "size DOUBLE")
        self.pending = handle.getListState("pending", _LEVEL)
        self.place = handle.getValueState("place", "active BOOLEAN, last_seq BIGINT")

    def _load(self) -> tuple[Book, int]:
        if not self.place.exists():
            return Book(), -(2**63)
        active, last_seq = self.place.get()
        levels = ((side, price, size) for (side, price), (size,) in self.levels.iterator()) if self.levels.exists() else ()
        pending = map(tuple, self.pending.get()) if self.pending.exists() else ()
        return Book(levels, pending, active), last_seq

    def _save(self, book: Book, last_seq: int, before: dict, waited: list) -> None:
        after = book.levels()
        for level in before.keys() - after.keys():
            self.levels.removeKey(level)
        for level, size in after.items():
            if before.get(level) != size:
                self.levels.updateValue(level, (float(size),))
        if book.pending != waited:
            own = [(side, float(price), float(size or 0)) for side, price, size in book.pending]
            self.pending.put(own) if own else self.pending.clear()
        self.place.update((book.active, int(last_seq)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _Frame()
        for (channel, book, last_seq), own in self._channels(rows):
            before, waited = book.levels(), list(book.pending)
            for (_, seq, ts, recv), event in own:
                late = seq <= last_seq
                if not late:
                    last_seq = seq
                    if not book.step(*event):
                        continue
                    shown = book.snapshot_time(ts, recv)
                    if shown is None:
                        continue
                arrays = [[], [], [], []] if late else book.shown(self.depth)
                if frame.takes((channel, seq, (ts or 0) if late else shown, recv, 0, *arrays, late)):
                    yield frame.given()
            self._saved(channel, book, last_seq, before, waited)
        if frame.rows:
            yield frame.given()

    def _channels(self, rows) -> Iterator[tuple]:
        for channel, own in groupby(Events(rows).in_order(), key=lambda x: x[0][0]):
            yield (channel, *self._load()), own

    def _saved(self, channel: int, book: Book, last_seq: int, before: dict, waited: list) -> None:
        self._save(book, last_seq, before, waited)

    def close(self) -> None:
        pass


def _parts(levels: dict, count: int) -> list[dict]:
    out: list[dict] = [{} for _ in range(count)]
    for (side, price), size in levels.items():
        out[hash((side == "bid", price)) % count][(side, price)] = size
    return out


def _columns(levels) -> tuple[list, list, list]:
    """Sides, prices and sizes."""
    found = [(side, float(price), float(size or 0)) for side, price, size in levels]
    return tuple(list(c) for c in zip(*found)) if found else ([], [], [])


class GroupProcessor(BookProcessor):
    """Many channels a key. A channel's levels are dealt over parts, twice as many whenever they hold ``PART_LEVELS`` each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        arrays = "sides ARRAY<STRING>, prices ARRAY<DOUBLE>, sizes ARRAY<DOUBLE>"
        self.heads = handle.getMapState("heads", "channel_id BIGINT", f"active BOOLEAN, last_seq BIGINT, parts INT, {arrays}")
        self.parts = handle.getMapState("parts", "channel_id BIGINT, part INT", arrays)
        self.counts: dict[int, int] = {}

    def _channels(self, rows) -> Iterator[tuple]:
        for channel, own in groupby(Events(rows).in_order(), key=lambda x: x[0][0]):
            head = self.heads.getValue((channel,))
            if head is None:
                self.counts = {channel: 0}
                yield (channel, Book(), -(2**63)), own
                continue
            active, last_seq, count, *pending = head
            self.counts = {channel: count}
            held = [self.parts.getValue((channel, k)) for k in range(count)]
            levels = [level for part in held if part is not None for level in zip(*part)]
            yield (channel, Book(levels, zip(*pending), active), last_seq), own

    def _saved(self, channel: int, book: Book, last_seq: int, before: dict, waited: list) -> None:
        known, after = self.counts[channel], book.levels()
        count = max(known, 1)
        while len(after) > PART_LEVELS * count:
            count *= 2
        old = _parts(before, count) if count == known else [None] * count
        for k, part in enumerate(_parts(after, count)):
            if part != old[k]:
                self.parts.updateValue((channel, k), _columns((*level, size) for level, size in part.items()))
        self.heads.updateValue((channel,), (book.active, int(last_seq), count, *_columns(book.pending)))


def stream_snapshots(events: DataFrame, depth: int | None = None) -> DataFrame:
    """Snapshots of a ``book_events`` stream, plus its late rows; ``depth`` cuts what is shown."""
    spark = events.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(provider, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(provider, ROCKSDB)  # the only store that takes this operator
    return (
        events.select(*EVENT_COLUMNS, F.pmod(F.hash("channel_id"), F.lit(GROUPS)).alias("channel_group"))
        .groupBy("channel_group")
        .transformWithStateInPandas(
            statefulProcessor=GroupProcessor(depth),
            outputStructType=OUTPUT,
            outputMode="Append",
            timeMode="None",
        )
    )
