"""Missing ids of a stream, as a log of gaps that open and close.

State holds, for each channel, the ranges of ids seen so far. Ids that come late fill gaps or split them; a gap that is
no longer as it was is closed, and what is left of it is opened anew. So the gaps opened and not closed are at any time
those of all ids seen, whatever order they came in. A channel's state is as large as it has gaps. Channels that share a
group are one key, whose state is read and put back whole, in one call, when ids of any of them come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidebook.streaming.book import ROCKSDB

OUTPUT = "channel_id BIGINT, previous_id BIGINT, trade_id BIGINT, gap BIGINT, opened BOOLEAN"
NAMES = [f.split()[0] for f in OUTPUT.split(", ")]
FRAME_ROWS = 50_000
#: A key of the state costs some milliseconds a micro-batch, whatever it holds; so there are at most that many.
GROUPS = 1 << 12


def ranges_of(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges (both ends seen) of ids and earlier ranges together, touching ones joined."""
    b, e = np.concatenate([begins, ids]), np.concatenate([ends, ids])
    order = np.argsort(b, kind="stable")
    b, e = b[order], np.maximum.accumulate(e[order])
    new = np.concatenate([[True], b[1:] > e[:-1] + 1])
    return b[new], e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(b) - 1]])]


class GapProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "channel_id BIGINT, first BIGINT, last BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[int, int]]] = {}
        for channel, first, last in self.seen.get():
            held.setdefault(channel, []).append((first, last))
        found = pd.concat([f for f in rows]).dropna(subset=["trade_id"])
        changes = []
        for channel, own in found.groupby("channel_id", dropna=False)["trade_id"]:
            channel = int(channel)
            begins, ends = np.array(held.get(channel, []), np.int64).reshape(-1, 2).T
            b, e = ranges_of(np.unique(own.to_numpy(np.int64)), begins, ends)
            held[channel] = list(zip(b.tolist(), e.tolist()))
            old = set(zip(ends[:-1].tolist(), begins[1:].tolist()))
            now = set(zip(e[:-1].tolist(), b[1:].tolist()))
            changes += [(channel, p, t, t - p - 1, False) for p, t in sorted(old - now)]
            changes += [(channel, p, t, t - p - 1, True) for p, t in sorted(now - old)]
        if len(found):
            self.seen.put([(channel, *r) for channel, own in held.items() for r in own])
        for k in range(0, len(changes), FRAME_ROWS):
            yield pd.DataFrame(changes[k : k + FRAME_ROWS], columns=NAMES)

    def close(self) -> None:
        pass


def stream_gaps(ids: DataFrame) -> DataFrame:
    """The log of a stream of (channel_id, trade_id)."""
    spark = ids.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(provider, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(provider, ROCKSDB)
    return (
        ids.select(F.pmod(F.hash("channel_id"), F.lit(GROUPS)).alias("group"), "channel_id", "trade_id")
        .groupBy("group")
        .transformWithStateInPandas(
            statefulProcessor=GapProcessor(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
        )
    )


def open_gaps(log: DataFrame) -> DataFrame:
    """The gaps that a log leaves open."""
    balance = F.sum(F.when(F.col("opened"), 1).otherwise(-1)).alias("balance")
    return log.groupBy("channel_id", "previous_id", "trade_id", "gap").agg(balance).where("balance > 0").drop("balance")
