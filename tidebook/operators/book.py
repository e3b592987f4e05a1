"""Order books from event tables.

Books are relations: every effect on a price level is one operation, and what a level shows at some moment is its last
operation since the channel's last image or clear. Sides have as many levels as the events give them; ``depth``
arguments cut only what is shown.

* :func:`book_asof`: the live levels after all given events.
* :func:`book_intervals`: every level with the changes from which and until which it shows: an operation holds from its
  own change to the next operation on its price or the next reset, whichever comes first.
* :func:`book_at`: the books at many moments, from intervals; rows are as many as levels asked for.
* :func:`snapshots`: the whole book after every completed change; rows are as many as levels shown.

No task sees more of a channel than a block of its events or of one price's operations, or one snapshot.

An image with one price twice counts its last size; sides are shown best level first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators.ordered import ROWS, neighbours, running_total
from tidebook.session import scratch

RESETS = "kind = 'IMAGE' OR (kind = 'QUOTE' AND update_type = 'CLEAR')"
_OP = ("channel_id", "side", "price", "qty", "eff_seq", "op_idx")
# Two running numbers in one sum: changes count from the lowest bit, resets from this one.
_RESET_UNIT = 1 << 40


def _quote_size() -> Column:
    return F.when(F.col("size_flag"), F.coalesce(F.col("size"), F.lit(0)).cast("double")).otherwise(F.lit(0.0))


def batch_markers(events: DataFrame, rows: int = ROWS) -> DataFrame:
    """Batch events with the ``eff_seq`` of the commit of the batch each belongs to (NULL without one), and whether that
    batch has ``begun`` before this event.

    A batch ends at an END, END_QUOTE or CLEAR, or before the next BEGIN. So an event's batch is committed by the next
    closing event, if that is a commit and no BEGIN comes first; and it has begun if the last one before this that opens or
    closes a batch opens one. Both are found by blocks, so a batch that never ends is spread over tasks.
    """
    quote = F.col("kind") == "QUOTE"
    marker = (quote & F.col("update_type").isin("BEGIN", "MIDDLE", "END", "CLEAR")) | (
        F.col("kind") == "END_QUOTE"
    )
    commits = (F.col("kind") == "END_QUOTE") | (F.col("update_type") == "END")
    found = events.where(marker).withColumn("commits", commits)
    found = found.withColumn("closes", F.col("commits") | (quote & (F.col("update_type") == "CLEAR")))
    begins = quote & (F.col("update_type") == "BEGIN")
    opens = quote & F.col("update_type").isin("BEGIN", "MIDDLE")
    ends = F.when(F.col("closes") | begins, F.struct("seq", (F.col("closes") & F.col("commits")).alias("commits")))
    placed = neighbours(
        found, "channel_id", "seq", {"begun": F.when(F.col("closes"), False).when(opens, True)}, {"_end": ends}, rows
    )
    ahead = F.when(F.col("_end.commits"), F.col("_end.seq"))
    return placed.withColumns(
        {
            "eff_seq": F.when(F.col("closes"), F.when(F.col("commits"), F.col("seq"))).otherwise(ahead),
            "begun": F.coalesce("begun", F.lit(False)),
        }
    ).drop("_end")


def batched_levels(markers: DataFrame) -> DataFrame:
    """The levels of committed batches, with ``qty`` and ``eff_seq``."""
    held = markers.where(
        (F.col("kind") == "QUOTE") & F.col("update_type").isin("BEGIN", "MIDDLE", "END") & F.col("price_flag")
    )
    return held.where("eff_seq IS NOT NULL").withColumn("qty", _quote_size())


def level_ops(events: DataFrame, rows: int = ROWS, markers: DataFrame | None = None) -> DataFrame:
    """Every effect on a price level as (channel, side, price, qty) with its effective order. ``markers`` are those of the
    events, if known already."""
    images = F.col("kind") == "IMAGE"
    updates = F.col("kind").isin("UPDATE", "HISTORY")
    solo = (F.col("kind") == "QUOTE") & (F.col("update_type") == "SOLO") & F.col("price_flag")

    def side_ops(side: str, column: str) -> Column:
        each = F.transform(
            F.coalesce(F.col(column), F.array().cast("array<struct<price:double,size:bigint>>")),
            lambda x: F.struct(
                F.lit(side).alias("side"),
                x.price.alias("price"),
                F.coalesce(x["size"], F.lit(0)).cast("double").alias("qty"),
            ),
        )
        return F.when(images, F.filter(each, lambda x: x.qty > 0)).otherwise(each)

    own = F.array(F.struct(F.col("side").alias("side"), F.col("price").alias("price"), _quote_size().alias("qty")))
    several = F.concat(side_ops("bid", "bid_levels"), side_ops("ask", "ask_levels"))
    direct = events.where(images | updates | solo).select(
        "channel_id",
        F.col("seq").alias("eff_seq"),
        F.posexplode(F.when(solo, own).otherwise(several)).alias("pos", "l"),
    )
    direct = direct.select("channel_id", "l.side", "l.price", "l.qty", "eff_seq", F.col("pos").cast("bigint").alias("op_idx"))
    batched = batched_levels(batch_markers(events, rows) if markers is None else markers)
    batched = batched.select("channel_id", "side", "price", "qty", "eff_seq", F.col("seq").alias("op_idx"))
    return direct.unionByName(batched).select(*_OP)


def book_asof(events: DataFrame, rows: int = ROWS, markers: DataFrame | None = None) -> DataFrame:
    """Live levels after all given events: (channel_id, side, price, qty).

    For the book at some moment pass ``events.where("recv_us <= ...")``; all channels come at once.
    The last operation per price is found by a map-side combined aggregate, so one hot channel or price
    shuffles one row per task. Only then is the last reset of the channel joined.
    """
    ops = level_ops(events, rows, markers)
    last = ops.groupBy("channel_id", "side", "price").agg(
        F.max_by(F.struct("qty", "eff_seq"), F.struct("eff_seq", "op_idx")).alias("last")
    )
    resets = events.where(RESETS).groupBy("channel_id").agg(F.max("seq").alias("reset_seq"))
    return (
        last.where("last.qty > 0")
        .join(resets, "channel_id", "left")
        .where(F.col("reset_seq").isNull() | (F.col("last.eff_seq") >= F.col("reset_seq")))
        .select("channel_id", "side", "price", F.col("last.qty").alias("qty"))
    )


def ranked(live: DataFrame, depth: int | None = None) -> DataFrame:
    """Levels per channel and side, ``level`` from 1, best first; with ``depth`` a top-k, limited map-side."""
    best_first = F.when(F.col("side") == "ask", F.col("price")).otherwise(-F.col("price"))
    order = Window.partitionBy("channel_id", "side").orderBy(best_first)
    numbered = live.withColumn("level", F.row_number().over(order))
    return numbered if depth is None else numbered.where(F.col("level") <= depth)


def as_arrays(live: DataFrame, depth: int | None = None) -> DataFrame:
    """One row per channel with sorted level arrays of at most ``depth``, if given."""
    top = ranked(live, depth)
    out = top.groupBy("channel_id").agg(
        *[
            F.array_sort(
                F.collect_list(F.when(F.col("side") == side, F.struct("level", "price", "qty")))
            ).alias(side)
            for side in ("bid", "ask")
        ]
    )
    return out.select(
        "channel_id",
        *[
            F.col(f"{side}.{field}").alias(f"{side}_{name}")
            for side in ("bid", "ask")
            for field, name in (("price", "prices"), ("qty", "sizes"))
        ],
    )


def _completed(events: DataFrame, markers: DataFrame) -> DataFrame:
    """The events that complete a change. An END_QUOTE completes one only inside a batch."""
    quote = F.col("kind") == "QUOTE"
    whole = F.col("kind").isin("IMAGE", "UPDATE", "HISTORY") | (
        quote & F.col("update_type").isin("SOLO", "CLEAR", "END")
    )
    columns = ("channel_id", "seq", "exchange_ts", "recv_us", F.expr(RESETS).alias("resets"))
    ended = markers.where("kind = 'END_QUOTE' AND begun")
    return events.where(whole).select(*columns).unionByName(ended.select(*columns))


def changes(events: DataFrame, rows: int = ROWS, markers: DataFrame | None = None) -> DataFrame:
    """Completed changes: (channel_id, seq, exchange_ts, recv_us, rank, epoch), ``rank`` counting them from 1 and
    ``epoch`` counting images and clears."""
    due = _completed(events, batch_markers(events, rows) if markers is None else markers)
    step = F.lit(1).cast("bigint") + F.when(F.col("resets"), F.lit(_RESET_UNIT)).otherwise(F.lit(0))
    counted = running_total(due, "channel_id", "seq", step, "_n", rows)
    rank = F.pmod(F.col("_n"), F.lit(_RESET_UNIT))
    return counted.withColumn("rank", rank).withColumn("epoch", F.shiftright("_n", 40)).drop("_n")


def _stored(rows: DataFrame, label: str) -> DataFrame:
    """Rows written to the shared folder, as several passes read them."""
    path = scratch(rows.sparkSession, label)
    schema = rows.schema
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


_MARKED = ("channel_id", "seq", "exchange_ts", "recv_us", "kind", "update_type", "side", "price", "size", "price_flag", "size_flag", "eff_seq", "begun")


def _markers(events: DataFrame, rows: int) -> DataFrame:
    return _stored(batch_markers(events, rows).select(*_MARKED), "markers")


def _spans(events: DataFrame, due: DataFrame, markers: DataFrame, rows: int) -> DataFrame:
    """Levels with the changes (``rank`` and ``eff_seq``) from which they show, and in ``until`` and ``until_seq`` those
    before which; NULL for levels that show in the end."""
    at = due.select("channel_id", F.col("seq").alias("eff_seq"), "rank", "epoch")
    ops = _stored(level_ops(events, rows, markers).join(at, ["channel_id", "eff_seq"]), "operations")
    resets = due.where("resets").select("channel_id", (F.col("epoch") - 1).alias("epoch"), F.struct(F.col("rank"), F.col("seq")).alias("reset"))
    key, order = ("channel_id", "side", "price"), ("eff_seq", "op_idx")
    held = neighbours(ops, key, order, after={"next": F.struct("rank", F.col("eff_seq").alias("seq"))}, rows=rows)
    held = held.join(resets, ["channel_id", "epoch"], "left").withColumn("end", F.least("next", "reset"))
    lasting = F.col("end").isNull() | (F.col("end.rank") > F.col("rank"))
    return held.where(lasting & (F.col("qty") > 0)).select(
        "channel_id", "side", "price", "qty", "rank", "eff_seq", F.col("end.rank").alias("until"), F.col("end.seq").alias("until_seq")
    )


def book_intervals(events: DataFrame, rows: int = ROWS) -> DataFrame:
    """Every level ever shown: (channel_id, side, price, qty, valid_from, valid_until), the ``seq`` of the change with
    which it shows, and of the one with which it no longer does; NULL if it shows in the end. Rows are as many as
    operations, however long levels last."""
    events = _stored(events, "events")
    markers = _markers(events, rows)
    due = _stored(changes(events, rows, markers), "changes")
    spans = _spans(events, due, markers, rows)
    return spans.select(
        "channel_id", "side", "price", "qty", F.col("eff_seq").alias("valid_from"), F.col("until_seq").alias("valid_until")
    )


def book_at(intervals: DataFrame, moments: DataFrame, rows: int = ROWS) -> DataFrame:
    """The levels that show at each of the moments (channel_id, at), ``at`` being a ``seq``: (channel_id, at, side, price,
    qty).

    Moments are numbered in their order within a channel; the ends of intervals take their place among them, so that an
    interval knows the numbers of the moments it covers. Only levels that some moment asks for become rows.
    """
    intervals = _stored(intervals, "intervals")
    asked = moments.where("channel_id IS NOT NULL AND at IS NOT NULL").select("channel_id", F.col("at").cast("bigint").alias("at")).distinct()
    ends = intervals.select("channel_id", F.explode(F.array("valid_from", "valid_until")).alias("at")).where("at IS NOT NULL").distinct()
    # A moment at the seq of a change shows it, so among equal ones the end of an interval comes first.
    both = asked.select("channel_id", "at", F.lit(1).alias("asks")).unionByName(ends.select("channel_id", "at", F.lit(0).alias("asks")))
    both = both.withColumn("place", F.col("at") * 2 + F.col("asks"))
    placed = _stored(running_total(both, "channel_id", "place", F.col("asks"), "n", rows).select("channel_id", "at", "asks", "n"), "moments")
    numbers = placed.where("asks = 1").select("channel_id", "at", "n")
    before = placed.where("asks = 0")
    first = before.select("channel_id", F.col("at").alias("valid_from"), (F.col("n") + 1).alias("first"))
    stop = before.select("channel_id", F.col("at").alias("valid_until"), F.col("n").alias("last"))
    final = numbers.groupBy("channel_id").agg(F.max("n").alias("final"))
    covered = intervals.join(first, ["channel_id", "valid_from"]).join(stop, ["channel_id", "valid_until"], "left").join(final, "channel_id")
    last = F.coalesce("last", "final")
    shown = covered.where(F.col("first") <= last).withColumn("n", F.explode(F.sequence("first", last)))
    return shown.join(numbers, ["channel_id", "n"]).select("channel_id", "at", "side", "price", "qty")


def snapshots(events: DataFrame, depth: int | None = None, last_only: bool = False, rows: int = ROWS) -> DataFrame:
    """The book after every completed change; with ``last_only`` only after the last one of each channel, which is the
    book after all events, as others have no effect.

    ``seq`` must be unique per channel. A change without an exchange time shows the receive time, or nothing when the
    book is then empty.
    """
    events = _stored(events, "events")
    markers = _markers(events, rows)
    if last_only:
        newest = F.max_by(F.struct("seq", "exchange_ts", "recv_us"), "seq").alias("e")
        due = _completed(events, markers).groupBy("channel_id").agg(newest).select("channel_id", "e.*", F.lit(1).alias("rank"))
        shown = book_asof(events, rows, markers).withColumn("rank", F.lit(1))
    else:
        due = _stored(changes(events, rows, markers), "changes")
        last = due.groupBy("channel_id").agg(F.max("rank").alias("last"))
        spans = _spans(events, due, markers, rows).join(last, "channel_id")
        shown = spans.withColumn("rank", F.explode(F.sequence("rank", F.coalesce(F.col("until") - 1, "last"))))

    def side(name: str) -> Column:
        pair = F.struct(F.col("price"), F.col("qty"))
        found = F.array_sort(F.collect_list(F.when(F.col("side") == name, pair)))
        found = F.reverse(found) if name == "bid" else found
        return (found if depth is None else F.slice(found, 1, depth)).alias(name)

    books = shown.groupBy("channel_id", "rank").agg(side("bid"), side("ask"))
    joined = due.join(books, ["channel_id", "rank"], "left")
    filled = F.col("bid").isNotNull()
    ts = F.when(F.coalesce("exchange_ts", F.lit(0)) != 0, F.col("exchange_ts")).when(filled, F.col("recv_us"))
    none = F.array().cast("array<double>")
    arrays = [
        F.coalesce(F.col(f"{name}.{field}"), none).alias(f"{name}_{label}")
        for name in ("bid", "ask")
        for field, label in (("price", "prices"), ("qty", "sizes"))
    ]
    shaped = joined.withColumn("exchange_timestamp", ts).where("exchange_timestamp IS NOT NULL")
    return shaped.select(
        "channel_id", "seq", "exchange_timestamp", "recv_us", F.lit(0).cast("bigint").alias("last_update_id"), *arrays
    )


def depth_records(snapshots: DataFrame) -> DataFrame:
    """Snapshots in the shape of parsed depth records, for enrichment and sinks."""

    def side(name: str):
        return F.transform(
            F.arrays_zip(f"{name}_prices", f"{name}_sizes"),
            lambda x: F.struct(x[f"{name}_prices"].alias("price"), x[f"{name}_sizes"].alias("quantity")),
        )

    return snapshots.select(
        "channel_id", F.lit(None).cast("string").alias("symbol"), "seq", "recv_us",
        F.lit(0).cast("bigint").alias("local_diff"), "exchange_timestamp", "last_update_id",
        side("bid").alias("bids"), side("ask").alias("asks"),
    )
