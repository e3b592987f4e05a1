import random

import model
import pytest
from pyspark.sql import functions as F

from tidebook import schemas
from tidebook.operators import book
from tidebook.operators.fold import EVENT_COLUMNS, Book
from tidebook.operators.ordered import _blocked, neighbours, previous_in_order, running_total


def event(seq, kind="QUOTE", mark="SOLO", side="bid", price=None, size=None, bids=None, asks=None, channel=1, **more):
    def rows(pairs):
        return None if pairs is None else [{"price": float(p), "size": s} for p, s in pairs]

    row = {
        "channel_id": channel, "seq": seq, "exchange_ts": 1000 + seq, "recv_us": 5000 + seq, "kind": kind, "side": side,
        "update_type": mark, "price_flag": price is not None, "size_flag": size is not None, "price": price,
        "size": size, "bid_levels": rows(bids), "ask_levels": rows(asks),
    }
    return {**row, **more}


def image(seq, bids=(), asks=()):
    return event(seq, "IMAGE", bids=bids, asks=asks)


def quote(seq, mark, price, size, side="bid"):
    return event(seq, "QUOTE", mark, side, float(price), size)


def folded(*events):
    state = Book()
    due = [state.step(*[e[c] for c in EVENT_COLUMNS[4:]]) for e in events]
    bid_prices, bid_sizes, ask_prices, ask_sizes = state.shown()
    return list(zip(bid_prices, bid_sizes)), list(zip(ask_prices, ask_sizes)), due, state


def test_image_skips_empty_sizes_and_replaces():
    assert folded(image(1, bids=[(4500, 10), (4499, 0), (4498, 20)]))[0] == [(4500, 10), (4498, 20)]
    assert folded(image(1, bids=[(100, 5), (99, 10)]), image(2, bids=[(101, 7)]))[0] == [(101, 7)]


def test_batch_is_atomic_and_mixed():
    start = image(1, bids=[(100, 5), (99, 10), (98, 3)])
    begun = (start, quote(2, "BEGIN", 99, 20), quote(3, "MIDDLE", 101, 7))
    assert folded(*begun)[0] == [(100, 5), (99, 10), (98, 3)]
    bids, _, due, _ = folded(*begun, event(4, "END_QUOTE"))
    assert bids == [(101, 7), (100, 5), (99, 20), (98, 3)]
    assert due == [True, False, False, True]
    bids, asks, _, _ = folded(quote(1, "BEGIN", 100, 5), quote(2, "END", 101, 3, "ask"))
    assert (bids, asks) == ([(100, 5)], [(101, 3)])


def test_begin_cancels_and_clear_empties():
    assert folded(quote(1, "BEGIN", 99, 5), quote(2, "BEGIN", 98, 5), event(3, "END_QUOTE"))[0] == [(98, 5)]
    bids, asks, due, state = folded(
        image(1, [(100, 5)], [(101, 5)]), quote(2, "BEGIN", 99, 5), event(3, mark="CLEAR"), event(4, "END_QUOTE")
    )
    assert (bids, asks, due) == ([], [], [True, False, True, False])
    assert not state.active


def test_sides_have_no_limit():
    asks = [quote(i, "SOLO", 100 + i * 0.25, 1, "ask") for i in range(300)]
    _, out, _, state = folded(*asks, quote(400, "SOLO", 1, 1, "ask"))
    assert len(out) == 301 and out[0][0] == 1.0
    assert [len(x) for x in state.shown(5)] == [0, 0, 5, 5]


def test_sorted_sides_and_last_size_wins():
    bids = folded(*[quote(i, "SOLO", p, 1) for i, p in enumerate((99, 101, 100, 98, 102))])[0]
    assert [p for p, _ in bids] == [102, 101, 100, 99, 98]
    asks = folded(*[quote(i, "SOLO", p, 1, "ask") for i, p in enumerate((101, 99, 100, 102, 98))])[1]
    assert [p for p, _ in asks] == [98, 99, 100, 101, 102]
    assert folded(quote(1, "SOLO", 100, 5), quote(2, "SOLO", 100, 10))[0] == [(100, 10)]


def test_zero_time():
    state = Book()
    assert state.snapshot_time(1234567890123456, 9) == 1234567890123456
    assert state.snapshot_time(0, 9) is None
    state.put([("bid", 100.0, 5.0)])
    assert state.snapshot_time(0, 9) == 9


def random_events(seed, count, channels, prices, images, clears):
    r = random.Random(seed)
    out = []
    for channel in channels:
        for i in range(count * 3 if channel == 0 else count):
            x, pairs = r.random(), []
            for _ in range(2):
                chosen = r.sample(range(prices), min(prices, r.choice([0, 3, 10])))
                pairs.append([(p, r.choice([0, 1, 5])) for p in chosen])
            more = {"channel": channel, "exchange_ts": r.choice([0, 1000 + i])}
            seq = i * 2 + channel
            price = float(r.randrange(prices)) if r.random() < 0.95 else None
            size = r.choice([0, 1, 2, 3]) if r.random() < 0.95 else None
            side = r.choice(["bid", "ask"])
            if x < images:
                e = event(seq, "IMAGE", bids=sorted(pairs[0], reverse=True), asks=sorted(pairs[1]), **more)
            elif x < images + clears:
                e = event(seq, mark="CLEAR", **more)
            elif x < 0.1:
                e = event(seq, "UPDATE", bids=pairs[0], asks=pairs[1], **more)
            elif x < 0.15:
                e = event(seq, "END_QUOTE", **more)
            else:
                marks = ["BEGIN", "MIDDLE", "MIDDLE", "END", "UNDEFINED"] if x < 0.6 else ["SOLO"]
                e = event(seq, mark=r.choice(marks), side=side, price=price, size=size, **more)
            out.append(e)
    return out


def frame(spark, events):
    return spark.createDataFrame([tuple(e[c] for c in EVENT_COLUMNS) for e in events], schemas.BOOK_EVENTS)


def modelled(events):
    channels = sorted({e["channel_id"] for e in events})
    return {
        (c, seq): (ts, bids, asks)
        for c in channels
        for seq, ts, bids, asks in model.snapshots([e for e in events if e["channel_id"] == c])
    }


def collected(snapshots):
    return {
        (r.channel_id, r.seq): (
            r.exchange_timestamp,
            list(zip(r.bid_prices, r.bid_sizes)),
            list(zip(r.ask_prices, r.ask_sizes)),
        )
        for r in snapshots.collect()
    }


@pytest.mark.parametrize(
    "prices, images, clears", [(30, 0.02, 0.01), (400, 0.0, 0.0)], ids=["with resets", "deep sides"]
)
def test_snapshots_equal_model(spark, prices, images, clears):
    events = random_events(7, 300, (0, 1, 2), prices, images, clears)
    want = modelled(events)
    assert (max(len(v[1]) for v in want.values()) > 100) == (prices > 100)
    assert collected(book.snapshots(frame(spark, events), rows=64)) == want
    events = [{**e, "exchange_ts": 1 + e["seq"]} for e in events]  # a clear without a time shows no snapshot
    want = modelled(events)
    last = collected(book.snapshots(frame(spark, events), rows=64, last_only=True))
    newest = {c: max(s for k, s in want if k == c) for c in (0, 1, 2)}
    assert last == {(c, s): want[(c, s)] for c, s in newest.items()}
    cut = collected(book.snapshots(frame(spark, events), depth=2, rows=64))
    assert cut == {k: (ts, bids[:2], asks[:2]) for k, (ts, bids, asks) in want.items()}


def test_zero_times_and_null_sizes(spark):
    events = [
        image(1, bids=[(10, 1), (9, None)], asks=[(11, 2)]), event(2, mark="CLEAR", exchange_ts=0),
        quote(3, "SOLO", 10, 3), {**quote(4, "SOLO", 10, 0), "exchange_ts": 0}, {**quote(5, "SOLO", 10, 4), "exchange_ts": 0},
    ]
    got = collected(book.snapshots(frame(spark, events)))
    assert got == modelled(events)
    assert {seq: ts for (_, seq), (ts, _, _) in got.items()} == {1: 1001, 3: 1003, 5: 5005}


def test_asof_equals_model_at_any_moment(spark):
    events = random_events(11, 200, (0, 1, 2), 30, 0.02, 0.01)
    events = [{**e, "exchange_ts": 1 + e["seq"]} for e in events]  # a clear without a time shows no snapshot
    for moment in (150, 10**9):
        seen = [e for e in events if e["seq"] <= moment]
        want = modelled(seen)
        newest = {c: max(s for k, s in want if k == c) for c in (0, 1, 2)}
        levels = {
            (c, side, p, q)
            for c, s in newest.items()
            for side, pairs in zip(("bid", "ask"), want[(c, s)][1:])
            for p, q in pairs
        }
        live = book.book_asof(frame(spark, events).where(f"seq <= {moment}"), rows=32)
        assert {tuple(r) for r in live.collect()} == levels
    arrays = {r.channel_id: r for r in book.as_arrays(live, 3).collect()}
    for c, s in newest.items():
        assert list(zip(arrays[c].bid_prices, arrays[c].bid_sizes)) == want[(c, s)][1][:3]
        assert list(zip(arrays[c].ask_prices, arrays[c].ask_sizes)) == want[(c, s)][2][:3]


@pytest.mark.parametrize("scale", [1, 10**9])
def test_ordered_columns_over_blocks(spark, scale):
    r = random.Random(5)
    rows = [(k, s * scale, r.randrange(10)) for k in (1, 2) for s in r.sample(range(1000), 60)]
    df = spark.createDataFrame(rows, "k INT, s BIGINT, v INT")
    want_lag, want_sum = {}, {}
    for k in (1, 2):
        before, total = None, 0
        for _, s, v in sorted(x for x in rows if x[0] == k):
            total += v
            want_lag[(k, s)], want_sum[(k, s)] = before, total
            before = v
    lagged = previous_in_order(df, "k", "s", "v", "p", rows=16).collect()
    assert {(x.k, x.s): x.p for x in lagged} == want_lag
    summed = running_total(df, "k", "s", df.v, "t", rows=16).collect()
    assert {(x.k, x.s): x.t for x in summed} == want_sum


@pytest.mark.parametrize("orders", ["id * 1000000007", "id", "CASE WHEN id = 0 THEN 1000000000000000 ELSE id END", "id * id * id"])
def test_blocks_are_alike_in_size_however_orders_lie(spark, orders):
    df = spark.range(20000).selectExpr("1 AS k", f"{orders} AS s").unionByName(spark.range(50).selectExpr("2 AS k", "id AS s"))
    sizes = {(r.k, r._block): r["count"] for r in _blocked(df, "k", "s", 500).groupBy("k", "_block").count().collect()}
    assert len([b for k, b in sizes if k == 1]) == 40 and max(sizes.values()) <= 1000
    assert sizes[(2, 0)] == 50 and sum(sizes.values()) == 20050


def test_neighbours_skip_nulls_and_cross_blocks(spark):
    r = random.Random(8)
    rows = [(1, s, i, r.choice([None, None, None, s])) for s in range(120) for i in range(2)] + [(2, 0, 0, None)]
    df = spark.createDataFrame(rows, "k INT, s BIGINT, i INT, v BIGINT")
    got = neighbours(df, ["k"], ["s", "i"], {"b": F.col("v")}, {"a": F.col("v")}, rows=9).collect()
    assert len(got) == len(rows)
    for x in got:
        before = [v for k, s, i, v in rows if k == x.k and (s, i) < (x.s, x.i) and v is not None]
        after = [v for k, s, i, v in rows if k == x.k and (s, i) > (x.s, x.i) and v is not None]
        assert (x.b, x.a) == (before[-1] if before else None, after[0] if after else None)


def test_a_batch_that_never_ends_is_spread(spark):
    """No window is by batch; one that closes after very many events commits them all."""
    n = 3000
    events = [quote(1, "BEGIN", 5, 1), *[quote(k, "MIDDLE", k % 50, 1 + k % 3) for k in range(2, n)]]
    assert book.batched_levels(book.batch_markers(frame(spark, events), rows=100)).count() == 0
    ended = frame(spark, [*events, event(n, "END_QUOTE")])
    markers = book.batch_markers(ended, rows=100)
    assert {(r.eff_seq, r.begun) for r in markers.where("seq > 1").select("eff_seq", "begun").distinct().collect()} == {(n, True)}
    assert book.book_asof(ended, rows=100).count() == 50


def test_intervals_and_books_at_many_moments(spark):
    events = random_events(13, 250, (0, 1, 2), 25, 0.02, 0.01)
    events = [{**e, "exchange_ts": 1 + e["seq"]} for e in events]
    want = modelled(events)
    r = random.Random(1)
    moments = [(c, r.randrange(-5, 1600)) for c in (0, 1, 2, 9) for _ in range(60)] + [(0, s) for (c, s) in want if c == 0][:40]
    levels = set()
    for c, at in moments:
        seen = [s for k, s in want if k == c and s <= at]
        for side, pairs in zip(("bid", "ask"), want[(c, max(seen))][1:] if seen else ()):
            levels |= {(c, at, side, p, q) for p, q in pairs}
    intervals = book.book_intervals(frame(spark, events), rows=40)
    asked = spark.createDataFrame([*moments, moments[0], (None, 3), (1, None)], "channel_id BIGINT, at BIGINT")
    assert sorted(map(tuple, book.book_at(intervals, asked, rows=40).collect())) == sorted(levels)
    assert intervals.where("valid_until <= valid_from OR qty <= 0").count() == 0
    assert book.book_at(intervals, asked.limit(0)).count() == 0


def test_a_price_that_flickers_is_cut_too(spark):
    events = [quote(k, "SOLO", 7, k % 3) for k in range(2000)]
    found = book.book_intervals(frame(spark, events), rows=64)
    assert found.count() == sum(k % 3 > 0 for k in range(2000))
    assert found.where("valid_until IS NULL").collect()[0].valid_from == 1999


def test_keys_of_one_block_are_not_cut(spark):
    """Cuts, and joins that put them to rows, are for tables that have a large key."""
    df = spark.range(200).selectExpr("id % 4 AS k", "id AS s", "IF(id % 3 = 0, id, NULL) AS v")
    found = neighbours(df, "k", "s", {"b": F.col("v")}, {"a": F.col("v")}, rows=50)
    summed = running_total(df, "k", "s", F.col("s"), "t", rows=50)
    for plan in (found, summed):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in text and "percentile" not in text
    cut = neighbours(df, "k", "s", {"b": F.col("v")}, {"a": F.col("v")}, rows=49)
    assert "Join" in cut._jdf.queryExecution().optimizedPlan().toString()
    names = ["k", "s", "v", "b", "a"]
    assert sorted(map(str, found.select(names).collect())) == sorted(map(str, cut.select(names).collect()))
    assert {(r.k, r.s): r.t for r in summed.collect()} == {(s % 4, s): sum(range(s % 4, s + 1, 4)) for s in range(200)}


@pytest.mark.parametrize("books", [book.book_intervals, book.snapshots])
def test_events_are_made_once(spark, books):
    made = spark.sparkContext.accumulator(0)

    def same(seq):
        made.add(1)
        return seq

    events = frame(spark, random_events(3, 60, (1, 2), 10, 0.02, 0.01))
    books(events.withColumn("seq", F.udf(same, "bigint")("seq"))).collect()
    assert made.value == 120
