import os
import random
import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidebook import schemas
from tidebook.feeds import futures
from tidebook.operators import book, enrich, tables, telemetry
from tidebook.operators.parse import parse_messages
from tidebook.plans import queries
from tidebook.plans.records import judged, outcomes, records_from_raw
from tidebook.sinks import deadletter, topics
from tidebook.sinks import tables as sinks
from tidebook.sources import csv_tree, registry
from tidebook.sources.messages import read_table, stream_table
from tidebook.streaming import book as stream_book
from tidebook.streaming import commits
from tidebook.streaming import feed as stream_feed
from tidebook.streaming.gaps import ranges_of
from tidebook.streaming.gauges import Gauges
from test_book import collected, frame, modelled, random_events

CONFIG = """{"exchanges": [
  {"name": "binance", "enabled": true, "channels": [{"type": "spot", "symbols": [
     {"name": "BTCUSDT"}, {"name": "ETHUSDT", "depth_level": 3, "record_tick": false},
     {"name": "OFF", "enabled": false}, {"name": "MEM", "persist_to_disk": false}]}]},
  {"name": "gateio", "channels": [{"type": "spot", "symbols": [{"name": "BTC_USDT"}]}]},
  {"name": "COMEX", "enabled": true, "channels": [{"type": "futures", "symbols": [{"name": "GC", "depth_level": 20}]}]}
]}"""


@pytest.fixture(scope="module")
def channels(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("config") / "channels.json"
    path.write_text(CONFIG)
    return registry.register(registry.channels_from_config(registry.read_config(spark, str(path)))).cache()


def test_registry_from_config(channels):
    rows = {r.symbol: r for r in channels.collect()}
    assert set(rows) == {"BTCUSDT", "ETHUSDT", "MEM", "GC"}
    assert rows["BTCUSDT"].depth_level == 5 and rows["BTCUSDT"].channel_id == 273472201
    assert not rows["ETHUSDT"].record_tick and not rows["MEM"].persist_to_disk
    assert rows["GC"].topic_prefix == "COMEX:futures:GC"


def named(spark, *rows):
    full = [(*r, True, True, True) for r in rows]
    ddl = "exchange STRING, market_type STRING, symbol STRING, depth_level INT, enabled BOOLEAN, "
    return registry.with_identity(
        spark.createDataFrame(full, ddl + "record_tick BOOLEAN, persist_to_disk BOOLEAN")
    )


@pytest.mark.parametrize(
    "row, problem",
    [
        (("x", "spot", "", 5), "symbol_missing"),
        (("x", "spot", "A", -1), "depth_out_of_range"),
        (("x", "options", "A", 5), "market_type"),
        (("x", "spot", "Ä", 5), "not_ascii"),
    ],
)
def test_registry_refuses(spark, row, problem):
    with pytest.raises(registry.RegistryError, match=problem):
        registry.register(named(spark, row))


def test_registry_collisions(spark):
    twice = named(spark, ("x", "spot", "A", 5), ("x", "spot", "A", 5))
    assert registry.register(twice).count() == 1
    clash = twice.withColumn("topic_prefix", F.concat("topic_prefix", F.monotonically_increasing_id()))
    with pytest.raises(registry.RegistryError, match="claimed by 2"):
        registry.register(clash)


TRADE = '{"e":"aggTrade","E":%d,"a":%d,"p":"10.5","q":"2","m":true}'
TICKER = '{"b":"1","B":"2","a":"3","A":"4"}'
DEPTH = '{"lastUpdateId":9,"bids":[["2","1"],["1","1"]],"asks":[["3","1"]]}'
TS = 1_717_200_000_000_000


def raw_rows(channels):
    ids = {r.symbol: r.channel_id for r in channels.select("symbol", "channel_id").collect()}
    out = []
    for seq, (symbol, payload) in enumerate(
        [
            ("BTCUSDT", TRADE % (TS, 1)), ("BTCUSDT", TRADE % (TS + 86_400_000_000, 2)), ("BTCUSDT", TICKER),
            ("BTCUSDT", DEPTH), ("ETHUSDT", TRADE % (TS, 3)), ("ETHUSDT", DEPTH), ("MEM", TRADE % (TS, 4)),
            ("NEW", TRADE % (TS, 5)), ("BTCUSDT", TRADE % (0, 6)), ("BTCUSDT", "{bad"), ("BTCUSDT", TRADE % (TS - 5, 7)),
        ]
    ):
        channel = ids.get(symbol, 42)
        out.append((channel, "binance", "spot", symbol, seq, TS + seq, 1000, 4000 + seq, payload))
    return out


@pytest.fixture(scope="module")
def raw(spark, channels):
    return spark.createDataFrame(raw_rows(channels), schemas.RAW_FEED)


def ddl(df):
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def expected(spark, kind):
    return ddl(spark.createDataFrame([], schemas.TABLES[kind]))


def test_records(spark, raw, channels):
    records = records_from_raw(raw, channels, 2024)
    assert ddl(records.trades()) == expected(spark, "trades")
    assert ddl(records.orderbook()) == expected(spark, "orderbook")
    assert ddl(records.bookticker()) == expected(spark, "bookticker")
    assert sorted(r.trade_id for r in records.trades().collect()) == [1, 2, 4, 7]
    assert sorted(r.trade_id for r in records.persisted().trades().collect()) == [1, 2, 7]
    assert sorted(r.trade_id for r in enrich.of_persisted_channels(records.trades(), channels).collect()) == [1, 2, 7]
    books = {r.symbol: r for r in records.orderbook(keep_update_id=True).collect()}
    assert books["BTCUSDT"].bid_prices == [2.0, 1.0, 0.0, 0.0, 0.0] and books["BTCUSDT"].last_update_id == 9
    assert books["ETHUSDT"].ask_sizes == [1.0, 0.0, 0.0]
    reasons = {(r.seq, r.reject_reason) for r in records.rejects.collect()}
    assert reasons == {(4, "unrecorded"), (7, "unregistered"), (8, "invalid_time"), (9, "malformed")}
    totals = {r.reject_reason: r.dropped for r in telemetry.drop_totals(records.rejects).collect()}
    assert totals == {"unrecorded": 1, "unregistered": 1, "invalid_time": 1, "malformed": 1, None: 4}
    plan = records.rejects._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_unregistered_defaults(spark, raw, channels):
    from tidebook.operators import parse

    ticks = parse.tick_records(parse.parse_messages(raw))
    row = enrich.with_defaults(ticks, channels).where("trade_id = 5").first()
    assert (row.exchange, row.market_type, row.symbol, row.depth_level) == ("", "", "NEW", 0)


def test_channels_of_one_group_keep_their_own_gaps(spark, tmp_path, monkeypatch):
    from tidebook.streaming import gaps

    monkeypatch.setattr(gaps, "GROUPS", 1)
    source, out = str(tmp_path / "ids"), str(tmp_path / "log")
    for ids in ([(1, 1), (1, 9), (2, 5)], [(1, 5), (3, 7), (2, 9), (3, 8)], [(2, 6), (2, 7), (2, 8)]):
        spark.createDataFrame(ids, "channel_id BIGINT, trade_id BIGINT").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("channel_id BIGINT, trade_id BIGINT").option("maxFilesPerTrigger", 1).parquet(source)
    run = gaps.stream_gaps(stream).writeStream.format("parquet").option("path", out)
    run.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    left = gaps.open_gaps(spark.read.schema(gaps.OUTPUT).parquet(out)).collect()
    assert sorted((r.channel_id, r.previous_id, r.trade_id, r.gap) for r in left) == [(1, 1, 5, 3), (1, 5, 9, 3)]


def test_lines_of_order_books_are_not_dealt_by_file(spark, tmp_path):
    path = tmp_path / "ex" / "spot" / "A" / "orderbook_2024-06-01.csv"
    path.parent.mkdir(parents=True)
    path.write_text("exchange_timestamp,local_diff,ask_price1,ask_size1,bid_price1,bid_size1\n1717200000000002,5,11,1,10,2\n")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = csv_tree.read_orderbook(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan


def test_channels_that_share_an_id(spark):
    from tidebook.operators import parse
    from tidebook.sources.registry import with_identity

    flags = "exchange STRING, market_type STRING, symbol STRING, depth_level INT, enabled BOOLEAN, record_tick BOOLEAN, persist_to_disk BOOLEAN"
    rows = [("binance", "spot", "U7591", 3, True, True, True), ("binance", "spot", "U48764", 7, True, False, True)]
    plain = spark.createDataFrame(rows, flags)
    channels = with_identity(plain.withColumns({"exchange": F.lit("binance"), "market_type": F.lit("spot")}))  # never NULL
    shared = {r.channel_id for r in channels.collect()}
    assert len(shared) == 1  # two keys, one hash of 32 bits
    names = [("U7591", 1), ("U48764", 2), ("OTHER", 3)]
    raw = spark.createDataFrame([(*shared, "binance", "spot", s, k, TS, 0, 0, TRADE % (TS, k)) for s, k in names], schemas.RAW_FEED)
    ticks = parse.tick_records(parse.parse_messages(raw))
    found = {(r.seq, r.symbol, r.depth_level) for r in enrich.registered(ticks, channels).collect()}
    assert found == {(1, "U7591", 3), (2, "U48764", 7)}
    assert sorted((r.seq, r.exchange, r.depth_level) for r in enrich.with_defaults(ticks, channels).collect()) == [(1, "binance", 3), (2, "binance", 7), (3, "", 0)]
    assert [r.symbol for r in enrich.unregistered(ticks, channels).collect()] == ["OTHER"]
    counts = {r.outcome: r.messages for r in outcomes(judged(parse.parse_messages(raw), channels, 2024)).collect()}
    assert counts == {"stored": 1, "unrecorded": 1, "unregistered": 1}


def test_futures(spark, channels):
    rows = [("COMEX ", "GC   ", 5, 7, 4500.5, 3, "S", 1), ("COMEX", "SI", 5, 7, 30.0, 1, "B", 1)]
    prints = spark.createDataFrame(rows, schemas.FUTURES_TRADES)
    (trade,) = futures.normalise_trades(prints, channels).collect()
    assert (trade.channel_id, trade.exchange_timestamp, trade.quantity) == (2260885141, 5_000_007, 3.0)
    assert trade.is_buyer_maker and trade.trade_id == 0
    assert [r.ticker for r in futures.unmapped(prints, channels).collect()] == ["SI"]
    bbo = spark.createDataFrame(
        [("COMEX", "GC", 5, 7, 1.0, 2, 3.0, 4, True, False, False, True, 1)], schemas.FUTURES_BBO
    )
    (quote,) = futures.normalise_bbo(bbo, channels).collect()
    assert (quote.best_bid_price, quote.best_bid_qty, quote.best_ask_price, quote.best_ask_qty) == (1.0, 0.0, 0.0, 4.0)


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_flat_csv_tree(spark, tmp_path):
    root = str(tmp_path)
    folder = f"{root}/ex/spot/BTCUSDT"
    trades = "exchange_timestamp,local_diff,price,quantity,direction\n"
    write(f"{folder}/trades_2024-06-01.csv", trades + "1717200000000000,12345,50000.5,0.123,-1\n")
    ticker = "exchange_timestamp,local_diff,symbol,best_bid_price,best_bid_qty,best_ask_price,best_ask_qty\n"
    write(f"{folder}/bookticker_2024-06-01.csv", ticker + "1717200000000000,100,OTHER,50000,1.5,50001,2\n")
    two = "exchange_timestamp,local_diff" + "".join(f",ask_price{i},ask_size{i},bid_price{i},bid_size{i}" for i in (1, 2))
    one = "exchange_timestamp,local_diff,ask_price1,ask_size1,bid_price1,bid_size1"
    book_text = f"{two}\n1717200000000000,5,11,1,10,2,12,3,9,4\n{two}\n1717200000000001,5,11,1,10,2,0,0,0,0\n"
    write(f"{folder}/orderbook_2024-06-01.csv", book_text)
    write(f"{root}/ex/spot/ETH/orderbook_2024-06-01.csv", f"{one}\n1717200000000002,5,11,1,10,2\n")
    (t,) = csv_tree.read_trades(spark, root).collect()
    assert (t.price, t.quantity, t.direction, t.is_buyer_maker, t.trade_id) == (50000.5, 0.123, -1, True, 0)
    assert (t.exchange, t.market_type, t.symbol, str(t.trade_date)) == ("ex", "spot", "BTCUSDT", "2024-06-01")
    (q,) = csv_tree.read_bookticker(spark, root).collect()
    assert (q.symbol, q.best_bid_price, q.best_ask_qty) == ("BTCUSDT", 50000.0, 2.0)
    books = {r.exchange_timestamp % 10: r for r in csv_tree.read_orderbook(spark, root).collect()}
    assert books[0].ask_prices == [11.0, 12.0] and books[0].bid_sizes == [2.0, 4.0]
    assert books[1].ask_prices == [11.0, 0.0]
    assert books[2].ask_prices == [11.0] and books[2].symbol == "ETH"
    report = csv_tree.load_report(csv_tree.read_orderbook(spark, root, keep_path=True))
    assert sorted(r["rows"] for r in report.collect()) == [1, 2, 3]


def test_orderbook_columns_by_name(spark, tmp_path):
    columns = ["exchange_timestamp", "local_diff", "bid_price1", "ask_price1", "ask_price2"]
    write(f"{tmp_path}/ex/spot/A/orderbook_2024-06-01.csv", ",".join(columns) + "\n1717200000000000,5,1,2,3\n")
    (row,) = csv_tree.read_orderbook(spark, str(tmp_path), columns=columns).collect()
    assert (row.bid_prices, row.bid_sizes, row.ask_prices) == ([1.0, 0.0], [0.0, 0.0], [2.0, 3.0])


def test_no_line_of_a_csv_file_is_lost(spark, tmp_path):
    folder = f"{tmp_path}/ex/spot/A"
    head = "exchange_timestamp,local_diff,price,quantity,direction\n"
    stamp = "1717200000000000"
    write(f"{folder}/trades_1.csv", f"{head}{stamp},1,2,3,1\n,1,2,3,1\nx,1,2,3,1\n\n{stamp},1,n/a,3,1\n{head},,,,\n")
    rows = csv_tree.read_trades(spark, str(tmp_path))
    good, bad = csv_tree.checked(rows, 2024)
    assert (rows.count(), good.count(), sorted(r.reject_reason for r in bad.collect())) == (5, 1, ["bad_value"] * 4)
    names = "exchange_timestamp,bid_price1,ask_price1,ask_size1\n"
    lines = [f"{stamp},1,2,", f"{stamp},n/a,2,3", ",1,2,3", f"{stamp},1", "", f"{stamp},1,nan,3", f"{stamp},1,2,inf", "0,1,2,3"]
    write(f"{folder}/orderbook_1.csv", names + "\n".join(lines) + "\n")
    books = csv_tree.read_orderbook(spark, str(tmp_path))
    good, bad = csv_tree.checked(books, 2024)
    assert sorted((r.bid_prices, r.ask_prices, r.ask_sizes, r.local_diff) for r in good.collect()) == [
        ([1.0], [0.0], [0.0], 0),
        ([1.0], [2.0], [0.0], 0),
    ]
    assert sorted(r.reject_reason for r in bad.collect()) == ["bad_value"] * 4 + ["invalid_time"]


def test_order_books_of_many_depths_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)
    price = F.udf(lambda i: made.add(1) or float(i), "double").asNondeterministic()
    level = lambda i: F.transform(F.sequence(F.lit(1), i), lambda k: k.cast("double"))
    rows = spark.range(1, 25).select(
        (F.lit(1717200000000000) + F.col("id")).alias("exchange_timestamp"), F.lit(1).cast("bigint").alias("local_diff"), F.lit("S").alias("symbol"),
        F.lit("ex").alias("exchange"), F.lit("spot").alias("market_type"), F.to_date(F.lit("2024-06-01")).alias("trade_date"),
        *[level(F.col("id").cast("int")).alias(n) for n in ("bid_sizes", "ask_prices", "ask_sizes")],
        F.concat(F.array(price("id")), F.slice(level(F.col("id").cast("int")), F.lit(2), F.col("id").cast("int"))).alias("bid_prices"),
    )
    sinks.write_csv(rows, str(tmp_path), "orderbook")
    assert made.value == 24
    back = csv_tree.read_orderbook(spark, str(tmp_path), layout="nested")
    assert sorted(len(r.bid_prices) for r in back.collect()) == list(range(1, 25))


def test_bucketed_tables_join_without_a_shuffle(spark):
    found = queries.bucketed_join(spark, "/root/testdata/sf0.001")
    assert found.count() > 0 and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_table_layout(spark, raw, channels, tmp_path):
    records = records_from_raw(raw, channels, 2024)
    root = str(tmp_path)
    assert len(sinks.check_tables(spark, root, ("feed",))) == 3
    for kind, rows in (
        ("trades", records.trades()), ("orderbook", records.orderbook()), ("bookticker", records.bookticker())
    ):
        sinks.write_table(rows, root, kind)
    assert sinks.check_tables(spark, root) == []
    pruned = spark.read.parquet(f"{root}/trades").where("part_date = '2024-06-02'")
    assert [r.trade_id for r in pruned.collect()] == [2]
    with pytest.raises(ValueError):
        sinks.write_parquet(records.trades(), f"{root}/x", granularity="week")
    bounds = [str(r.bound) for r in sinks.partition_bounds(spark, "2024-01-15", "2024-03-01", "month").collect()]
    assert bounds == ["2024-01-01", "2024-02-01", "2024-03-01", "2024-04-01"]


def test_files_are_sorted(spark, tmp_path):
    rows = spark.range(2000).select(
        (F.lit(TS) + F.col("id") * 7919 % 2000).alias("exchange_timestamp"),
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("S"), F.col("id") % 5)).alias("symbol"),
        F.date_from_unix_date(F.lit(19875) + (F.col("id") % 2).cast("int")).alias("trade_date"),
    )
    sinks.write_parquet(rows, str(tmp_path))
    stored = spark.read.parquet(str(tmp_path)).select("*", F.col("_metadata.file_path").alias("f")).toPandas()
    assert len(stored) == 2000
    for _, part in stored.groupby("f", sort=False):
        keys = list(zip(part["symbol"], part["exchange_timestamp"]))
        assert keys == sorted(keys)


def test_backend_falls_back_to_csv(caplog):
    assert sinks.backend("nosuch") is sinks.BACKENDS["csv"] and sinks.backend("") is sinks.BACKENDS["csv"]
    assert "using csv" in caplog.text


def test_topics(spark, raw, channels, tmp_path):
    ticks = records_from_raw(raw, channels, 2024).ticks
    sent = topics.messages(ticks, "TICK")
    assert {(r.topic, r.msg_type) for r in sent.collect()} == {("binance:spot:BTCUSDT:tick", 1), ("binance:spot:MEM:tick", 1)}
    long = ticks.withColumn("topic_prefix", F.repeat(F.lit("x"), 59))
    assert topics.messages(long, "TICK").count() == 4
    topics.write_files(sent, f"{tmp_path}/topics")
    assert topics.read_files(spark, f"{tmp_path}/topics").count() == 4


def two_files(raw, source):
    raw.where("seq < 6").coalesce(1).write.parquet(source)
    raw.where("seq >= 6").coalesce(1).write.mode("append").parquet(source)


def failing(outputs, tables, times, raised=OSError):
    """A writer that fails so often for some tables, and the tries it saw."""
    tries = []

    def primary(batch):
        def write_batch(rows, kind):
            tries.append((batch.batch_id, kind))
            if kind in tables and sum(k == kind for _, k in tries) <= times:
                raise raised("storage went away")
            stream_feed.batch_writer(outputs, batch)(rows, kind)

        return write_batch

    return primary, tries


def test_stream_equals_batch_and_survives_a_failing_sink(spark, raw, channels, tmp_path):
    source, root = f"{tmp_path}/raw", f"{tmp_path}/out"
    two_files(raw, source)
    outputs = stream_feed.Outputs(root)
    flaky, _ = failing(outputs, ("trades",), 1)
    feed = stream_table(spark, "raw_feed", source, max_files=1)
    stream_feed.start(feed, channels, outputs, 2024, interval=None, primary=flaky).awaitTermination()
    batch = records_from_raw(read_table(spark, "raw_feed", source), channels, 2024).persisted()
    kept = stream_feed.read(spark, outputs, "trades")
    waiting = deadletter.waiting(spark, "trades", root)
    assert waiting.count() > 0 and set(waiting.select("storage_target", "recovery_status").distinct().first()) == {0, 1}
    names = [n for n, _ in expected(spark, "trades")]
    merged = deadletter.replayed(kept.select(*names), waiting, ["exchange", "market_type", "symbol", "trade_id"])
    assert sorted(map(tuple, merged.select(*names).collect())) == sorted(map(tuple, batch.trades().collect()))
    assert merged.where("recovery_status = 1").count() == waiting.count()
    assert stream_feed.read(spark, outputs, "orderbook").count() == batch.orderbook().count()
    assert stream_feed.read(spark, outputs, "rejects").count() == 4


def test_order_books_are_tried_again_and_trades_are_not(spark, raw, channels, tmp_path):
    source = f"{tmp_path}/raw"
    raw.coalesce(1).write.parquet(source)
    feed = stream_table(spark, "raw_feed", source)
    for times, left in ((1, {"trades"}), (2, {"trades", "orderbook", "bookticker"})):
        outputs = stream_feed.Outputs(f"{tmp_path}/out{times}")
        flaky, tries = failing(outputs, stream_feed.TABLES.values(), times)
        stream_feed.start(feed, channels, outputs, 2024, interval=None, primary=flaky).awaitTermination()
        assert [k for _, k in tries] == ["trades", "orderbook", "orderbook", "bookticker", "bookticker"]
        facts = {r.kind: r for r in commits.log(spark, outputs.root).collect()}
        assert {k for k, r in facts.items() if r.target == deadletter.FALLBACK} == left
        for kind in left:
            assert deadletter.waiting(spark, kind, outputs.root).count() == facts[kind].stored > 0
        for kind in {"orderbook", "bookticker"} - left:
            assert stream_feed.read(spark, outputs, kind).count() == facts[kind].stored > 0


def test_errors_of_the_code_are_no_failed_writes(spark, raw, channels, tmp_path):
    source = f"{tmp_path}/raw"
    raw.coalesce(1).write.parquet(source)
    outputs = stream_feed.Outputs(f"{tmp_path}/out")
    flaky, tries = failing(outputs, ("trades",), 9, raised=KeyError)
    run = stream_feed.start(stream_table(spark, "raw_feed", source), channels, outputs, 2024, interval=None, primary=flaky)
    with pytest.raises(StreamingQueryException):
        run.awaitTermination()
    assert len(tries) == 1 and commits.log(spark, outputs.root).count() == 0


def test_a_run_that_ends_between_two_writes_shows_each_row_once(spark, raw, channels, tmp_path):
    source, root = f"{tmp_path}/raw", f"{tmp_path}/out"
    two_files(raw, source)
    outputs = stream_feed.Outputs(root)
    feed = stream_table(spark, "raw_feed", source, max_files=1)
    killed, _ = failing(outputs, ("bookticker",), 9, raised=RuntimeError)  # trades and order books of batch 0 stand by then
    with pytest.raises(StreamingQueryException):
        stream_feed.start(feed, channels, outputs, 2024, interval=None, primary=killed).awaitTermination()
    assert spark.read.parquet(f"{root}/trades").count() > 0
    assert all(stream_feed.read(spark, outputs, kind).count() == 0 for kind in ("trades", "orderbook"))
    stream_feed.start(feed, channels, outputs, 2024, interval=None).awaitTermination()
    batch = records_from_raw(read_table(spark, "raw_feed", source), channels, 2024)
    want = {"trades": batch.persisted().trades(), "orderbook": batch.persisted().orderbook(), "bookticker": batch.persisted().bookticker()}
    for kind, rows in want.items():
        names = [n for n, _ in expected(spark, kind)]
        assert sorted(map(str, stream_feed.read(spark, outputs, kind).select(*names).collect())) == sorted(map(str, rows.select(*names).collect()))
    # A batch that was committed, but whose checkpoint was lost, is not written again.
    before = {k: spark.read.parquet(f"{root}/{k}").count() for k in want}
    again = stream_feed.start(feed, channels, outputs, 2024, interval=None, name="again")
    again.awaitTermination()
    os.rename(f"{root}/_checkpoint/commits", f"{root}/_checkpoint/lost")
    stream_feed.start(feed, channels, outputs, 2024, interval=None).awaitTermination()
    assert {k: spark.read.parquet(f"{root}/{k}").count() for k in want} == before


def test_counts_come_from_the_writing_jobs(spark, raw, channels, tmp_path):
    source = f"{tmp_path}/raw"
    two_files(raw, source)
    outputs = stream_feed.Outputs(f"{tmp_path}/out")
    gauges = Gauges()
    spark.streams.addListener(gauges)
    feed = stream_table(spark, "raw_feed", source, max_files=1)
    run = stream_feed.start(feed, channels, outputs, 2024, interval=None, name="counted")
    run.awaitTermination()
    n = raw.count()
    for _ in range(100):
        if sum(b["rows"] for b in gauges.batches["counted"]) == n:
            break
        time.sleep(0.1)
    spark.streams.removeListener(gauges)
    assert sum(b["rows"] for b in gauges.batches["counted"]) == n == sum(b["counted"] for b in gauges.batches["counted"])
    found = commits.outcomes(spark, outputs.root)
    assert found.agg(F.sum("messages")).first()[0] == n
    messages = judged(parse_messages(read_table(spark, "raw_feed", source)), channels, 2024)
    want = {(r.outcome, r.messages) for r in outcomes(messages).groupBy("outcome").agg(F.sum("messages").alias("messages")).collect() if r.outcome != "stored"}
    assert {(r.outcome, r.messages) for r in found.where("kind = 'rejects'").groupBy("outcome").agg(F.sum("messages").alias("messages")).collect()} == want
    latest = {r.kind: r.latency_us for r in commits.log(spark, outputs.root).where("batch_id = 0").collect()}
    first = records_from_raw(read_table(spark, "raw_feed", source).where("seq < 6"), channels, 2024)
    assert latest["trades"] == first.ticks.agg(F.max_by("local_diff", "seq") / 1000.0).first()[0]


def test_compaction_writes_touched_partitions_only(spark, raw, channels, tmp_path):
    outputs, path = stream_feed.Outputs(f"{tmp_path}/out"), f"{tmp_path}/rest"
    trades = records_from_raw(raw, channels, 2024).persisted().trades()
    days = [r.trade_date for r in trades.select("trade_date").distinct().orderBy("trade_date").collect()]
    assert len(days) > 1

    def add(batch_id, rows):
        batch = commits.Batch(outputs.root, batch_id)
        stream_feed.batch_writer(outputs, batch)(rows, "trades")
        commits.commit(spark, batch, [("trades", 0, 1, 1, None, None)])

    def files():
        return {str(f): f.stat().st_mtime_ns for f in tmp_path.glob("rest/part_date=*/**/*.parquet")}

    add(0, trades)
    assert stream_feed.compact(spark, outputs, "trades", path) == [str(d) for d in days]
    before = files()
    late = trades.where(F.col("trade_date") == days[0]).limit(1)
    add(1, late)
    for _ in range(2):  # run again, as after a failure: nothing comes twice
        assert stream_feed.compact(spark, outputs, "trades", path, [1]) == [str(days[0])]
        assert spark.read.parquet(path).count() == trades.count() + 1
    assert {f: t for f, t in files().items() if str(days[0]) not in f} == {f: t for f, t in before.items() if str(days[0]) not in f}
    assert stream_feed.compact(spark, outputs, "trades", path, [7]) == []


def test_stream_books_over_split_batches(spark, tmp_path):
    import time

    events = random_events(3, 80, (0, 1, 2), 30, 0.02, 0.01)
    late = {**events[0], "seq": 1, "channel_id": 0}
    parts = [
        [e for e in events if e["seq"] < 61],
        [e for e in events if 61 <= e["seq"] < 120],
        [e for e in events if e["seq"] >= 120] + [late],
    ]
    source, out = f"{tmp_path}/events", f"{tmp_path}/out"
    for part in parts:
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files of a stream are taken by age
    snapshots = stream_book.stream_snapshots(stream_table(spark, "book_events", source, max_files=1))
    (
        snapshots.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{out}_checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    stored = spark.read.schema(stream_book.OUTPUT).parquet(out)
    assert collected(stored.where("NOT late")) == modelled(events)
    assert [(r.channel_id, r.seq) for r in stored.where("late").collect()] == [(0, 1)]


def test_books_of_many_events_go_out_in_bounded_frames():
    """One channel of 5000 levels and a long micro-batch; state is written for changed levels only."""
    state: dict = {}
    written = []

    class Levels:
        def exists(self):
            return bool(state)

        def iterator(self):
            return iter([(k, (v,)) for k, v in state.items()])

        def updateValue(self, k, v):
            written.append(k)
            state[k] = v[0]

        def removeKey(self, k):
            written.append(k)
            del state[k]

    class Held:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        put = update

        def clear(self):
            self.value = None

    book_state = stream_book.BookProcessor(depth=5)
    book_state.levels, book_state.pending, book_state.place = Levels(), Held(), Held()

    def events(first, n, price):
        return pd.DataFrame(
            {
                "channel_id": 1, "seq": range(first + n - 1, first - 1, -1), "exchange_ts": 7, "recv_us": 8, "kind": "QUOTE", "side": "bid",
                "update_type": "SOLO", "price_flag": True, "size_flag": True, "price": price, "size": 3, "bid_levels": None, "ask_levels": None,
            }
        )

    start = events(0, 5000, [float(p) for p in range(5000)])
    assert sum(len(f) for f in book_state.handleInputRows((1,), iter([start]), None)) == 5000 and len(state) == 5000
    written.clear()
    tracemalloc.start()
    frames = (events(5000 + k * 10_000, 10_000, float(k)) for k in (3, 1, 0, 2))
    sizes = [len(f) for f in book_state.handleInputRows((1,), frames, None)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 40_000 and max(sizes) <= stream_book.FRAME_ROWS and peak < 30_000_000
    assert len(written) == 0 and book_state.place.value == (False, 44_999)  # sizes are as they were
    list(book_state.handleInputRows((1,), iter([events(50_000, 1, 9.5)]), None))
    assert written == [("bid", 9.5)]


@pytest.mark.parametrize("seed", range(3))
def test_ranges_of_ids_in_any_order(seed):
    draw = random.Random(seed)
    ids = draw.sample(range(80), 50)
    begins = ends = np.zeros(0, np.int64)
    for k in range(0, 50, 7):
        begins, ends = ranges_of(np.array(sorted(ids[k : k + 7]), np.int64), begins, ends)
        seen = sorted(ids[: k + 7])
        gaps = [(a, b) for a, b in zip(seen, seen[1:]) if b > a + 1]
        assert list(zip(ends[:-1].tolist(), begins[1:].tolist())) == gaps


def test_snapshots_reach_the_table(spark, channels):
    events = random_events(5, 20, (2260885141,), 10, 0.1, 0.0)
    snapshots = book.snapshots(frame(spark, events))
    rows = tables.to_orderbook(enrich.registered(book.depth_records(snapshots), channels))
    assert ddl(rows) == expected(spark, "orderbook")
    assert rows.count() == snapshots.count() > 0
    assert {len(r.bid_prices) for r in rows.collect()} == {20}


@pytest.mark.parametrize("part", [4, stream_book.PART_LEVELS])
def test_channels_of_a_group_share_calls_and_write_what_they_changed(monkeypatch, part):
    """One key holds many channels; a channel costs two reads and two writes a micro-batch if its book is small."""
    monkeypatch.setattr(stream_book, "PART_LEVELS", part)
    calls = []

    class Kept(dict):
        def getValue(self, k):
            calls.append(("read", k))
            return self.get(k)

        def updateValue(self, k, v):
            calls.append(("write", k))
            self[k] = v

    books = stream_book.GroupProcessor(None)
    books.heads, books.parts, shown = Kept(), Kept(), {}
    events = random_events(4, 60, (1, 2, 3), 40, 0.02, 0.01)
    columns = stream_book.EVENT_COLUMNS
    for k in range(4):
        own = [e for e in events if k * 30 <= e["seq"] < k * 30 + 30 + (k == 3) * 100]
        random.Random(k).shuffle(own)
        calls.clear()
        found = pd.DataFrame([tuple(e[c] for c in columns) for e in own], columns=columns)
        for out in books.handleInputRows((0,), iter([found[:20], found[20:]]), None):
            assert not out["late"].any()
            for r in out.itertuples():
                shown[(r.channel_id, r.seq)] = (r.exchange_timestamp, list(zip(r.bid_prices, r.bid_sizes)), list(zip(r.ask_prices, r.ask_sizes)))
        assert part == 4 or len(calls) <= 12
    assert shown == modelled(events)
    assert (len(books.parts) > 3) == (part == 4)
    one = pd.DataFrame([tuple({**events[0], "channel_id": 2, "seq": 10**6, "kind": "QUOTE", "update_type": "SOLO", "price": 7.0, "price_flag": True, "size": 99, "size_flag": True}[c] for c in columns)], columns=columns)
    calls.clear()
    list(books.handleInputRows((0,), iter([one]), None))
    assert len([k for kind, k in calls if kind == "write"]) == 2 and all(k[0] == 2 for _, k in calls)
