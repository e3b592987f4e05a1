import pytest

from tidebook import schemas
from tidebook.feeds import FEEDS, gateio
from tidebook.operators import parse

RECV_US = 1_700_000_000_000_000


def parsed(spark, exchange, market, *payloads, **options):
    rows = [(1, exchange, market, "S", i, RECV_US, 10, 25, p) for i, p in enumerate(payloads)]
    return parse.parse_messages(spark.createDataFrame(rows, schemas.RAW_FEED), **options)


def tick(row):
    t = row.tick
    return t and (t.exchange_timestamp, t.trade_id, t.price, t.quantity, t.is_buyer_maker)


SPOT_TRADE = '{"e":"aggTrade","E":1690000000000001,"s":"AAAUSD","a":71,"p":"12.25","q":"3.5","m":true}'
PERP_TRADE = '{"e":"aggTrade","E":1690000000007,"s":"AAAUSD","a":72,"p":"12.5","q":"0.25","m":true}'
GATE_TRADE = (
    '{"time":1,"channel":"futures.trades","event":"update","result":[{"id":31,"create_time_ms":1690000000011,'
    '"price":"8.75","size":-6,"contract":"AAA_USD"}%s]}'
)
GATE_SPOT_TRADE = (
    '{"time":1,"channel":"spot.trades","event":"%s","result":{"id":5,"create_time":1,'
    '"create_time_ms":"1690000000013.25","side":"sell","amount":"-2.5","price":"0.125"}}'
)


def test_trades(spark):
    (a,) = parsed(spark, "binance", "spot", SPOT_TRADE).collect()
    assert tick(a) == (1690000000000001, 71, 12.25, 3.5, True)
    (b,) = parsed(spark, "binance", "perpetual", PERP_TRADE).collect()
    assert tick(b) == (1690000000007000, 72, 12.5, 0.25, True)
    (c,) = parsed(spark, "gateio", "perpetual", GATE_TRADE % "").collect()
    assert tick(c) == (1690000000011000, 31, 8.75, 6.0, True)
    d, e = parsed(spark, "gateio", "spot", GATE_SPOT_TRADE % "update", GATE_SPOT_TRADE % "subscribe").collect()
    assert tick(d) == (1690000000013250, 5, 0.125, 2.5, True)
    assert tick(e) is None and e.reject_reason == "parse"


def test_plain_trade_uses_its_own_id(spark):
    text = '{"e":"trade","E":5,"t":77,"a":1,"p":"2","q":"3","m":false}'
    a, b = parsed(spark, "binance", "spot", text, text.replace('"t":77,', "")).collect()
    assert tick(a) == (5, 77, 2.0, 3.0, False)
    assert b.reject_reason == "parse"


def test_several_trades_in_one_message(spark):
    second = ',{"id":2,"create_time_ms":1690000000012,"price":"97","size":3}'
    text = GATE_TRADE % second
    assert [r.tick.trade_id for r in parsed(spark, "gateio", "perpetual", text).collect()] == [31, 2]
    first = (*FEEDS[:3], gateio.PERPETUAL_FIRST_TRADE)
    assert [r.tick.trade_id for r in parsed(spark, "gateio", "perpetual", text, feeds=first).collect()] == [31]
    empty = '{"channel":"futures.trades","event":"update","result":[]}'
    assert parsed(spark, "gateio", "perpetual", empty).first().reject_reason == "parse"


def test_tickers(spark):
    typed = '{"e":"bookTicker","u":7,"s":"AAAUSD","b":"4.5","B":"2","a":"4.75","A":"3.25","E":1690000000000}'
    bare = '{"u":8,"s":"AAAUSD","b":"5.5","B":"1","a":"5.75","A":"2"}'
    a, b = parsed(spark, "binance", "spot", typed, bare).collect()
    assert tuple(a.ticker) == (RECV_US, 4.5, 2.0, 4.75, 3.25)
    assert tuple(b.ticker) == (RECV_US, 5.5, 1.0, 5.75, 2.0)
    gate = (
        '{"time":1,"channel":"futures.book_ticker","event":"update","result":{"t":1690000000021,"u":9,"s":"AAA_USD",'
        '"b":"6.5","B":40,"a":"6.75","A":50}}'
    )
    (c,) = parsed(spark, "gateio", "perpetual", gate).collect()
    assert tuple(c.ticker) == (1690000000021000, 6.5, 40.0, 6.75, 50.0)


def test_depth(spark):
    partial = '{"lastUpdateId":16,"bids":[["9.5","1.5",[]],["9.25","0.5",[]]],"asks":[["9.75","2",[]]]}'
    (a,) = parsed(spark, "binance", "spot", partial).collect()
    assert (a.depth.exchange_timestamp, a.depth.last_update_id) == (RECV_US, 16)
    assert [tuple(x) for x in a.depth.bids] == [(9.5, 1.5), (9.25, 0.5)]
    update = '{"e":"depthUpdate","E":1690000000031,"s":"AAAUSD","U":3,"u":4,"b":[["9.5","1"]],"a":[["9.75","2"]]}'
    (b,) = parsed(spark, "binance", "perpetual", update).collect()
    assert (b.depth.exchange_timestamp, b.depth.last_update_id) == (1690000000031000, 4)
    gate = (
        '{"time":1,"channel":"futures.order_book","event":"all","result":{"t":1690000000041,"id":55,"contract":"AAA_USD",'
        '"asks":[{"p":"7.5","s":12}],"bids":[{"p":"7","s":29},{"p":"6.5","s":14}]}}'
    )
    (c,) = parsed(spark, "gateio", "perpetual", gate).collect()
    assert (c.depth.exchange_timestamp, c.depth.last_update_id) == (1690000000041000, 55)
    assert [tuple(x) for x in c.depth.bids] == [(7.0, 29.0), (6.5, 14.0)]


@pytest.mark.parametrize(
    "exchange, market, payload, kind, reason",
    [
        ("binance", "spot", '{"result":null,"id":1}', "BOOK_TICKER", "parse"),
        ("binance", "spot", '{"e":123}', "UNKNOWN", "unknown_event"),
        ("binance", "spot", '{"e":null}', "UNKNOWN", "unknown_event"),
        ("binance", "spot", '{"e":"kline"}', "UNKNOWN", "unknown_event"),
        ("binance", "spot", '{"e":', None, "malformed"),
        ("binance", "spot", "", None, "empty"),
        ("binance", "spot", None, None, "empty"),
        ("binance", "futures", SPOT_TRADE, None, "no_feed"),
        ("gateio", "spot", '{"channel":"futures.trades","event":"update"}', "UNKNOWN", "unknown_event"),
        ("gateio", "spot", '{"channel":"spot.trades","event":"update"}', "TICK", "parse"),
        ("binance", "spot", SPOT_TRADE.replace('"12.25"', "12.25"), "TICK", "parse"),
        ("binance", "spot", SPOT_TRADE.replace('"p":"12.25"', '"p":" 5"'), "TICK", "parse"),
    ],
)
def test_rejects(spark, exchange, market, payload, kind, reason):
    (row,) = parsed(spark, exchange, market, payload).collect()
    assert (row.kind, row.reject_reason) == (kind, reason)


def test_latency_and_single_parse(spark):
    messages = parsed(spark, "binance", "spot", SPOT_TRADE)
    records = parse.tick_records(messages)
    assert records.first().local_diff == 15
    plan = records.where("price > 1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
