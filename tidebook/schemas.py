"""Table schemas, as DDL strings usable by ``spark.read.schema`` and ``readStream``."""

# Fixed value: the stored depth of a channel whose configuration names none.
DEFAULT_DEPTH_LEVEL = 5
MARKET_TYPES = ("spot", "perpetual", "futures")

TRADES = (
    "exchange_timestamp BIGINT, local_diff BIGINT, trade_id BIGINT, price DOUBLE, quantity DOUBLE, "
    "direction INT, is_buyer_maker BOOLEAN, symbol STRING, exchange STRING, market_type STRING, trade_date DATE"
)
ORDERBOOK = (
    "exchange_timestamp BIGINT, local_diff BIGINT, symbol STRING, exchange STRING, market_type STRING, "
    "trade_date DATE, bid_prices ARRAY<DOUBLE>, bid_sizes ARRAY<DOUBLE>, ask_prices ARRAY<DOUBLE>, "
    "ask_sizes ARRAY<DOUBLE>"
)
BOOKTICKER = (
    "exchange_timestamp BIGINT, local_diff BIGINT, best_bid_price DOUBLE, best_bid_qty DOUBLE, "
    "best_ask_price DOUBLE, best_ask_qty DOUBLE, symbol STRING, exchange STRING, market_type STRING, "
    "trade_date DATE"
)
TABLES = {"trades": TRADES, "orderbook": ORDERBOOK, "bookticker": BOOKTICKER}

CHANNELS = (
    "channel_id BIGINT, exchange STRING, market_type STRING, symbol STRING, depth_level INT, "
    "enabled BOOLEAN, record_tick BOOLEAN, persist_to_disk BOOLEAN, topic_prefix STRING"
)
RAW_FEED = (
    "channel_id BIGINT, exchange STRING, market_type STRING, symbol STRING, seq BIGINT, "
    "recv_us BIGINT, recv_ns BIGINT, dispatch_ns BIGINT, payload STRING"
)
_SIDE = "ARRAY<STRUCT<price:DOUBLE,size:BIGINT>>"
BOOK_EVENTS = (
    "channel_id BIGINT, seq BIGINT, exchange_ts BIGINT, recv_us BIGINT, kind STRING, side STRING, "
    "update_type STRING, price_flag BOOLEAN, size_flag BOOLEAN, price DOUBLE, size BIGINT, "
    f"bid_levels {_SIDE}, ask_levels {_SIDE}"
)
FUTURES_TRADES = (
    "exchange STRING, ticker STRING, ssboe INT, usecs INT, price DOUBLE, size BIGINT, "
    "aggressor_side STRING, recv_us BIGINT"
)
FUTURES_BBO = (
    "exchange STRING, ticker STRING, ssboe INT, usecs INT, bid_price DOUBLE, bid_size BIGINT, "
    "ask_price DOUBLE, ask_size BIGINT, bid_price_flag BOOLEAN, bid_size_flag BOOLEAN, "
    "ask_price_flag BOOLEAN, ask_size_flag BOOLEAN, recv_us BIGINT"
)
CONFIG = (
    "global_persist BOOLEAN, exchanges ARRAY<STRUCT<name:STRING, enabled:BOOLEAN, channels:ARRAY<STRUCT<type:STRING, "
    "symbols:ARRAY<STRUCT<name:STRING, enabled:BOOLEAN, depth_level:INT, record_tick:BOOLEAN, "
    "persist_to_disk:BOOLEAN>>>>>>"
)
SNAPSHOTS = (
    "channel_id BIGINT, seq BIGINT, exchange_timestamp BIGINT, recv_us BIGINT, last_update_id BIGINT, "
    "bid_prices ARRAY<DOUBLE>, bid_sizes ARRAY<DOUBLE>, ask_prices ARRAY<DOUBLE>, ask_sizes ARRAY<DOUBLE>"
)
