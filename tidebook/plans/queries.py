"""Named queries over the given tables. Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook import schemas
from tidebook.feeds import Feed, binance, futures, gateio
from tidebook.functions import identity, numbers, timeparts
from tidebook.functions.taken import level_sums
from tidebook.operators import book, enrich, parse, tables, telemetry
from tidebook.plans import adapter
from tidebook.plans.records import futures_records, judged, outcomes, records_from_raw, union_records
from tidebook.session import scratch, small_batches
from tidebook.sinks import deadletter, topics
from tidebook.sinks import tables as table_sinks
from tidebook.sources import csv_tree, registry
from tidebook.sources.messages import stream_table
from tidebook.streaming import book as stream_book
from tidebook.streaming import commits
from tidebook.streaming import feed as stream_feed
from tidebook.streaming import gaps as stream_gap_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The year against which times are checked: the given events lie in 2024.
AS_OF_YEAR = 2024
SPOT_FEED = (binance.SPOT,)


def query(make: Query) -> Query:
    QUERIES[make.__name__] = make
    return make


def _named_query(name: str, make: Query) -> None:
    QUERIES[name] = make


# --- feeds --------------------------------------------------------------------------------------------

TRADE_PAYLOADS: dict[str, tuple[Feed, Callable[[], Column]]] = {
    "binance_spot_trades": (binance.SPOT, lambda: adapter.binance_trade(F.col("us"))),
    "binance_perp_trades": (binance.PERPETUAL, lambda: adapter.binance_trade(adapter.ms())),
    "gateio_spot_trades": (gateio.SPOT, adapter.gateio_spot_trade),
    "gateio_perp_trades": (gateio.PERPETUAL, lambda: adapter.gateio_perpetual_trades(F.lit(2))),
    "gateio_perp_first_trades": (
        gateio.PERPETUAL_FIRST_TRADE,
        lambda: adapter.gateio_perpetual_trades(F.lit(2)),
    ),
}
DEPTH_PAYLOADS: dict[str, tuple[Feed, Callable[[], Column]]] = {
    "binance_spot_depth_levels": (binance.SPOT, adapter.binance_spot_depth),
    "binance_perp_depth_levels": (binance.PERPETUAL, adapter.binance_perpetual_depth),
    "gateio_spot_depth_levels": (gateio.SPOT, adapter.gateio_spot_depth),
    "gateio_perp_depth_levels": (gateio.PERPETUAL, adapter.gateio_perpetual_depth),
}


def _of_feed(spark: SparkSession, sf_dir: str, feed: Feed, payload: Column) -> DataFrame:
    return adapter.raw_feed(adapter.ticks(spark, sf_dir), feed.exchange, feed.market_type, payload)


def _trades(feed: Feed, payload: Callable[[], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = _of_feed(spark, sf_dir, feed, payload())
        parsed = parse.parse_messages(raw, [feed], kinds=("TICK",))
        return parse.tick_records(parsed).select(
            "seq",
            "symbol",
            "exchange_timestamp",
            "trade_id",
            "price",
            "quantity",
            identity.direction(F.col("is_buyer_maker")).alias("direction"),
            "local_diff",
        )

    return run


def _depth(feed: Feed, payload: Callable[[], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = _of_feed(spark, sf_dir, feed, payload())
        records = parse.depth_records(parse.parse_messages(raw, [feed], kinds=("DEPTH",)))
        sides = F.create_map(F.lit("bid"), F.col("bids"), F.lit("ask"), F.col("asks"))
        keys = ("seq", "exchange_timestamp", "last_update_id")
        return (
            records.select(*keys, F.explode(sides).alias("side", "levels"))
            .select(*keys, "side", F.posexplode("levels").alias("pos", "l"))
            .select(
                *keys,
                "side",
                (F.col("pos") + 1).alias("level"),
                F.col("l.price").alias("price"),
                F.col("l.quantity").alias("quantity"),
            )
        )

    return run


for _name, _spec in TRADE_PAYLOADS.items():
    _named_query(_name, _trades(*_spec))
for _name, _spec in DEPTH_PAYLOADS.items():
    _named_query(_name, _depth(*_spec))


@query
def book_ticker_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapter.ticks(spark, sf_dir)
    feeds = (
        ("binance", "spot", adapter.binance_ticker("")),
        ("binance", "perpetual", adapter.binance_ticker(adapter.perpetual_envelope())),
        ("gateio", "spot", adapter.gateio_ticker("spot", quoted=True)),
        ("gateio", "perpetual", adapter.gateio_ticker("futures", quoted=False)),
    )
    columns = (
        "exchange", "market_type", "symbol", "exchange_timestamp", "best_bid_price", "best_bid_qty",
        "best_ask_price", "best_ask_qty",
    )
    raw = union_records(*[adapter.raw_feed(events, *f) for f in feeds])
    crypto = parse.ticker_records(parse.parse_messages(raw, kinds=("BOOK_TICKER",))).select(*columns)
    contracts = adapter.channels(spark, sf_dir, "COMEX", "futures")
    bbo = futures.normalise_bbo(adapter.futures_bbo(events), contracts).select(*columns)
    return union_records(crypto, bbo)


@query
def futures_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    contracts = adapter.channels(spark, sf_dir, "COMEX", "futures")
    prints = adapter.futures_trades(adapter.ticks(spark, sf_dir))
    return futures.normalise_trades(prints, contracts).select(
        "exchange", "symbol", "exchange_timestamp", "trade_id", "price", "quantity", "is_buyer_maker"
    )


@query
def futures_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    contracts = adapter.channels(spark, sf_dir, "COMEX", "futures")
    prints = adapter.futures_trades(adapter.ticks(spark, sf_dir))
    lost = futures.unmapped(prints, contracts).withColumn("symbol", identity.trimmed(F.col("ticker")))
    return lost.groupBy("symbol").agg(F.count(F.lit(1)).alias("dropped"))


@query
def classify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse.parse_messages(adapter.mixed_feed(adapter.ticks(spark, sf_dir)), kinds=())
    named = parsed.withColumn("kind", F.coalesce("kind", F.lit("NONE")))
    return named.groupBy("exchange", "market_type", "kind").agg(F.count(F.lit(1)).alias("n"))


@query
def reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse.parse_messages(adapter.mixed_feed(adapter.ticks(spark, sf_dir)))
    totals = telemetry.drop_totals(parse.rejects(parsed))
    return totals.withColumn("reject_reason", F.coalesce("reject_reason", F.lit("total")))


@query
def number_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value").cast("string")
    shown = (
        F.when(adapter.is_type("signup"), F.concat(value, F.lit("xyz")))
        .when(adapter.is_type("purchase"), F.concat(F.lit(" "), value))
        .when(adapter.is_type("view"), F.concat(F.lit("+"), value))
        .when(adapter.is_type("click"), F.concat(F.lit("-"), value, F.lit("e1")))
        .otherwise(F.concat(F.col("k").cast("string"), F.lit(".")))
    )
    events = adapter.ticks(spark, sf_dir).withColumn("shown", shown)
    return events.select("event_id", "shown", numbers.decimal_prefix(F.col("shown")).alias("number"))


# --- registry and joins -------------------------------------------------------------------------------


@query
def channel_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.channels(spark, sf_dir, "binance", "spot").select("channel_id", "topic_prefix")


@query
def channel_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = adapter.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("channel_id"), F.col("c_mktsegment").alias("topic_prefix")
    )
    return registry.collisions(claims)


def _part_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested configuration row per part; some defaults are left out."""
    size = F.col("p_size")
    symbol = F.struct(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"),
        F.when(size % 5 == 0, False).cast("boolean").alias("enabled"),
        F.when(size % 2 == 0, size * 3).cast("int").alias("depth_level"),
        F.when(size % 3 == 0, False).cast("boolean").alias("record_tick"),
        F.lit(None).cast("boolean").alias("persist_to_disk"),
    )
    market = F.when(size % 4 == 0, "options").otherwise("spot")
    channel = F.struct(market.alias("type"), F.array(symbol).alias("symbols"))
    exchange = F.struct(
        F.col("p_brand").alias("name"),
        F.when(size % 7 != 0, True).alias("enabled"),
        F.array(channel).alias("channels"),
    )
    return adapter.table(spark, sf_dir, "part").select(
        (size != 1).alias("global_persist"), F.array(exchange).alias("exchanges")
    )


@query
def registry_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.channels_from_config(_part_config(spark, sf_dir)).drop("channel_id")


@query
def registry_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.violations(registry.channels_from_config(_part_config(spark, sf_dir)))


def _spot_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parsed spot trades with registry ids, and the registry."""
    channels = adapter.channels(spark, sf_dir, "binance", "spot")
    events = adapter.ticks(spark, sf_dir)
    raw = adapter.raw_feed(events, "binance", "spot", adapter.binance_trade(F.col("us")))
    return adapter.stamped(raw, channels), channels


@query
def trade_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON to trades, rolled up per symbol and day."""
    raw, channels = _spot_records(spark, sf_dir)
    trades = records_from_raw(raw, channels, AS_OF_YEAR, SPOT_FEED, ("TICK",)).trades()
    return daily(trades)


@query
def records_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every message; the counts add up to the input."""
    raw, channels = _spot_records(spark, sf_dir)
    messages = judged(parse.parse_messages(raw, SPOT_FEED, ("TICK",)), channels, AS_OF_YEAR, ("TICK",))
    return outcomes(messages)


@query
def futures_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Futures trades on the path to the trades table, rolled up."""
    channels = adapter.channels(spark, sf_dir, "COMEX", "futures")
    events = adapter.ticks(spark, sf_dir)
    records = futures_records(adapter.futures_trades(events), adapter.futures_bbo(events), channels, AS_OF_YEAR)
    return daily(records.trades())


@query
def csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade and order-book files with unreadable numbers, zero and empty times: rows per outcome of the checked import."""
    path = scratch(spark, "csv")
    kind = F.col("event_type")
    events = adapter.ticks(spark, sf_dir)
    stamp = F.when(kind == "view", F.lit(0)).when(kind != "signup", F.col("us")).alias("exchange_timestamp")
    rows = events.select(
        stamp,
        F.lit(1).alias("local_diff"),
        F.when(kind == "error", "n/a").otherwise(F.col("value").cast("string")).alias("price"),
        F.col("k").alias("quantity"),
        F.lit(1).alias("direction"),
        F.lit("binance").alias("exchange"),
        F.lit("spot").alias("market_type"),
        F.upper(kind).alias("symbol"),
    )
    keys = ("exchange", "market_type", "symbol")
    books = events.select(
        F.lit(1).alias("bid_price1"),
        F.when(kind == "error", "n/a").otherwise(F.col("value").cast("string")).alias("ask_price1"),
        F.when(kind == "click", F.col("k")).alias("ask_size2"),
        stamp,
        *[F.lit(v).alias(n) for n, v in zip(keys, ("binance", "spot"))],
        F.upper(kind).alias("symbol"),
    ).select("exchange_timestamp", "bid_price1", "ask_size2", "ask_price1", *keys)
    out = None
    for table, written, reader in (("trades", rows, csv_tree.read_trades), ("orderbook", books, csv_tree.read_orderbook)):
        written.write.partitionBy(*keys).option("header", True).csv(f"{path}/{table}")
        good, bad = csv_tree.checked(reader(spark, path, layout="nested"), AS_OF_YEAR)
        both = good.withColumn("reject_reason", F.lit("stored")).unionByName(bad)
        one = both.groupBy("symbol", "reject_reason").agg(F.count(F.lit(1)).alias("rows")).withColumn("kind", F.lit(table))
        out = one if out is None else out.unionByName(one)
    return out


def daily(trades: DataFrame) -> DataFrame:
    return trades.groupBy("symbol", "trade_date").agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum("quantity").alias("total_quantity"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.sum(F.when(F.col("direction") == -1, 1).otherwise(0)).alias("maker_trades"),
    )


@query
def enrich_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, channels = _spot_records(spark, sf_dir)
    ticks = parse.tick_records(parse.parse_messages(raw, SPOT_FEED, kinds=("TICK",)))
    return enrich.registered(ticks, channels).select(
        "seq", "exchange", "market_type", "symbol", "depth_level", "record_tick", "persist_to_disk", "price"
    )


@query
def enrich_left_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, channels = _spot_records(spark, sf_dir)
    ticks = parse.tick_records(parse.parse_messages(raw, SPOT_FEED, kinds=("TICK",)))
    return enrich.with_defaults(ticks, channels).select(
        "seq", "exchange", "market_type", "symbol", "depth_level", "quantity"
    )


@query
def unknown_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, channels = _spot_records(spark, sf_dir)
    ticks = parse.tick_records(parse.parse_messages(raw, SPOT_FEED, kinds=("TICK",)))
    lost = enrich.unregistered(ticks, channels)
    return lost.groupBy("symbol").agg(F.count(F.lit(1)).alias("dropped"))


@query
def persisted_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, channels = _spot_records(spark, sf_dir)
    trades = records_from_raw(raw, channels, AS_OF_YEAR, SPOT_FEED, ("TICK",)).trades()
    kept = enrich.of_persisted_channels(trades, channels)
    return kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"))


@query
def valid_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = 365 * timeparts.US_PER_DAY
    shifted = (
        F.when(adapter.is_type("signup"), F.lit(0).cast("bigint"))
        .when(adapter.is_type("view"), F.col("us") + F.lit(80 * year))
        .when(adapter.is_type("click"), F.col("us") + F.lit(5 * year) - F.lit(15 * timeparts.US_PER_DAY))
        .when(adapter.is_type("error"), F.col("us") - F.lit(25 * year))
        .otherwise(F.col("us"))
    )
    moved = adapter.ticks(spark, sf_dir).withColumn("t", shifted)
    return moved.select(
        "event_id",
        "t",
        timeparts.day_number(F.col("t")).alias("day_number"),
        timeparts.is_valid_us(F.col("t"), AS_OF_YEAR).alias("valid"),
        timeparts.date_text(F.col("t")).alias("date_text"),
    )


@query
def deep_book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with more than a hundred levels a side, read whole."""
    small_batches(spark)
    bids, asks = F.col("k") + 101, F.col("k") * 2 + 101
    raw = _of_feed(spark, sf_dir, binance.PERPETUAL, adapter.binance_perpetual_depth(bids, asks))
    depths = parse.depth_records(parse.parse_messages(raw, [binance.PERPETUAL], kinds=("DEPTH",)))
    sums = depths.select("seq", *[level_sums(F.col(side)).alias(side) for side in ("bids", "asks")])
    return sums.select(
        "seq",
        *[F.col(f"{side}.levels").alias(side) for side in ("bids", "asks")],
        *[F.col(f"{side}.quantity").alias(f"{side[:3]}_quantity") for side in ("bids", "asks")],
        *[F.col(f"{side}.price").alias(f"{side[:3]}_prices") for side in ("bids", "asks")],
    )


# --- depth shapes -------------------------------------------------------------------------------------


def _orderbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = adapter.channels(spark, sf_dir, "binance", "perpetual")
    events = adapter.ticks(spark, sf_dir)
    raw = adapter.raw_feed(events, "binance", "perpetual", adapter.binance_perpetual_depth())
    depths = parse.depth_records(parse.parse_messages(adapter.stamped(raw, channels), [binance.PERPETUAL], kinds=("DEPTH",)))
    return tables.to_orderbook(enrich.registered(depths, channels), keep_update_id=True)


_LEVEL_COLUMNS = ("last_update_id", "symbol", "level", "bid_price", "bid_size", "ask_price", "ask_size")


@query
def depth_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.to_long(_orderbook(spark, sf_dir)).select(*_LEVEL_COLUMNS)


@query
def book_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = tables.to_wide(_orderbook(spark, sf_dir), 3)
    return wide.drop("local_diff", "exchange", "market_type", "trade_date")


@query
def book_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.to_long(tables.from_wide(tables.to_wide(_orderbook(spark, sf_dir), 3))).select(*_LEVEL_COLUMNS)


# --- order books --------------------------------------------------------------------------------------


def _book_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.book_events(adapter.ticks(spark, sf_dir))


@query
def book_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.book_asof(_book_events(spark, sf_dir))


@query
def book_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.ranked(book.book_asof(_book_events(spark, sf_dir)), 3)


@query
def batch_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = book.batched_levels(book.batch_markers(_book_events(spark, sf_dir)))
    return kept.groupBy("channel_id", "eff_seq").agg(
        F.count(F.lit(1)).alias("levels"),
        F.sum(F.when(F.col("side") == "bid", 1).otherwise(0)).alias("bids"),
        F.sum("qty").alias("quantity"),
    )


@query
def book_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.book_intervals(_book_events(spark, sf_dir))


@query
def book_at_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every channel's book at the moments of its events of type error."""
    moments = adapter.ticks(spark, sf_dir).where(adapter.is_type("error"))
    asked = moments.select(F.col("user_id").alias("channel_id"), F.col("event_id").alias("at"))
    return book.book_at(book.book_intervals(_book_events(spark, sf_dir)), asked)


def _levels_of(snapshots: DataFrame) -> DataFrame:
    out = None
    for side in ("bid", "ask"):
        zipped = F.arrays_zip(F.col(f"{side}_prices").alias("p"), F.col(f"{side}_sizes").alias("q"))
        one = snapshots.select("channel_id", F.lit(side).alias("side"), F.inline(zipped).alias("price", "qty"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def book_final_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels_of(book.snapshots(_book_events(spark, sf_dir), last_only=True))


@query
def book_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = book.snapshots(_book_events(spark, sf_dir))
    return snapshots.select(
        "channel_id",
        "seq",
        "exchange_timestamp",
        F.size("bid_prices").cast("bigint").alias("bids"),
        F.size("ask_prices").cast("bigint").alias("asks"),
        F.get("bid_prices", F.lit(0)).alias("best_bid"),
        F.get("ask_prices", F.lit(0)).alias("best_ask"),
        F.aggregate("bid_sizes", F.lit(0.0), lambda a, x: a + x).alias("bid_quantity"),
        F.aggregate("ask_sizes", F.lit(0.0), lambda a, x: a + x).alias("ask_quantity"),
    )


@query
def stream_book_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of a stream of three micro-batches, each as large as the files that one takes."""
    source, out = scratch(spark, "book_events"), scratch(spark, "snapshots")
    events, files = _book_events(spark, sf_dir), 4
    cuts = events.select(F.percentile_approx("seq", [1 / 3, 2 / 3])).first()[0] or [0, 0]
    part = F.when(F.col("seq") <= cuts[0], 0).when(F.col("seq") <= cuts[1], 1).otherwise(2)
    for k in range(3):  # one after the other, as a stream takes files by age
        events.where(part == k).repartition(files).write.mode("append").parquet(source)
    snapshots = stream_book.stream_snapshots(stream_table(spark, "book_events", source, max_files=files))
    run = (
        snapshots.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    stored = spark.read.schema(stream_book.OUTPUT).parquet(out).where("NOT late")
    newest = stored.groupBy("channel_id").agg(
        F.max_by(F.struct("bid_prices", "bid_sizes", "ask_prices", "ask_sizes"), "seq").alias("s")
    )
    return _levels_of(newest.select("channel_id", "s.*"))


# --- sinks and round trips ----------------------------------------------------------------------------


def _trades_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade rows with one symbol per event type: few channels, many rows each."""
    events = adapter.ticks(spark, sf_dir).withColumn("symbol", F.upper("event_type"))
    raw = adapter.raw_feed(events, "binance", "spot", adapter.binance_trade(F.col("us")))
    ticks = parse.tick_records(parse.parse_messages(raw, SPOT_FEED, kinds=("TICK",)))
    return tables.to_trades(ticks)


@query
def partition_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "layout")
    table_sinks.write_parquet(_trades_by_type(spark, sf_dir), path, granularity="month")
    return (
        spark.read.parquet(path)
        .groupBy("part_date")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct("symbol").alias("symbols"),
            (F.count_distinct("symbol_bucket") <= F.count_distinct("symbol")).alias("bucket_per_symbol"),
        )
    )


@query
def partition_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = adapter.ticks(spark, sf_dir).select(timeparts.trade_date(F.col("us")).alias("d"))
    first, last = dates.agg(F.min("d").cast("string"), F.max("d").cast("string")).first()
    out = None
    for granularity in table_sinks.GRANULARITIES:
        one = table_sinks.partition_bounds(spark, first, last, granularity)
        one = one.select(F.lit(granularity).alias("granularity"), "bound")
        out = one if out is None else out.unionByName(one)
    return out


@query
def csv_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    table_sinks.write_csv(_trades_by_type(spark, sf_dir), path, "trades")
    return csv_tree.read_trades(spark, path, layout="nested")


@query
def csv_bookticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    events = adapter.ticks(spark, sf_dir).withColumn("symbol", F.upper("event_type"))
    raw = adapter.raw_feed(events, "gateio", "spot", adapter.gateio_ticker("spot", quoted=True))
    quotes = parse.ticker_records(parse.parse_messages(raw, [gateio.SPOT], kinds=("BOOK_TICKER",)))
    table_sinks.write_csv(tables.to_bookticker(quotes), path, "bookticker")
    return csv_tree.read_bookticker(spark, path, layout="nested")


@query
def csv_orderbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    events = adapter.ticks(spark, sf_dir).withColumn("symbol", F.upper("event_type"))
    raw = adapter.raw_feed(events, "binance", "perpetual", adapter.binance_perpetual_depth())
    depths = parse.depth_records(parse.parse_messages(raw, [binance.PERPETUAL], kinds=("DEPTH",)))
    depth = F.when(F.col("symbol") == "ERROR", 2).otherwise(3)
    shaped = tables.to_orderbook(depths.withColumn("depth_level", depth))
    table_sinks.write_csv(shaped.where("symbol <> 'VIEW'"), path, "orderbook")
    wide = tables.to_wide(shaped.where("symbol = 'VIEW'"), 3)  # files with their columns in another order
    keys = [c for c in wide.columns if c in table_sinks.CSV_KEYS]
    cells = sorted(c for c in wide.columns if c not in keys and c != "exchange_timestamp")
    own = wide.select("exchange_timestamp", *cells, *keys).write.mode("append").partitionBy(*table_sinks.CSV_KEYS)
    own.option("header", True).csv(f"{path}/orderbook")
    return tables.to_long(csv_tree.read_orderbook(spark, path, layout="nested"))


@query
def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    table_sinks.write_csv(_trades_by_type(spark, sf_dir), path, "trades")
    report = csv_tree.load_report(csv_tree.read_trades(spark, path, layout="nested", keep_path=True))
    symbol = csv_tree.path_keys(F.col("file_path"), "trades")["symbol"]
    named = report.withColumn("symbol", F.when(F.col("file_path").isNull(), "total").otherwise(symbol))
    return named.groupBy("symbol").agg(F.sum("rows").alias("rows"))


@query
def topics_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of all kinds per topic; for events of type error the topic is long."""
    events = adapter.ticks(spark, sf_dir)
    types = events.select(F.col("event_id").alias("seq"), "event_type")
    prefix = identity.channel_key(
        F.when(F.col("event_type") == "error", F.repeat(F.lit("x"), 46)).otherwise(F.col("exchange")),
        F.col("market_type"),
        F.col("symbol"),
    )
    made = {
        "TICK": (binance.SPOT, adapter.binance_trade(F.col("us")), parse.tick_records),
        "DEPTH": (binance.PERPETUAL, adapter.binance_perpetual_depth(), parse.depth_records),
        "BOOK_TICKER": (gateio.SPOT, adapter.gateio_ticker("spot", quoted=True), parse.ticker_records),
    }
    out = None
    for kind, (feed, payload, records) in made.items():
        raw = adapter.raw_feed(events, feed.exchange, feed.market_type, payload)
        rows = records(parse.parse_messages(raw, [feed], kinds=(kind,)))
        # both sides grow alike: neither may be gathered at the driver, however small its columns are thought to be
        named = rows.join(types.hint("merge"), "seq").withColumn("topic_prefix", prefix).drop("event_type")
        one = topics.messages(named, kind).groupBy("topic", "msg_type").agg(F.count(F.lit(1)).alias("messages"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades and best bid/ask of each symbol, from two tables bucketed by symbol: joined without a shuffle."""
    events = adapter.ticks(spark, sf_dir)
    raw = adapter.raw_feed(events, "gateio", "spot", adapter.gateio_ticker("spot", quoted=True))
    quotes = tables.to_bookticker(parse.ticker_records(parse.parse_messages(raw, [gateio.SPOT], kinds=("BOOK_TICKER",))))
    made = adapter.raw_feed(events, "binance", "spot", adapter.binance_trade(F.col("us")))
    trades = tables.to_trades(parse.tick_records(parse.parse_messages(made, SPOT_FEED, kinds=("TICK",))))
    names = {}
    for kind, rows in (("trades", trades), ("bookticker", quotes)):
        path = scratch(spark, f"bucketed_{kind}")
        names[kind] = path.rpartition("/")[2].replace("-", "_")
        table_sinks.save_bucketed(rows, names[kind], path=path)
    own = spark.table(names["trades"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), F.max("price").alias("high"))
    best = spark.table(names["bookticker"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("quotes"), F.max("best_bid_price").alias("best_bid"))
    return own.hint("merge").join(best, "symbol")


@query
def degraded_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of type click are in the table and wait as well, those of type error only wait; a replay stores the rest."""
    root = scratch(spark, "degraded")
    path = f"{root}/trades"
    rows = adapter.ticks(spark, sf_dir).select("event_id", "us", "value", "event_type")
    rows.where("event_type <> 'error'").write.parquet(path)
    deadletter.store_waiting(rows.where("event_type IN ('click', 'error')"), "trades", 1, root)
    deadletter.replay(spark, "trades", root, path, ["event_id"])
    stored = spark.read.parquet(path).join(deadletter.waiting(spark, "trades", root).select("event_id", "recovery_status"), "event_id", "left")
    return stored.withColumn("recovery_status", F.coalesce("recovery_status", F.lit(deadletter.WAITING)))


# --- telemetry and streams ----------------------------------------------------------------------------


@query
def latency_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapter.ticks(spark, sf_dir)
    raw = adapter.raw_feed(events, "binance", "spot", adapter.binance_trade(F.col("us")))
    return telemetry.last_latency(parse.tick_records(parse.parse_messages(raw, SPOT_FEED, kinds=("TICK",))))


@query
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapter.ticks(spark, sf_dir)
    ids = events.select(F.col("user_id").alias("channel_id"), F.col("event_id").alias("seq"))
    gaps = telemetry.sequence_gaps(ids.withColumn("trade_id", F.col("seq")))
    return gaps.select("channel_id", "trade_id", "previous_id", "gap")


@query
def stream_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of a stream whose events of type view come last: they fill some gaps and split others."""
    source, out = scratch(spark, "ids"), scratch(spark, "gaps")
    events = adapter.ticks(spark, sf_dir)
    ids = events.select(F.col("user_id").alias("channel_id"), F.col("event_id").alias("trade_id"), "event_type")
    for late in (False, True):
        ids.where((F.col("event_type") == "view") == late).drop("event_type").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("channel_id BIGINT, trade_id BIGINT").option("maxFilesPerTrigger", 1).parquet(source)
    run = stream_gap_log.stream_gaps(stream).writeStream.format("parquet").option("path", out)
    run.option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return stream_gap_log.open_gaps(spark.read.schema(stream_gap_log.OUTPUT).parquet(out))


def _stream(spark: SparkSession, sf_dir: str) -> stream_feed.Outputs:
    raw, channels = _spot_records(spark, sf_dir)
    source = scratch(spark, "raw_feed")
    raw.select(*[f.split()[0] for f in schemas.RAW_FEED.split(", ")]).write.parquet(source)
    outputs = stream_feed.Outputs(scratch(spark, "stream"))
    feed = stream_table(spark, "raw_feed", source)
    stream_feed.start(feed, channels, outputs, AS_OF_YEAR, SPOT_FEED, interval=None, kinds=("TICK",)).awaitTermination()
    return outputs


@query
def stream_trades_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only persisted channels reach the table, so this is the daily roll-up of those."""
    return daily(stream_feed.read(spark, _stream(spark, sf_dir), "trades"))


@query
def stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of all messages of a stream, counted by the jobs that wrote them; the counts add up to the input."""
    found = commits.outcomes(spark, _stream(spark, sf_dir).root)
    return found.groupBy("outcome").agg(F.sum("messages").alias("messages"))
