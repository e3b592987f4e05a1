"""The same answers in SQL, computed from the given tables without any JSON, parsing or books."""

from __future__ import annotations

EVENTS = """
e AS (
  SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value,
         CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
         CAST(round(value * 100) AS BIGINT) AS cents, 'U' || user_id AS symbol
  FROM events
)"""
CHANNELS = """
c AS (
  SELECT 'U' || s_suppkey AS symbol, s_nationkey AS depth_level, s_acctbal >= 0 AS record_tick,
         s_nationkey < 20 AS persist_to_disk
  FROM supplier
)"""


def _with(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join(ctes or (EVENTS,)) + "\n" + body


def _trades(ts: str, trade_id: str, quantity: str, maker: str, source: str = "e") -> str:
    return _with(f"""
SELECT event_id AS seq, symbol, {ts} AS exchange_timestamp, {trade_id} AS trade_id, value AS price,
       CAST({quantity} AS DOUBLE) AS quantity, CASE WHEN {maker} THEN -1 ELSE 1 END AS direction,
       CAST(k * 1000 AS BIGINT) AS local_diff
FROM {source}""")


_MS = "(us // 1000) * 1000"
_SPOT_TS = "CAST(trunc(CAST((us // 1000) || '.' || lpad(CAST(us % 1000 AS VARCHAR), 3, '0') AS DOUBLE) * 1000.0) AS BIGINT)"


def _depth(ts: str) -> str:
    return _with(f"""
SELECT event_id AS seq, {ts} AS exchange_timestamp, event_id AS last_update_id, side,
       CAST(row_number() OVER (PARTITION BY event_id, side ORDER BY i) AS INTEGER) AS level, price, quantity
FROM (
  SELECT event_id, us, event_type, 'bid' AS side, i, CAST(cents - i AS DOUBLE) + sign_fix AS price,
         CAST(k + i AS DOUBLE) AS quantity
  FROM (SELECT *, CASE WHEN cents - i < 0 THEN -0.25 ELSE 0.25 END AS sign_fix
        FROM e, range(0, 4) r(i) WHERE i < k % 4)
  UNION ALL
  SELECT event_id, us, event_type, 'ask' AS side, i, CAST(cents + i AS DOUBLE) + 0.25 AS price,
         CAST(k + i AS DOUBLE) AS quantity
  FROM e, range(0, 4) r(i) WHERE i < k % 3 + 1
) WHERE NOT (event_type = 'error' AND i = 0)""")


# levels of one message by position, the unreadable first level of error events taken out
_DEPTH_ROWS = """
lv AS (
  SELECT event_id, symbol, side, row_number() OVER (PARTITION BY event_id, side ORDER BY i) AS level, price, qty
  FROM (
    SELECT event_id, symbol, event_type, 'bid' AS side, i,
           cents - i + CASE WHEN cents - i < 0 THEN -0.25 ELSE 0.25 END AS price, k + i AS qty
    FROM e, range(0, 4) r(i) WHERE i < k % 4
    UNION ALL
    SELECT event_id, symbol, event_type, 'ask', i, cents + i + 0.25, k + i
    FROM e, range(0, 4) r(i) WHERE i < k % 3 + 1
  ) WHERE NOT (event_type = 'error' AND i = 0)
),
lw AS (
  SELECT event_id, level,
         CAST(max(price) FILTER (WHERE side = 'bid') AS DOUBLE) AS bid_price,
         CAST(max(qty) FILTER (WHERE side = 'bid') AS DOUBLE) AS bid_size,
         CAST(max(price) FILTER (WHERE side = 'ask') AS DOUBLE) AS ask_price,
         CAST(max(qty) FILTER (WHERE side = 'ask') AS DOUBLE) AS ask_size
  FROM lv GROUP BY event_id, level
),
d AS (
  SELECT e.event_id, us, event_type, e.symbol,
         CASE WHEN depth_level > 0 THEN depth_level
              ELSE coalesce((SELECT max(level) FROM lw WHERE lw.event_id = e.event_id), 0) END AS depth
  FROM e JOIN c ON e.symbol = c.symbol
)"""


def _padded(depth: str, extra: str = "") -> str:
    return f"""
SELECT d.event_id AS last_update_id, d.symbol, CAST(r.i AS INTEGER) AS level,
       coalesce(bid_price, 0.0) AS bid_price, coalesce(bid_size, 0.0) AS bid_size,
       coalesce(ask_price, 0.0) AS ask_price, coalesce(ask_size, 0.0) AS ask_size
FROM d JOIN range(1, 101) r(i) ON r.i <= {depth}
LEFT JOIN lw ON lw.event_id = d.event_id AND lw.level = r.i {extra}"""


BOOK = """
b AS (
  SELECT user_id AS channel_id, event_id AS seq, us, k, CAST(floor(value) AS DOUBLE) AS price,
         CASE WHEN event_type = 'error' AND k < 10 THEN 'IMAGE'
              WHEN event_type = 'error' AND k BETWEEN 20 AND 59 THEN 'UPDATE'
              WHEN event_type = 'error' AND k >= 60 THEN 'END_QUOTE' ELSE 'QUOTE' END AS kind,
         CASE WHEN event_type IN ('purchase', 'view') THEN 'SOLO'
              WHEN event_type = 'click' THEN CASE WHEN k < 30 THEN 'BEGIN' WHEN k < 60 THEN 'MIDDLE' ELSE 'END' END
              WHEN event_type = 'error' AND k BETWEEN 10 AND 19 THEN 'CLEAR'
              WHEN event_type = 'signup' AND k < 50 THEN 'SOLO' ELSE 'UNDEFINED' END AS mark,
         CASE WHEN event_type = 'purchase' OR (event_type = 'click' AND k % 2 = 0) THEN 'bid' ELSE 'ask' END AS side,
         event_type <> 'signup' AS has_price,
         CASE WHEN k % 7 <> 0 THEN CAST(k % 10 AS DOUBLE) ELSE 0.0 END AS qty
  FROM e
),
m0 AS (
  SELECT *, (kind = 'END_QUOTE' OR mark = 'END') AS commits,
         (kind = 'END_QUOTE' OR mark IN ('END', 'CLEAR')) AS closes
  FROM b WHERE kind = 'END_QUOTE' OR (kind = 'QUOTE' AND mark IN ('BEGIN', 'MIDDLE', 'END', 'CLEAR'))
),
m1 AS (
  SELECT *, coalesce(lag(closes) OVER (PARTITION BY channel_id ORDER BY seq), FALSE) AS after_close FROM m0
),
m AS (
  SELECT *, sum(CASE WHEN after_close OR mark = 'BEGIN' THEN 1 ELSE 0 END)
            OVER (PARTITION BY channel_id ORDER BY seq) AS island
  FROM m1
),
done AS (SELECT channel_id, island, max(seq) AS eff_seq FROM m WHERE commits GROUP BY ALL),
held AS (
  SELECT m.channel_id, m.island, m.seq, side, price, qty, eff_seq
  FROM m JOIN done ON m.channel_id = done.channel_id AND m.island = done.island
  WHERE kind = 'QUOTE' AND mark IN ('BEGIN', 'MIDDLE', 'END') AND has_price
),
ops AS (
  SELECT channel_id, side, price, qty, seq AS eff_seq, 0 AS idx FROM b
  WHERE kind = 'QUOTE' AND mark = 'SOLO' AND has_price
  UNION ALL
  SELECT channel_id, side, price, qty, eff_seq, seq FROM held
  UNION ALL
  SELECT channel_id, 'bid', price - i, CAST((k + i) % 4 AS DOUBLE), seq, i FROM b, range(0, 3) r(i)
  WHERE kind IN ('IMAGE', 'UPDATE')
  UNION ALL
  SELECT channel_id, 'ask', price + 1 + i, CAST((k + 1 + i) % 4 AS DOUBLE), seq, i FROM b, range(0, 3) r(i)
  WHERE kind IN ('IMAGE', 'UPDATE')
),
resets AS (SELECT channel_id, seq FROM b WHERE kind = 'IMAGE' OR (kind = 'QUOTE' AND mark = 'CLEAR')),
live AS (
  SELECT channel_id, side, CAST(price AS DOUBLE) AS price, qty FROM (
    SELECT o.*, row_number() OVER (PARTITION BY o.channel_id, side, price ORDER BY eff_seq DESC, idx DESC) AS rn,
           r.reset_seq
    FROM ops o LEFT JOIN (SELECT channel_id, max(seq) AS reset_seq FROM resets GROUP BY ALL) r
      ON o.channel_id = r.channel_id
  ) WHERE rn = 1 AND qty > 0 AND (reset_seq IS NULL OR eff_seq >= reset_seq)
)"""

_FINAL_BOOK = _with("SELECT channel_id, side, price, qty FROM live", EVENTS, BOOK)

_SNAPSHOTS = _with(
    """
, s AS (
  SELECT b.channel_id, b.seq, b.us, max(r.seq) AS reset_seq
  FROM b LEFT JOIN resets r ON r.channel_id = b.channel_id AND r.seq <= b.seq
  LEFT JOIN m ON m.channel_id = b.channel_id AND m.seq = b.seq
  LEFT JOIN (SELECT channel_id, island, min(seq) AS first_seq FROM m GROUP BY ALL) f
    ON f.channel_id = m.channel_id AND f.island = m.island
  WHERE b.kind IN ('IMAGE', 'UPDATE') OR (b.kind = 'QUOTE' AND b.mark IN ('SOLO', 'END', 'CLEAR'))
     OR (b.kind = 'END_QUOTE' AND f.first_seq < b.seq)
  GROUP BY ALL
),
v AS (
  SELECT s.channel_id, s.seq, o.side, o.price, o.qty,
         row_number() OVER (PARTITION BY s.channel_id, s.seq, o.side, o.price
                            ORDER BY o.eff_seq DESC, o.idx DESC) AS rn
  FROM s JOIN ops o ON o.channel_id = s.channel_id AND o.eff_seq <= s.seq
    AND (s.reset_seq IS NULL OR o.eff_seq >= s.reset_seq)
)
SELECT s.channel_id, s.seq, s.us AS exchange_timestamp,
       count(*) FILTER (WHERE side = 'bid') AS bids, count(*) FILTER (WHERE side = 'ask') AS asks,
       CAST(max(price) FILTER (WHERE side = 'bid') AS DOUBLE) AS best_bid,
       CAST(min(price) FILTER (WHERE side = 'ask') AS DOUBLE) AS best_ask,
       coalesce(sum(qty) FILTER (WHERE side = 'bid'), 0.0) AS bid_quantity,
       coalesce(sum(qty) FILTER (WHERE side = 'ask'), 0.0) AS ask_quantity
FROM s LEFT JOIN (SELECT * FROM v WHERE rn = 1 AND qty > 0) x
  ON x.channel_id = s.channel_id AND x.seq = s.seq
GROUP BY s.channel_id, s.seq, s.us""",
    EVENTS,
    BOOK,
).replace(")\n\n, s AS", "),\ns AS")

_INTERVALS = """
iv AS (
  SELECT channel_id, side, CAST(price AS DOUBLE) AS price, qty, eff_seq AS valid_from, valid_until FROM (
    SELECT o.*, least(next_seq, r.seq) AS valid_until FROM (
      SELECT *, lead(eff_seq) OVER (PARTITION BY channel_id, side, price ORDER BY eff_seq, idx) AS next_seq FROM ops
    ) o ASOF LEFT JOIN resets r ON r.channel_id = o.channel_id AND o.eff_seq < r.seq
  ) WHERE qty > 0 AND (valid_until IS NULL OR valid_until > eff_seq)
)"""

_REJECT = """
x AS (
  SELECT CASE WHEN event_type = 'view' AND k < 10 THEN 'parse'
              WHEN event_type = 'click' AND k < 20 THEN 'unknown_event'
              WHEN event_type = 'error' THEN
                CASE WHEN k < 30 THEN 'malformed' WHEN k < 40 THEN 'empty' WHEN k < 50 THEN 'no_feed'
                     ELSE 'unknown_event' END END AS reject_reason
  FROM e
)"""

_CONFIG = """
f AS (
  SELECT p_brand AS exchange, CASE WHEN p_size % 4 = 0 THEN 'options' ELSE 'spot' END AS market_type,
         'P' || p_partkey AS symbol, CASE WHEN p_size % 2 = 0 THEN p_size * 3 ELSE 5 END AS depth_level,
         (p_size % 7 <> 0) AND (p_size % 5 <> 0) AS enabled, p_size % 3 <> 0 AS record_tick,
         p_size <> 1 AS persist_to_disk
  FROM part
),
g AS (SELECT *, exchange || ':' || market_type || ':' || symbol AS topic_prefix FROM f)"""


def _daily(keep: str) -> str:
    return _with(
        f"""
SELECT e.symbol, CAST(make_timestamp(us) AS DATE) AS trade_date, count(*) AS trades,
       CAST(sum(k) AS DOUBLE) AS total_quantity, max(value) AS high, min(value) AS low,
       count(*) FILTER (WHERE event_type = 'click') AS maker_trades
FROM e JOIN c ON e.symbol = c.symbol WHERE {keep} GROUP BY ALL""",
        EVENTS,
        CHANNELS,
    )


_QUOTES = "value AS best_bid_price, {bq} AS best_bid_qty, CAST(cents + 0.75 AS DOUBLE) AS best_ask_price, {aq} AS best_ask_qty"

ORACLES: dict[str, str] = {
    "trade_daily": _daily("record_tick"),
    "stream_trades_daily": _daily("record_tick AND persist_to_disk"),
    "binance_spot_trades": _trades("us", "event_id", "k", "event_type = 'click'"),
    "binance_perp_trades": _trades(_MS, "event_id", "k", "event_type = 'click'"),
    "gateio_spot_trades": _trades(_SPOT_TS, "event_id", "k + 0.5", "event_type IN ('purchase', 'click')"),
    "gateio_perp_first_trades": _trades(_MS, "event_id * 10", "k", "event_type IN ('error', 'click') AND k > 0"),
    "gateio_perp_trades": _trades(
        _MS, "event_id * 10 + i", "k + i", "event_type IN ('error', 'click') AND k + i > 0", "e, range(0, 2) r(i)"
    ),
    "binance_spot_depth_levels": _depth("us"),
    "binance_perp_depth_levels": _depth(_MS),
    "gateio_spot_depth_levels": _depth(_MS),
    "gateio_perp_depth_levels": _depth(_MS),
    "book_ticker_all": _with(
        f"""
SELECT 'binance' AS exchange, 'spot' AS market_type, symbol, us AS exchange_timestamp,
       {_QUOTES.format(bq="k + 0.5", aq="CAST(k + 1 AS DOUBLE)")} FROM e
UNION ALL
SELECT 'binance', 'perpetual', symbol, {_MS}, {_QUOTES.format(bq="k + 0.5", aq="CAST(k + 1 AS DOUBLE)")} FROM e
UNION ALL
SELECT x.exchange, x.market_type, symbol, {_MS},
       {_QUOTES.format(bq="CAST(k AS DOUBLE)", aq="CAST(k + 1 AS DOUBLE)")}
FROM e, (VALUES ('gateio', 'spot'), ('gateio', 'perpetual')) x(exchange, market_type)
UNION ALL
SELECT 'COMEX', 'futures', e.symbol, us, CASE WHEN k % 2 = 0 THEN value ELSE 0.0 END, CAST(k AS DOUBLE), value + 1,
       CASE WHEN k % 2 = 0 THEN 0.0 ELSE CAST(k + 1 AS DOUBLE) END
FROM e JOIN c ON e.symbol = c.symbol""",
        EVENTS,
        CHANNELS,
    ),
    "futures_trades": _with(
        """
SELECT 'COMEX' AS exchange, e.symbol, us AS exchange_timestamp, CAST(0 AS BIGINT) AS trade_id, value AS price,
       CAST(k AS DOUBLE) AS quantity, event_type = 'click' AS is_buyer_maker
FROM e JOIN c ON e.symbol = c.symbol""",
        EVENTS,
        CHANNELS,
    ),
    "futures_unmapped": _with(
        "SELECT symbol, count(*) AS dropped FROM e WHERE symbol NOT IN (SELECT symbol FROM c) GROUP BY symbol",
        EVENTS,
        CHANNELS,
    ),
    "classify_counts": _with("""
SELECT exchange, market_type, kind, count(*) AS n FROM (
  SELECT CASE WHEN event_type IN ('signup', 'purchase', 'click') THEN 'binance'
              WHEN event_type = 'error' AND k BETWEEN 40 AND 49 THEN 'other' ELSE 'gateio' END AS exchange,
         CASE WHEN event_type IN ('view', 'click') THEN 'perpetual' ELSE 'spot' END AS market_type,
         CASE WHEN event_type = 'signup' THEN 'BOOK_TICKER' WHEN event_type = 'purchase' THEN 'TICK'
              WHEN event_type = 'view' THEN 'DEPTH'
              WHEN event_type = 'click' THEN CASE WHEN k < 20 THEN 'UNKNOWN' ELSE 'DEPTH' END
              WHEN k < 50 THEN 'NONE' ELSE 'UNKNOWN' END AS kind
  FROM e) GROUP BY ALL"""),
    "reject_counts": _with(
        """
SELECT reject_reason, count(*) AS dropped FROM x WHERE reject_reason IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'total', count(*) FROM x WHERE reject_reason IS NOT NULL""",
        EVENTS,
        _REJECT,
    ),
    "number_prefix": _with("""
SELECT event_id, shown,
       CASE event_type WHEN 'signup' THEN value WHEN 'click' THEN CAST('-' || value || 'e1' AS DOUBLE)
                       WHEN 'error' THEN CAST(k AS DOUBLE) END AS number
FROM (SELECT *, CASE event_type WHEN 'signup' THEN value || 'xyz' WHEN 'purchase' THEN ' ' || value
                WHEN 'view' THEN '+' || value WHEN 'click' THEN '-' || value || 'e1'
                ELSE k || '.' END AS shown FROM e)"""),
    "channel_ids": """
WITH n AS (SELECT 'binance:spot:U' || s_suppkey AS topic_prefix FROM supplier),
h AS (
  SELECT topic_prefix, list_reduce(
    list_prepend(14695981039346656037::HUGEINT,
                 list_transform(string_split(topic_prefix, ''), lambda c: ascii(c)::HUGEINT)),
    lambda a, c: (xor(a, c) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS v
  FROM n)
SELECT CAST(xor(v // 4294967296::HUGEINT, v % 4294967296::HUGEINT) AS BIGINT) AS channel_id, topic_prefix FROM h""",
    "channel_collisions": """
SELECT CAST(c_nationkey AS BIGINT) AS channel_id, count(DISTINCT c_mktsegment) AS channels FROM customer
GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) > 1""",
    "registry_config": _with("SELECT * FROM g", _CONFIG),
    "registry_violations": _with(
        """
SELECT topic_prefix, 'market_type' AS problem FROM g WHERE market_type NOT IN ('spot', 'perpetual', 'futures')""",
        _CONFIG,
    ),
    "enrich_inner": _with(
        """
SELECT event_id AS seq, 'binance' AS exchange, 'spot' AS market_type, e.symbol, depth_level, record_tick,
       persist_to_disk, value AS price FROM e JOIN c ON e.symbol = c.symbol""",
        EVENTS,
        CHANNELS,
    ),
    "enrich_left_defaults": _with(
        """
SELECT event_id AS seq, CASE WHEN c.symbol IS NULL THEN '' ELSE 'binance' END AS exchange,
       CASE WHEN c.symbol IS NULL THEN '' ELSE 'spot' END AS market_type, e.symbol,
       coalesce(depth_level, 0) AS depth_level, CAST(k AS DOUBLE) AS quantity
FROM e LEFT JOIN c ON e.symbol = c.symbol""",
        EVENTS,
        CHANNELS,
    ),
    "unknown_channels": _with(
        "SELECT symbol, count(*) AS dropped FROM e WHERE symbol NOT IN (SELECT symbol FROM c) GROUP BY symbol",
        EVENTS,
        CHANNELS,
    ),
    "persisted_trades": _with(
        """
SELECT e.symbol, count(*) AS trades FROM e JOIN c ON e.symbol = c.symbol
WHERE record_tick AND persist_to_disk GROUP BY e.symbol""",
        EVENTS,
        CHANNELS,
    ),
    "valid_timestamps": _with("""
SELECT event_id, t,
       CAST(CASE WHEN t <= 0 OR t > 4102444800000000 THEN -1 ELSE t // 86400000000 END AS INTEGER) AS day_number,
       t > 0 AND t <= 4102444800000000 AND t >= epoch_us(TIMESTAMP '2000-01-01')
         AND t < epoch_us(TIMESTAMP '2029-01-01') AS valid,
       strftime(make_timestamp(t), '%Y-%m-%d') AS date_text
FROM (SELECT event_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN us + 80 * 31536000000000
             WHEN 'click' THEN us + 5 * 31536000000000 - 15 * 86400000000
             WHEN 'error' THEN us - 25 * 31536000000000 ELSE us END AS t FROM e)"""),
    "depth_pad": _with(_padded("d.depth"), EVENTS, CHANNELS, _DEPTH_ROWS),
    "book_wide": _with(
        """
SELECT (d.us // 1000) * 1000 AS exchange_timestamp, d.symbol, d.event_id AS last_update_id,
       coalesce(a.ask_price, 0.0) AS ask_price1, coalesce(a.ask_size, 0.0) AS ask_size1,
       coalesce(a.bid_price, 0.0) AS bid_price1, coalesce(a.bid_size, 0.0) AS bid_size1,
       coalesce(b.ask_price, 0.0) AS ask_price2, coalesce(b.ask_size, 0.0) AS ask_size2,
       coalesce(b.bid_price, 0.0) AS bid_price2, coalesce(b.bid_size, 0.0) AS bid_size2,
       coalesce(c.ask_price, 0.0) AS ask_price3, coalesce(c.ask_size, 0.0) AS ask_size3,
       coalesce(c.bid_price, 0.0) AS bid_price3, coalesce(c.bid_size, 0.0) AS bid_size3
FROM d LEFT JOIN lw a ON a.event_id = d.event_id AND a.level = 1
LEFT JOIN lw b ON b.event_id = d.event_id AND b.level = 2 AND d.depth >= 2
LEFT JOIN lw c ON c.event_id = d.event_id AND c.level = 3 AND d.depth >= 3""",
        EVENTS,
        CHANNELS,
        _DEPTH_ROWS,
    ),
    "book_long": _with(_padded("3", "AND lw.level <= d.depth"), EVENTS, CHANNELS, _DEPTH_ROWS),
    "book_asof": _FINAL_BOOK,
    "book_final_exact": _FINAL_BOOK,
    "stream_book_final": _FINAL_BOOK,
    "book_top_n": _with(
        """
SELECT * FROM (
  SELECT channel_id, side, price, qty,
         CAST(row_number() OVER (PARTITION BY channel_id, side
              ORDER BY CASE WHEN side = 'ask' THEN price ELSE -price END) AS INTEGER) AS level
  FROM live) WHERE level <= 3""",
        EVENTS,
        BOOK,
    ),
    "batch_commits": _with(
        """
SELECT channel_id, eff_seq, count(*) AS levels, count(*) FILTER (WHERE side = 'bid') AS bids,
       sum(qty) AS quantity FROM held GROUP BY channel_id, eff_seq""",
        EVENTS,
        BOOK,
    ),
    "book_snapshots": _SNAPSHOTS,
    "book_intervals": _with(
        "SELECT channel_id, side, price, qty, valid_from, valid_until FROM iv", EVENTS, BOOK, _INTERVALS
    ),
    "book_at_times": _with(
        """
SELECT t.user_id AS channel_id, t.event_id AS at, side, price, qty
FROM (SELECT user_id, event_id FROM events WHERE event_type = 'error') t
JOIN iv ON iv.channel_id = t.user_id AND valid_from <= t.event_id AND (valid_until IS NULL OR t.event_id < valid_until)""",
        EVENTS,
        BOOK,
        _INTERVALS,
    ),
    "deep_book_levels": _with("""
SELECT event_id AS seq, bids, asks, bid_quantity, ask_quantity, bid_prices, ask_prices FROM e
JOIN (SELECT event_id, count(*) AS bids, CAST(sum(k + i) AS DOUBLE) AS bid_quantity,
             CAST(sum(cents - i + CASE WHEN cents - i < 0 THEN -0.25 ELSE 0.25 END) AS DOUBLE) AS bid_prices
      FROM e, range(0, 300) r(i) WHERE i < k + 101 AND NOT (event_type = 'error' AND i = 0) GROUP BY 1) USING (event_id)
JOIN (SELECT event_id, count(*) AS asks, CAST(sum(k + i) AS DOUBLE) AS ask_quantity,
             CAST(sum(cents + i + 0.25) AS DOUBLE) AS ask_prices
      FROM e, range(0, 400) r(i) WHERE i < k * 2 + 101 AND NOT (event_type = 'error' AND i = 0) GROUP BY 1) USING (event_id)"""),
    "bucketed_join": _with("""
SELECT symbol, count(*) AS trades, max(value) AS high, count(*) AS quotes, max(value) AS best_bid FROM e GROUP BY symbol"""),
    "partition_layout": _with("""
SELECT CAST(date_trunc('month', make_timestamp(us)) AS DATE) AS part_date, count(*) AS rows,
       count(DISTINCT event_type) AS symbols, TRUE AS bucket_per_symbol FROM e GROUP BY 1"""),
    "partition_bounds": _with("""
, r AS (SELECT min(make_timestamp(us)) AS a, max(make_timestamp(us)) AS z FROM e)
SELECT 'day' AS granularity, CAST(unnest(generate_series(date_trunc('day', a),
         date_trunc('day', z) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS bound FROM r
UNION ALL
SELECT 'month', CAST(unnest(generate_series(date_trunc('month', a),
         date_trunc('month', z) + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS DATE) FROM r
UNION ALL
SELECT 'year', CAST(unnest(generate_series(date_trunc('year', a),
         date_trunc('year', z) + INTERVAL 1 YEAR, INTERVAL 1 YEAR)) AS DATE) FROM r"""),
    "csv_trades": _with("""
SELECT us AS exchange_timestamp, CAST(k * 1000 AS BIGINT) AS local_diff, CAST(0 AS BIGINT) AS trade_id,
       value AS price, CAST(k AS DOUBLE) AS quantity, CASE WHEN event_type = 'click' THEN -1 ELSE 1 END AS direction,
       event_type = 'click' AS is_buyer_maker, upper(event_type) AS symbol, 'binance' AS exchange,
       'spot' AS market_type, CAST(make_timestamp(us) AS DATE) AS trade_date FROM e"""),
    "csv_bookticker": _with(f"""
SELECT {_MS} AS exchange_timestamp, CAST(k * 1000 AS BIGINT) AS local_diff,
       {_QUOTES.format(bq="CAST(k AS DOUBLE)", aq="CAST(k + 1 AS DOUBLE)")}, upper(event_type) AS symbol,
       'gateio' AS exchange, 'spot' AS market_type, CAST(make_timestamp(us) AS DATE) AS trade_date FROM e"""),
    "csv_orderbook": _with(
        f"""
SELECT {_MS} AS exchange_timestamp, CAST(k * 1000 AS BIGINT) AS local_diff, upper(event_type) AS symbol,
       'binance' AS exchange, 'perpetual' AS market_type, CAST(make_timestamp(us) AS DATE) AS trade_date,
       CAST(r.i AS INTEGER) AS level, coalesce(bid_price, 0.0) AS bid_price, coalesce(bid_size, 0.0) AS bid_size,
       coalesce(ask_price, 0.0) AS ask_price, coalesce(ask_size, 0.0) AS ask_size
FROM e JOIN range(1, 4) r(i) ON event_type <> 'error' OR i < 3
LEFT JOIN lw ON lw.event_id = e.event_id AND lw.level = r.i""",
        EVENTS,
        CHANNELS,
        _DEPTH_ROWS,
    ),
    "load_report": _with("""
SELECT upper(event_type) AS symbol, count(*) AS rows FROM e GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM e"""),
    "topics_sent": _with("""
SELECT CASE WHEN event_type = 'error' THEN repeat('x', 46) ELSE exchange END || ':' || market_type || ':' || symbol || ':' || suffix
       AS topic, CAST(tag AS TINYINT) AS msg_type, count(*) AS messages
FROM e, (VALUES ('binance', 'spot', 'tick', 1), ('binance', 'perpetual', 'depth', 2), ('gateio', 'spot', 'book_ticker', 3))
     t(exchange, market_type, suffix, tag) GROUP BY 1, 2"""),
    "degraded_replay": _with("""
SELECT event_id, us, value, event_type, CAST(event_type IN ('click', 'error') AS INTEGER) AS recovery_status FROM e"""),
    "records_outcome": _with(
        """
SELECT 'TICK' AS kind, CASE WHEN c.symbol IS NULL THEN 'unregistered' WHEN NOT record_tick THEN 'unrecorded'
       ELSE 'stored' END AS outcome, count(*) AS messages FROM e LEFT JOIN c ON e.symbol = c.symbol GROUP BY 2""",
        EVENTS,
        CHANNELS,
    ),
    "stream_outcomes": _with(
        """
SELECT CASE WHEN c.symbol IS NULL THEN 'unregistered' WHEN NOT record_tick THEN 'unrecorded'
       WHEN persist_to_disk THEN 'stored' ELSE 'not_persisted' END AS outcome, CAST(count(*) AS BIGINT) AS messages
FROM e LEFT JOIN c ON e.symbol = c.symbol GROUP BY 1""",
        EVENTS,
        CHANNELS,
    ),
    "futures_daily": _daily("record_tick"),
    "csv_rejects": _with("""
SELECT upper(event_type) AS symbol, CASE WHEN event_type IN ('error', 'signup') THEN 'bad_value'
       WHEN event_type = 'view' THEN 'invalid_time' ELSE 'stored' END AS reject_reason, count(*) AS rows, kind
FROM e, (VALUES ('trades'), ('orderbook')) t(kind) GROUP BY ALL"""),
    "latency_last": _with("""
SELECT user_id AS channel_id, CAST(arg_max(k, event_id) AS DOUBLE) AS latency_us, max(event_id) AS seq
FROM e GROUP BY user_id"""),
    "sequence_gaps": """
SELECT channel_id, trade_id, previous_id, trade_id - previous_id - 1 AS gap FROM (
  SELECT user_id AS channel_id, event_id AS trade_id,
         lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_id FROM events)
WHERE trade_id - previous_id - 1 > 0""",
}
ORACLES["partition_bounds"] = ORACLES["partition_bounds"].replace(")\n\n, r AS", "),\nr AS")
ORACLES["stream_gaps"] = ORACLES["sequence_gaps"]
