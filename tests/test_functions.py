import pytest
from pyspark.sql import functions as F

from tidebook.functions import identity, levels, numbers, timeparts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, number",
    [
        ("50000.00", 50000.0), ("1.5xyz", 1.5), ("-2", -2.0), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0),
        ("1e", 1.0), ("1.2.3", 1.2), ("0.000", 0.0), ("-0", 0.0), ("1" * 20, 1.1111111111111111e19),
        (" 1.5", None), ("+1", None), ("abc", None), ("", None), ("1e999", None), ("1e-999", None),
        ("nan", None), ("inf", None), ("-", None), ("1.5d", 1.5),
    ],
)
def test_decimal_prefix(spark, text, number):
    assert one(spark, numbers.decimal_prefix(F.lit(text))) == number


@pytest.mark.parametrize(
    "us, day", [(0, -1), (86_400_000_000, 1), (4_102_444_800_000_001, -1), (4_102_444_800_000_000, 47482), (-5, -1)]
)
def test_day_number(spark, us, day):
    assert one(spark, timeparts.day_number(F.lit(us).cast("bigint"))) == day


@pytest.mark.parametrize(
    "day, valid",
    [(-1, False), (-100, False), (0, False), (10956, False), (10957, True), (20000, True), (65745, False)],
)
def test_valid_day(spark, day, valid):
    assert one(spark, timeparts.is_valid_day(F.lit(day), 2026)) is valid


def test_validity_ends_with_the_fourth_year_after(spark):
    last = one(spark, timeparts.last_valid_day(2024))
    assert one(spark, F.date_from_unix_date(F.lit(last)).cast("string")) == "2028-12-31"


def test_civil_days(spark):
    assert one(spark, timeparts.civil_day_number(F.lit(1970), F.lit(1), F.lit(1))) == 0
    assert one(spark, timeparts.civil_day_number(F.lit(2000), F.lit(1), F.lit(1))) == 10957
    assert one(spark, timeparts.seconds_to_us(F.lit(5), F.lit(7))) == 5_000_007
    assert one(spark, timeparts.date_text(F.lit(1717200000000000))) == "2024-06-01"


@pytest.mark.parametrize(
    "parts, number",
    [
        (("binance", "spot", "BTCUSDT"), 273472201),
        (("binance", "perpetual", "BTCUSDT"), 291818198),
        (("gateio", "spot", "BTC_USDT"), 37823091),
        (("COMEX", "futures", "GC"), 2260885141),
    ],
)
def test_channel_id(spark, parts, number):
    assert one(spark, identity.channel_id(*[F.lit(p) for p in parts])) == number


def test_text_keys(spark):
    assert one(spark, identity.trimmed(F.lit("GC   "))) == "GC"
    assert one(spark, identity.is_market_type(F.lit("options"))) is False


def positional(spark, text):
    found = one(spark, levels.positional_levels(F.parse_json(F.lit(text))))
    return None if found is None else [tuple(x) for x in found]


@pytest.mark.parametrize(
    "text, pairs",
    [
        ('[["1.5","2",[]],["1.25","3",[]]]', [(1.5, 2.0), (1.25, 3.0)]),
        ("[]", []),
        ('[["x","1"],["2"],[],["3","4","5"]]', [(3.0, 4.0)]),
        ('[[4,"5"]]', None),
        ('[["4",5]]', None),
        ('[["x",5],["1","1"]]', [(1.0, 1.0)]),
        ('[{"p":"1"}]', None),
        ('"text"', None),
    ],
)
def test_positional_levels(spark, text, pairs):
    assert positional(spark, text) == pairs


def test_a_wrong_type_breaks_a_list_wherever_it_stands(spark):
    good = ",".join(f'["{i}","1"]' for i in range(100))
    assert positional(spark, f'[{good},["7",5]]') is None


@pytest.mark.parametrize(
    "text, pairs",
    [
        ('[{"p":"1.5","s":3},{"p":"1.25","s":"7"}]', [(1.5, 3.0), (1.25, 7.0)]),
        ('[{"p":"x","s":3},{"p":"2","s":"bad"}]', [(2.0, 0.0)]),
        ('[{"p":"2","s":1.5}]', None),
        ('[{"p":"2"}]', None),
        ('[{"p":2,"s":1}]', None),
        ('[["1","2"]]', None),
    ],
)
def test_keyed_levels(spark, text, pairs):
    found = one(spark, levels.keyed_levels(F.parse_json(F.lit(text))))
    assert (None if found is None else [tuple(x) for x in found]) == pairs


@pytest.mark.parametrize("n", [101, 5000])
def test_long_sides_are_read_whole(spark, n):
    pairs = [(i + 0.5, float(i % 7)) for i in range(n)]
    listed = ",".join(f'["{p}","{q}"]' for p, q in pairs)
    assert positional(spark, f"[{listed}]") == pairs
    assert positional(spark, f'[{listed},["x","1"]]') == pairs  # one that doesn't read: level by level
    for quote in ("", '"'):
        keyed = ",".join(f'{{"p":"{p}","s":{quote}{int(q)}{quote}}}' for p, q in pairs)
        found = one(spark, levels.keyed_levels(F.parse_json(F.lit(f"[{keyed}]"))))
        assert [tuple(x) for x in found] == pairs


def test_padding_and_depth(spark):
    values = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    assert one(spark, levels.padded(values, F.lit(2))) == [1.0, 2.0]
    assert one(spark, levels.padded(values, F.lit(5))) == [1.0, 2.0, 3.0, 0.0, 0.0]
    shorter = F.slice(values, 1, 2)
    depths = [one(spark, levels.effective_depth(F.lit(d).cast("int"), shorter, values)) for d in (None, 0, 7, 500)]
    assert depths == [3, 3, 7, 500]
    assert levels.wide_depth(["exchange_timestamp", "ask_price3", "bid_size12", "bid_note"]) == 12


def test_side_order(spark):
    side = F.array(*[F.struct(F.lit(p).alias("price"), F.lit(1.0).alias("quantity")) for p in (99.0, 101.0, 100.0)])
    assert [x.price for x in one(spark, levels.sort_side(side, descending=True))] == [101.0, 100.0, 99.0]
    assert [x.price for x in one(spark, levels.sort_side(side, descending=False))] == [99.0, 100.0, 101.0]


PLAIN = (
    '[["1","2"]]', '[["1.5","2"],["-0.25","0"],["0.0","10.125"]]', '[["x","1"],["2","3"]]', '[["2","3"],["","x"]]', '[["1","2",[]],["3","4",[]]]',
    '[["NaN","2"]]', '[[" 1","2"]]',
)
OTHER = (
    '[]', '[[1,"2"]]', '[["1",2]]', '[["1"]]', '[["01","2"]]', '[["1e5","2"]]', '[["1.5xyz","2"]]', '[["-0","2"]]', '[["1,2","3"]]',
    '["[1","2]"]', '[["x[",["1","2"],"y"]]', '[["1","x["],["],[","2"]]', '[["\\u0031","2"]]', '[[null,"1"]]', '["[\\"1\\",\\"2\\"]"]', '"[[1,2]]"',
    '[[["1","2"]]]', '[["12345678901234567890","2"]]', '[{"1":"2"}]', '[["1", "2"]]',
)


def test_plain_levels_read_as_variants_do(spark):
    """From the text come the same levels, or none; those in the forms that nearly all have come from it."""
    df = spark.createDataFrame([(t,) for t in (*PLAIN, *OTHER)], "t STRING")
    found = df.select("t", levels.plain_levels(F.col("t")).alias("quick"), levels.positional_levels(F.parse_json("t")).alias("slow")).collect()
    assert {x.t for x in found if x.quick is None} >= set(OTHER) - {"[]"}
    assert all(x.quick == x.slow for x in found if x.quick is not None) and all(x.quick is not None for x in found if x.t in PLAIN)


def test_plain_levels_of_any_number(spark):
    text = "[" + ",".join(f'["{k}.25","{k}"]' for k in range(100_000)) + "]"
    found = spark.createDataFrame([(text,), (text[:-1] + ',["y","1"]]',)], "t STRING").select(levels.plain_levels(F.col("t")).alias("l"))
    assert [r[0] for r in found.select(F.size("l")).collect()] == [100_000] * 2


@pytest.mark.parametrize("side, count", [('[["1","2"]]', 1), ('"[[\\"1\\",\\"2\\"]]"', None), ("null", None), ('[["x","2"],[3,"4"]]', None)])
def test_a_text_in_place_of_a_list_is_none(spark, side, count):
    from tidebook.feeds import binance, gateio
    from tidebook.operators import parse

    texts = {
        binance.PERPETUAL: f'{{"e":"depthUpdate","E":1,"u":2,"b":{side},"a":[["3","4"]]}}',
        binance.SPOT: f'{{"lastUpdateId":2,"bids":{side},"asks":[["3","4"]]}}',
        gateio.SPOT: f'{{"channel":"spot.order_book","event":"update","result":{{"t":1,"lastUpdateId":2,"bids":{side},"asks":[["3","4"]]}}}}',
    }
    rows = [(1, f.exchange, f.market_type, "s", 1, 1, 1, 1, text) for f, text in texts.items()]
    columns = "channel_id BIGINT, exchange STRING, market_type STRING, symbol STRING, seq BIGINT, recv_us BIGINT, recv_ns BIGINT, dispatch_ns BIGINT, payload STRING"
    found = parse.depth_records(parse.parse_messages(spark.createDataFrame(rows, columns))).collect()
    assert [len(r.bids) for r in found] == ([] if count is None else [count] * 3)


FORMS = (*PLAIN, *OTHER, '[["x[",["1","2"]]', '[["x[","1"],["2","3"]]', '[["x","1"]["2","3"]]', '[["1","2"],]', '[["1","2"]', '[["-.5","1."],["007","-0"]]', '[["é","1"],["2","3"]]',
    '[["x","\n"],["2","3"]]', '[["1","2",[]],["x","y"]]', '[["x","1"]]', '[["1","x"]]', '["@0"]', '[["-","2"]]', '[["1-2","2"]]', '[["@0","1"],["2","3"]]', '[["1","2"],["3"]]')


def test_messages_read_the_same_with_their_lists_taken_out(spark):
    """Whatever a list holds and wherever it stands, the message reads as from its whole text; plain lists are taken."""
    import pyarrow as pa

    from tidebook.functions.taken import lists_taken, take_lists, taken_at

    texts = [f'{{"e":"x","b":{form},"a":[["3","4"],["5","6.5"]]}}' for form in FORMS]
    texts += [f'{{"m":"@0","b":{PLAIN[0]}}}', f'{{"r":{{"b":{PLAIN[1]},"x":1}},"a":{PLAIN[2]}}}', f'{{"b":{PLAIN[0]},"b":{PLAIN[0]}}}', f'{{"x":"","b":{PLAIN[0]}}},']
    texts += ['{"c":"\\u0040","b":[["1","2"]]}', '{"x":":"b":[["1","2"]]"}', '{"b":[["1","2"]],"x":"\\""}', "", None, f'["b",{PLAIN[0]}]', '{"a":1,"b":[["1","2"]]', '"b":[["1","2"]]']
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", lists_taken(F.col("t"), ["a", "b"]).alias("x"))
    docs = df.select("t", "x", F.try_parse_json("t").alias("whole"), F.try_parse_json(F.coalesce("x.rest", "t")).alias("doc"))
    sides = [f"$.{path}" for path in ("a", "b", "r.b")]
    side = lambda path: levels.positional_levels(F.try_variant_get("whole", path, "variant"))
    from_rest = lambda path: F.coalesce(taken_at(F.col("x.lists"), F.col("doc"), path), levels.positional_levels(F.try_variant_get("doc", path, "variant")))
    found = docs.select("t", "x", F.array(*map(side, sides)).alias("want"), F.array(*map(from_rest, sides)).alias("got"), F.col("whole").isNull().alias("bad"), F.col("doc").isNull().alias("bad_rest")).collect()
    for row in found:
        assert (row.got, row.bad_rest) == (row.want, row.bad), row.t
    held = {r.t: r.x.lists and len(r.x.lists) for r in found}
    assert [held[t] for t in texts[: len(PLAIN)]] == [2] * len(PLAIN)
    assert all("[[" not in r.x.rest for r in found if r.t in texts[: len(PLAIN)])  # what is parsed stays small
    part = take_lists(pa.array(texts, pa.string())[2:40], ["a", "b"]).to_pylist()
    assert [x["rest"] for x in part] == [r.x.rest for r in found][2:40]


def test_level_sums(spark):
    from tidebook.functions.taken import level_sums

    sides = [[(1.5, 2.0), (-0.25, 3.0)], [], None, [(7.0, 1.0)]]
    df = spark.createDataFrame(list(enumerate(sides)), "i INT, side ARRAY<STRUCT<price:DOUBLE,quantity:DOUBLE>>").coalesce(1)
    found = {r.i: r.s and tuple(r.s) for r in df.select("i", level_sums(F.col("side")).alias("s")).collect()}
    assert found == {0: (2, 1.25, 5.0), 1: (0, 0.0, 0.0), 2: None, 3: (1, 7.0, 1.0)}
