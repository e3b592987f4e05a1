"""Captured CSV trees to table rows.

Two directory layouts are read:

* ``{root}/{exchange}/{market_type}/{symbol}/{kind}_{date}.csv``
* ``{root}/{kind}/exchange=../market_type=../symbol=../trade_date=../*.csv``, as the CSV sink writes it

Keys come from the path, never from the file. Rows are read as text and cast with ``try_cast``, as a file may
repeat its header line; such lines and wholly empty ones are left out. All others give a row, and :func:`checked` tells
which may be stored: what isn't there reads as nothing (a level as 0.0), what is there and isn't a number as NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook import schemas
from tidebook.functions import levels, timeparts

HEADERS = {
    "trades": ("exchange_timestamp", "local_diff", "price", "quantity", "direction"),
    "bookticker": (
        "exchange_timestamp",
        "local_diff",
        "symbol",
        "best_bid_price",
        "best_bid_qty",
        "best_ask_price",
        "best_ask_qty",
    ),
}


def path_keys(path: Column, kind: str) -> dict[str, Column]:
    """``exchange``, ``market_type`` and ``symbol`` out of a file path of either layout."""
    flat = rf"/([^/]+)/([^/]+)/([^/]+)/{kind}_[^/]*\.csv$"
    nested = r"/exchange=([^/]+)/market_type=([^/]+)/symbol=([^/]+)/"
    is_nested = F.regexp_like(path, F.lit(nested))

    def part(i: int) -> Column:
        raw = F.when(is_nested, F.regexp_extract(path, nested, i)).otherwise(F.regexp_extract(path, flat, i))
        # the file source percent-encodes odd characters; a plus sign stands for itself in a path
        return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)

    return {"exchange": part(1), "market_type": part(2), "symbol": part(3)}


def _scan(root: str, kind: str, layout: str) -> tuple[str, str]:
    if layout == "flat":
        return root, f"{kind}_*.csv"
    if layout == "nested":
        return f"{root}/{kind}", "*.csv"
    raise ValueError(f"unknown layout {layout!r}")


def _lines(spark: SparkSession, root: str, kind: str, layout: str, columns: tuple[str, ...]) -> DataFrame:
    """The named columns as text, with the path keys, header lines left out."""
    folder, glob = _scan(root, kind, layout)
    ddl = ", ".join(f"`{c}` STRING" for c in columns)
    rows = (
        spark.read.schema(ddl)
        .option("header", False)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .csv(folder)
        .select("*", F.col("_metadata.file_path").alias("file_path"))
    )
    # A line whose first cell is empty has no time, but it is a line.
    return rows.where(~F.col("exchange_timestamp").eqNullSafe("exchange_timestamp"))


def _numbers() -> dict[str, Column]:
    ts = F.col("exchange_timestamp").try_cast("bigint")
    return {
        "exchange_timestamp": ts,
        "local_diff": F.col("local_diff").try_cast("bigint"),
        "trade_date": timeparts.trade_date(ts),
    }


def _named(rows: DataFrame, columns: dict[str, Column], table: str, extra: tuple[str, ...]) -> DataFrame:
    names = [field.split()[0] for field in schemas.TABLES[table].split(", ")]
    return rows.select(*[columns[n].alias(n) for n in names], *extra)


def read_trades(spark: SparkSession, root: str, layout: str = "flat", keep_path: bool = False) -> DataFrame:
    """Trade rows; the file has no id, and the maker flag follows from the direction."""
    rows = _lines(spark, root, "trades", layout, HEADERS["trades"])
    direction = F.col("direction").try_cast("int")
    columns = {
        **_numbers(),
        **path_keys(F.col("file_path"), "trades"),
        "trade_id": F.lit(0).cast("bigint"),
        "price": F.col("price").try_cast("double"),
        "quantity": F.col("quantity").try_cast("double"),
        "direction": direction,
        "is_buyer_maker": direction == -1,
    }
    return _named(rows, columns, "trades", ("file_path",) if keep_path else ())


def read_bookticker(
    spark: SparkSession, root: str, layout: str = "flat", keep_path: bool = False
) -> DataFrame:
    """Best bid/ask rows; the symbol of the path wins over the one in the file."""
    rows = _lines(spark, root, "bookticker", layout, HEADERS["bookticker"])
    quotes = ("best_bid_price", "best_bid_qty", "best_ask_price", "best_ask_qty")
    columns = {
        **_numbers(),
        **path_keys(F.col("file_path"), "bookticker"),
        **{q: F.col(q).try_cast("double") for q in quotes},
    }
    return _named(rows, columns, "bookticker", ("file_path",) if keep_path else ())


_STAMP = "exchange_timestamp"
_LEVEL_PARTS = ("ask_prices", "ask_sizes", "bid_prices", "bid_sizes")


def _place(name: str) -> Column:
    """Where a header line has the column; NULL if it lacks it."""
    at = F.array_position("head", name)
    return F.when(at > 0, (at - 1).cast("int")).alias("_at")


def _places(array: str) -> Column:
    """Where a header line has the numbered columns of one array, in the order of their numbers up to the highest."""
    stem = array[:-1]
    numbers = F.transform(
        F.filter("head", lambda c: F.regexp_like(c, F.lit(r"^(ask|bid)_(price|size)[0-9]{1,6}$"))),
        lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("int"),
    )
    deepest = F.coalesce(F.array_max(numbers), F.lit(0))
    at = F.transform(
        F.sequence(F.lit(1), deepest), lambda i: (F.array_position("head", F.concat(F.lit(stem), i.cast("string"))) - 1).cast("int")
    )
    found = F.transform(at, lambda i: F.when(i >= 0, i))
    return F.when(deepest > 0, found).otherwise(F.array().cast("array<int>"))


def read_orderbook(
    spark: SparkSession,
    root: str,
    layout: str = "flat",
    columns: list[str] | None = None,
    keep_path: bool = False,
) -> DataFrame:
    """Order-book rows of any depth and order of columns.

    Each file's header line says where its levels are, so files of different depths and orders mix; a level that the
    header or a line lacks reads as 0.0, one that holds no number as NULL. Headers, one short row for each file, are joined to the lines by file. A
    file without a header is read as ``ask_price, ask_size, bid_price, bid_size`` repeated, as deep as its lines are
    wide; or name all columns of headless files in ``columns``.
    """
    if columns:
        rows = _lines(spark, root, "orderbook", layout, tuple(columns))
        arrays = levels.arrays_from_wide(columns)
    else:
        folder, glob = _scan(root, "orderbook", layout)
        text = (
            spark.read.option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob)
            .text(folder)
            .select(F.split("value", ",").alias("cells"), F.col("_metadata.file_path").alias("file_path"))
        )
        first = F.get("cells", F.lit(0))
        empty = (F.size("cells") == 1) & (F.trim(first) == "")
        lines = text.where((first != _STAMP) & ~empty).withColumnRenamed("cells", "line")
        heads = text.where(first == _STAMP).groupBy("file_path").agg(F.min("cells").alias("head"))
        heads = heads.select("file_path", F.lit(True).alias("_named"), *[_places(name).alias(name) for name in _LEVEL_PARTS], _place("local_diff"))
        # One row a file goes to all tasks: a join by file would bring all lines of a file, or of several, to one.
        joined = lines.join(F.broadcast(heads), "file_path", "left")
        depth = F.ceil((F.size("line") - 2) / 4).cast("int")

        def cells(k: int, name: str) -> Column:
            regular = F.transform(F.sequence(F.lit(0), depth - 1), lambda i: i * 4 + k + 2)
            regular = F.when(depth > 0, regular).otherwise(F.array().cast("array<int>"))
            places = F.coalesce(F.col(f"{name}s"), regular)
            return F.transform(places, lambda at: levels.cell(F.get("line", at)))

        rows = joined.select(
            F.get("line", F.lit(0)).alias(_STAMP),
            F.when(F.col("_named").isNull(), F.get("line", F.lit(1))).when(F.col("_at").isNull(), "0").otherwise(F.get("line", "_at")).alias("local_diff"),
            *[cells(k, name).alias(f"_{name}") for k, name in enumerate(("ask_price", "ask_size", "bid_price", "bid_size"))],
            "file_path",
        )
        arrays = {f"{name}s": F.col(f"_{name}") for name in ("ask_price", "ask_size", "bid_price", "bid_size")}
    named = {**_numbers(), **path_keys(F.col("file_path"), "orderbook"), **arrays}
    return _named(rows, named, "orderbook", ("file_path",) if keep_path else ())


READERS = {"trades": read_trades, "orderbook": read_orderbook, "bookticker": read_bookticker}


def load_report(rows: DataFrame) -> DataFrame:
    """Rows per file and, under a NULL path, in all."""
    return rows.rollup("file_path").agg(F.count(F.lit(1)).alias("rows"))


def checked(rows: DataFrame, as_of_year: int) -> tuple[DataFrame, DataFrame]:
    """Rows that may be stored, and the others with a ``reject_reason``: a value (or one of a list) that didn't read, or a
    bad time. Together they are all rows."""
    required = [F.col(c).isNull() for c in rows.columns if c not in ("trade_date", "file_path", "is_buyer_maker")]
    required += [F.exists(c, lambda x: x.isNull()) for c, kind in rows.dtypes if kind.startswith("array")]
    broken = required[0]
    for column in required[1:]:
        broken = broken | F.coalesce(column, F.lit(True))
    valid = timeparts.is_valid_us(F.col("exchange_timestamp"), as_of_year)
    reason = F.when(broken, "bad_value").when(~valid, "invalid_time")
    marked = rows.withColumn("reject_reason", reason)
    return marked.where("reject_reason IS NULL").drop("reject_reason"), marked.where("reject_reason IS NOT NULL")
