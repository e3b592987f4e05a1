"""Price levels as ``array<struct<price,quantity>>`` and their flat, wide and long forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebook.functions.jsonfields import bound, kind_at, list_at, value_at
from tidebook.functions.numbers import JSON_NUMBER, PLAIN_DECIMAL, price_at, quantity_at
from tidebook.functions.taken import taken_at

# Levels in the text of a list: two plain decimals, or a text that no number leads and any other one. A text that is
# JSON is a list of such levels if "[]" is left without them: each begins where an element does, and has no escapes.
_PLAIN_LEVEL = rf'\["{JSON_NUMBER}","{JSON_NUMBER}"(?:,\[\])?\]'
_SKIPPED_LEVEL = r'\["(?:[^-.0-9"\\][^"\\]*)?","[^"\\]*"(?:,\[\])?\]'


def _readable(marked: Column) -> Column:
    """The levels that read; NULL when one has the wrong JSON type.

    ``marked`` holds structs (price, quantity, broken).
    """
    return bound(
        marked,
        lambda found: F.when(
            ~F.exists(found, lambda m: m.broken),
            F.transform(
                F.filter(found, lambda m: m.price.isNotNull() & m.quantity.isNotNull()),
                lambda m: F.struct(m.price.alias("price"), m.quantity.alias("quantity")),
            ),
        ),
    )


def _plain(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(PLAIN_DECIMAL)), F.lit(False))


def positional_levels(found: Column) -> Column:
    """``[["price","qty",...],...]`` (a variant). Short or non-numeric levels are skipped, further elements
    ignored; a price or quantity that is no text breaks the list.

    Lists of texts only, which nearly all are, are read as typed cells; each cell is tested by itself, so the
    length of a list doesn't matter."""
    cells = F.try_variant_get(found, "$", "array<array<string>>")
    plain = F.transform(
        cells,
        lambda x: F.struct(
            F.get(x, F.lit(0)).try_cast("double").alias("price"),
            F.get(x, F.lit(1)).try_cast("double").alias("quantity"),
        ),
    )
    texts = F.schema_of_variant(found) == "ARRAY<ARRAY<STRING>>"
    simple = texts & F.forall(cells, lambda x: _plain(F.get(x, F.lit(0))) & _plain(F.get(x, F.lit(1))))

    def mark(level: Column) -> Column:
        is_list = F.schema_of_variant(level).startswith("ARRAY")

        def with_price(price: Column) -> Column:
            broken = (kind_at(level, "$[0]") != "STRING") | (
                price.isNotNull() & (kind_at(level, "$[1]") != "STRING")
            )
            return F.struct(
                price.alias("price"),
                F.when(price.isNotNull(), price_at(level, "$[1]")).alias("quantity"),
                (~is_list | F.coalesce(broken, F.lit(False))).alias("broken"),
            )

        return bound(price_at(level, "$[0]"), with_price)

    return F.when(simple, plain).otherwise(_readable(F.transform(list_at(found, "$"), mark)))


def plain_levels(text: Column) -> Column:
    """What :func:`positional_levels` gives, straight from the JSON text of the list; NULL where levels have other forms
    than nearly all have.

    The text is tested as a whole and read as numbers, so that no expression is evaluated for each cell."""

    def only(level: str) -> Column:
        return F.regexp_replace(text, f"(?:(?:{level}),?+){{1,16}}+", "") == "[]"  # some at once, and no more than a stack bears

    def numbers(list_text: Column) -> Column:
        bare = F.replace(F.replace(list_text, F.lit(",[]"), F.lit("")), F.lit('"'), F.lit(""))
        return F.from_json(bare, "array<array<double>>")

    def levels(cells: Column) -> Column:
        return F.transform(cells, lambda x: F.struct(F.get(x, F.lit(0)).alias("price"), F.get(x, F.lit(1)).alias("quantity")))

    some = F.filter(numbers(F.regexp_replace(text, _SKIPPED_LEVEL, "[null]")), lambda x: F.get(x, F.lit(0)).isNotNull())
    return F.when(only(_PLAIN_LEVEL), levels(numbers(text))).when(only(f"{_PLAIN_LEVEL}|{_SKIPPED_LEVEL}"), levels(some))


def plain_sides(payload: Column, doc: Column, bids: str, asks: str) -> Column:
    """Both sides by :func:`plain_levels`, at paths of one or two fields of a message and its variant. A text in place of a
    list is none, whatever it holds."""
    paths = [bids.split("."), asks.split(".")]
    fields = ", ".join(f"{p[-1]} STRING" for p in paths)
    nested = len(paths[0]) > 1
    texts = F.from_json(payload, f"{paths[0][0]} STRUCT<{fields}>" if nested else fields)
    texts = texts[paths[0][0]] if nested else texts

    def side(found: Column, path: list[str]) -> Column:
        is_list = value_at(doc, f"$.{'.'.join(path)}[0]").isNotNull()
        return F.when(is_list, plain_levels(found[path[-1]]))

    return bound(texts, lambda t: F.struct(side(t, paths[0]).alias("bids"), side(t, paths[1]).alias("asks")))


def sides_at(lists: Column, payload: Column, doc: Column, bids: str, asks: str) -> Column:
    """Both sides of a message out of the lists that were taken from its text; other sides by :func:`plain_sides`."""
    taken = F.struct(*[taken_at(lists, doc, f"$.{path}").alias(name) for path, name in ((bids, "bids"), (asks, "asks"))])

    def others(found: Column) -> Column:
        return bound(
            plain_sides(payload, doc, bids, asks),
            lambda o: F.struct(*[F.coalesce(found[name], o[name]).alias(name) for name in ("bids", "asks")]),
        )

    return bound(taken, lambda t: F.when(t.bids.isNotNull() & t.asks.isNotNull(), t).otherwise(others(t)))


def keyed_levels(found: Column) -> Column:
    """``[{"p":"price","s":size},...]`` (a variant). A non-numeric price is skipped; a missing or odd field
    breaks the list. Lists of one shape are read as typed cells, as above."""
    cells = F.try_variant_get(found, "$", "array<struct<p:string,s:string>>")
    shape = F.schema_of_variant(found).isin("ARRAY<OBJECT<p: STRING, s: BIGINT>>", "ARRAY<OBJECT<p: STRING, s: STRING>>")
    simple = shape & F.forall(cells, lambda x: _plain(x.p) & _plain(x.s))
    plain = F.transform(
        cells, lambda x: F.struct(x.p.try_cast("double").alias("price"), x.s.try_cast("double").alias("quantity"))
    )

    def mark(level: Column) -> Column:
        text_price = F.coalesce(kind_at(level, "$.p") == "STRING", F.lit(False))
        pair = F.struct(price_at(level, "$.p").alias("price"), quantity_at(level, "$.s").alias("quantity"))
        return bound(
            pair,
            lambda x: F.struct(
                x.price.alias("price"),
                x.quantity.alias("quantity"),
                (~text_price | (x.price.isNotNull() & x.quantity.isNull())).alias("broken"),
            ),
        )

    return F.when(simple, plain).otherwise(_readable(F.transform(list_at(found, "$"), mark)))


def delivered_levels(levels: Column) -> Column:
    """Levels of an image: order kept, empty sizes dropped."""
    kept = F.filter(levels, lambda x: x["size"] > 0)
    return F.transform(kept, lambda x: F.struct(x.price.alias("price"), x["size"].cast("double").alias("quantity")))


def effective_depth(depth_level: Column, bids: Column, asks: Column) -> Column:
    """Stored depth: missing or zero means all that the record has."""
    return F.when(depth_level > 0, depth_level).otherwise(
        F.greatest(F.size(bids), F.size(asks), F.lit(0))
    ).cast("int")


def padded(values: Column, depth: Column) -> Column:
    """The first ``depth`` values, filled up with 0.0."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), depth)), F.lit(1), depth)


def depth_arrays(bids: Column, asks: Column, depth: Column) -> dict[str, Column]:
    return {
        "bid_prices": padded(bids.getField("price"), depth),
        "bid_sizes": padded(bids.getField("quantity"), depth),
        "ask_prices": padded(asks.getField("price"), depth),
        "ask_sizes": padded(asks.getField("quantity"), depth),
    }


def sort_side(levels: Column, descending: bool) -> Column:
    """Best level first: bids descending, asks ascending."""
    ordered = F.array_sort(levels)
    return F.reverse(ordered) if descending else ordered


def wide_columns(depth: int) -> list[Column]:
    """Array columns to ``ask_price1, ask_size1, bid_price1, bid_size1, ask_price2, ...``."""
    out = []
    for i in range(depth):
        for side in ("ask", "bid"):
            for part, array in (("price", f"{side}_prices"), ("size", f"{side}_sizes")):
                value = F.coalesce(F.get(F.col(array), F.lit(i)), F.lit(0.0))
                out.append(value.alias(f"{side}_{part}{i + 1}"))
    return out


def cell(value: Column) -> Column:
    """A level's number out of a file: 0.0 for a cell that isn't there or is empty, NULL for one that isn't a number."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(value.isNull() | (text == ""), F.lit(0.0)).when(finite, number)


def arrays_from_wide(columns: list[str]) -> dict[str, Column]:
    """The reverse of :func:`wide_columns`; a level column that is absent or empty reads as 0.0, one that holds no number
    as NULL."""
    depth = wide_depth(columns)
    present = set(columns)

    def array(side: str, part: str) -> Column:
        names = [f"{side}_{part}{i}" for i in range(1, depth + 1)]
        cells = [cell(F.col(n)) if n in present else F.lit(0.0) for n in names]
        return F.array(*cells) if cells else F.array().cast("array<double>")

    return {f"{s}_{p}s": array(s, p) for s in ("bid", "ask") for p in ("price", "size")}


def wide_depth(columns: list[str]) -> int:
    """Highest level number among the column names."""
    numbers = [0]
    for name in columns:
        for stem in ("ask_price", "ask_size", "bid_price", "bid_size"):
            if name.startswith(stem) and name[len(stem):].isdigit():
                numbers.append(int(name[len(stem):]))
    return max(numbers)
