"""Decimal text to numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebook.functions.jsonfields import kind_at

# Fixed value: the longest decimal prefix of a text; no blanks, no plus sign, no names such as "nan".
DECIMAL_PREFIX = r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
# A text that is such a number as a whole, far from the limits of a double.
PLAIN_NUMBER = r"-?[0-9]{1,15}(?:\.[0-9]{0,20})?"
PLAIN_DECIMAL = f"^{PLAIN_NUMBER}$"
# One that JSON reads as a number too, and as the same.
JSON_NUMBER = r"(?:-?+[1-9][0-9]{0,14}+|0|-0(?=\.))(?:\.[0-9]{1,20}+)?+"


def decimal_prefix(text: Column) -> Column:
    """``1.5xyz`` gives 1.5. NULL when no number leads the text or it does not fit a double.

    Plain decimals, nearly all there is, go straight to a cast.
    """
    digits = F.regexp_extract(text, DECIMAL_PREFIX, 0)
    number = digits.try_cast("double")
    shrunk_to_zero = F.regexp_like(digits, F.lit("^[-.0]*[1-9]"))
    any_form = F.when(number == 0, F.when(~shrunk_to_zero, number)).when(
        F.abs(number) != F.lit(float("inf")), number
    )
    return F.when(F.regexp_like(text, F.lit(PLAIN_DECIMAL)), text.try_cast("double")).otherwise(any_form)


def quantity_at(doc: Column, path: str) -> Column:
    """A quantity sent as text or bare integer. Unreadable text is 0; anything else is NULL."""
    kind = kind_at(doc, path)
    as_text = decimal_prefix(F.try_variant_get(doc, path, "string"))
    return F.when(kind == "BIGINT", F.try_variant_get(doc, path, "double")).when(
        kind == "STRING", F.coalesce(as_text, F.lit(0.0))
    )


def price_at(doc: Column, path: str) -> Column:
    """A decimal that must be sent as JSON text."""
    return F.when(kind_at(doc, path) == "STRING", decimal_prefix(F.try_variant_get(doc, path, "string")))
