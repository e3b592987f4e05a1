"""Typed access to a parsed JSON document (variant).

Paths into a variant are case-sensitive, so ``$.b`` and ``$.B`` stay apart, and its own type is kept, so a
number sent as text can be told from a bare number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_at(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant")


def kind_at(doc: Column, path: str) -> Column:
    """``STRING``, ``BIGINT``, ``VOID`` (JSON null), ...; NULL where nothing is there."""
    return F.schema_of_variant(value_at(doc, path))


def text_at(doc: Column, path: str) -> Column:
    return F.when(kind_at(doc, path) == "STRING", F.try_variant_get(doc, path, "string"))


def integer_at(doc: Column, path: str) -> Column:
    return F.when(kind_at(doc, path) == "BIGINT", F.try_variant_get(doc, path, "bigint"))


def unsigned_at(doc: Column, path: str) -> Column:
    number = F.try_variant_get(doc, path, "bigint")
    return F.when((kind_at(doc, path) == "BIGINT") & (number >= 0), number)


def flag_at(doc: Column, path: str) -> Column:
    return F.when(kind_at(doc, path) == "BOOLEAN", F.try_variant_get(doc, path, "boolean"))


def list_at(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "array<variant>")


def bound(column: Column, use: Callable[[Column], Column]) -> Column:
    """``use(column)`` with the column evaluated once. Higher-order, so not for scalar hot paths."""
    return F.get(F.transform(F.array(column), use), F.lit(0))
