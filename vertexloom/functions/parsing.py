"""Strict parsing of text fields as Column expressions: a bad field fails the query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(parts: Column, k: int) -> Column:
    """The k-th field, trimmed; null where the row has fewer."""
    return F.trim(F.get(parts, k))


def _checked(text: Column, fits: Column, value: Column, what: str, absent: Column | None) -> Column:
    bad = F.raise_error(F.concat(F.lit(f"invalid {what}: '"), F.coalesce(text, F.lit("")), F.lit("'"))).cast("string")
    ok = F.when(fits & value.isNotNull(), value)
    # raise_error has no type of its own, so the failing branch is cast to the value's
    if absent is None:
        return F.when(text.isNull(), F.raise_error(F.lit(f"missing {what}"))).when(F.coalesce(fits & value.isNotNull(), F.lit(False)), ok).otherwise(bad.try_cast("bigint"))
    return F.when(text.isNull(), absent).when(F.coalesce(fits & value.isNotNull(), F.lit(False)), ok).otherwise(bad.try_cast("bigint"))


def unsigned(text: Column, what: str = "id", most: int = (1 << 63) - 1, absent: Column | None = None) -> Column:
    """A non-negative integer up to `most`; `absent` stands for a missing field, never for an empty one."""
    digits = F.regexp_replace(text, r"^\+", "")
    value = F.when(F.rlike(text, F.lit(r"^\+?[0-9]+$")), digits.try_cast("decimal(38,0)"))
    return _checked(text, value <= F.lit(most).cast("decimal(38,0)"), F.when(value <= F.lit(most).cast("decimal(38,0)"), value.try_cast("bigint")), what, absent)


def floating(text: Column, what: str = "number", absent: Column | None = None) -> Column:
    """A decimal number, inf or nan."""
    fits = F.rlike(text, F.lit(r"(?i)^[+-]?(?:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)$"))
    return _checked(text, fits, text.try_cast("double"), what, absent)
