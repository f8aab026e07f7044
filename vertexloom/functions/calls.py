"""User functions: Column expressions where possible, else Arrow-batched Python."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class MapFunction(Protocol):
    def __call__(self, value: Any) -> Any: ...


class FilterFunction(Protocol):
    def __call__(self, value: Any) -> bool: ...


def applied(fn: Callable, column: Column, returns: str | None = None) -> Column:
    """`fn` of a column: without `returns` it maps Column to Column; with it, Python values in Arrow batches."""
    if returns is None:
        out = fn(column)
        return out if isinstance(out, Column) else F.lit(out)

    @F.pandas_udf(returns)
    def batch(values: pd.Series) -> pd.Series:
        return values.map(fn)

    return batch(column)
