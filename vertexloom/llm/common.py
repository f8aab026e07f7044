"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import discard_table, durable, shared_folder

__all__ = ["WS_CLASS", "Scratch", "crc32_mod", "durable", "let", "shared_folder", "table", "unused"]

#: A word is a run without space, tab, line feed, vertical tab, form feed or carriage return.
WS_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once for each row, however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text modulo `n`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Tables of the steps of one operator, removed when it has its result."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(durable(df, name))
        return self.tables[-1]

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.tables = [x for x in self.tables if x is not t]
            discard_table(t)

    def clear(self) -> None:
        self.drop(*self.tables)
