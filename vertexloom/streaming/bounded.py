"""Bounded streams: a table with an order, mapped, filtered and cut into windows of a row count."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calls import applied
from ..functions.storage import durable


@dataclass(frozen=True)
class TumblingCount:
    """Windows of `size` rows in order of arrival; at least 1; the last may be shorter."""

    size: int

    @property
    def rows(self) -> int:
        return max(1, self.size)


@dataclass(frozen=True)
class Stream:
    """Columns ordinal and value."""

    rows: DataFrame

    @staticmethod
    def of(spark: SparkSession, values: list, value_type: str = "bigint") -> "Stream":
        return Stream(spark.createDataFrame(list(enumerate(values)), f"ordinal bigint, value {value_type}"))

    @staticmethod
    def from_table(df: DataFrame, value: str, order: str) -> "Stream":
        return Stream(df.select(F.col(order).alias("ordinal"), F.col(value).alias("value")))

    def map(self, fn: Callable[[Any], Any], returns: str | None = None) -> "Stream":
        """`fn` maps a Column, or, with the type it `returns`, Python values in Arrow batches."""
        return Stream(self.rows.select("ordinal", applied(fn, F.col("value"), returns).alias("value")))

    def filter(self, fn: Callable[[Any], Any], python: bool = False) -> "Stream":
        return Stream(self.rows.filter(applied(fn, F.col("value"), "boolean" if python else None)))

    def window(self, descriptor: TumblingCount) -> "WindowedStream":
        return WindowedStream(self, descriptor)

    def collect(self) -> list:
        return [r["value"] for r in self.rows.orderBy("ordinal").select("value").collect()]


@dataclass(frozen=True)
class WindowedStream:
    stream: Stream
    descriptor: TumblingCount

    def numbered(self) -> DataFrame:
        """window, ordinal, value. Ordinals come in two passes: counts by sorted partition, then places
        within it, so no task sees all rows; the sorted partitions are written first, as both passes must see the same."""
        # the low 33 bits of the generated id count rows within the partition, those above name it
        rows = durable(self.stream.rows.repartitionByRange("ordinal").sortWithinPartitions("ordinal").select("ordinal", "value", F.monotonically_increasing_id().alias("at")), "ordinals")
        part = rows.withColumn("part", F.shiftright("at", 33))
        counts = part.groupBy("part").count()  # one row a partition
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
        place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
        return part.join(offsets, "part").select(F.floor(place / self.descriptor.rows).cast("bigint").alias("window"), "ordinal", "value")

    def windows(self) -> DataFrame:
        """window, values in order."""
        gathered = self.numbered().groupBy("window").agg(F.sort_array(F.collect_list(F.struct("ordinal", "value"))).alias("rows"))
        return gathered.select("window", F.transform("rows", lambda r: r["value"]).alias("values"))

    def collect(self) -> list[list]:
        return [list(r["values"]) for r in self.windows().orderBy("window").collect()]
