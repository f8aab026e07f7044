"""Header-less text sources of graphs, read in parallel and parsed strictly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import field, floating, unsigned

#: Rows of one file in file order, files by path: what "the last row wins" refers to.
ORDINAL = "ordinal"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """line, ordinal of all lines that are not blank."""
    rows = spark.read.text(path).select(
        F.trim(F.regexp_replace("value", r"\r$", "")).alias("line"),
        F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias(ORDINAL),
    )
    return rows.filter("line != ''")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).withColumn("parts", F.split("line", ",", -1))


def read_vertices(spark: SparkSession, path: str, default: int | float | None = None, kind: str = "bigint") -> DataFrame:
    """`id[,value]` lines to id, value, ordinal. A missing value is `default`, or the id where that is None; an empty one is an error."""
    parts = F.col("parts")
    vertex = unsigned(field(parts, 0), "vertex id")
    if kind == "double":
        value = floating(field(parts, 1), "vertex value", absent=F.lit(1.0 if default is None else float(default)))
    else:
        value = unsigned(field(parts, 1), "vertex value", absent=vertex if default is None else F.lit(default).cast("bigint"))
    return _csv(spark, path).select(vertex.alias("id"), value.cast(kind).alias("value"), ORDINAL)


def read_edges(spark: SparkSession, path: str, default: int = 0, most: int = 255) -> DataFrame:
    """`src,dst[,value]` lines to src, dst, value (0 to `most`)."""
    parts = F.col("parts")
    value = unsigned(field(parts, 2), "edge value", most, absent=F.lit(default).cast("bigint"))
    return _csv(spark, path).select(unsigned(field(parts, 0), "edge source").alias("src"), unsigned(field(parts, 1), "edge target").alias("dst"), value.cast("smallint").alias("value"))


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).filter(~F.startswith("line", F.lit("#"))).withColumn("parts", F.split("line", r"\s+", -1))


def read_id_list(spark: SparkSession, path: str, value: Callable[[Column], Column] | None = None) -> DataFrame:
    """One id a line, white-space separated, ``#`` comments; `value` makes the value from the id."""
    vertex = unsigned(field(F.col("parts"), 0), "vertex id")
    return _fields(spark, path).select(vertex.alias("id"), ORDINAL).withColumn("value", value(F.col("id")) if value else F.col("id"))


def read_edge_list(spark: SparkSession, path: str, undirected: bool = False) -> DataFrame:
    """`src dst [ignored]` lines; with `undirected`, each edge both ways (a self-loop becomes two)."""
    parts = F.col("parts")
    one = _fields(spark, path).select(unsigned(field(parts, 0), "edge source").alias("src"), unsigned(field(parts, 1), "edge target").alias("dst"), F.lit(0).cast("smallint").alias("value"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "value")) if undirected else one


def read_truth(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """`id value` lines of expected results."""
    parts = F.col("parts")
    value = floating(field(parts, 1), "rank") if kind == "double" else unsigned(field(parts, 1), "label")
    return _fields(spark, path).select(unsigned(field(parts, 0), "vertex id").alias("id"), value.cast(kind).alias("value"))


def generated_vertices(spark: SparkSession, n: int, value: Callable[[Column], Column] | None = None) -> DataFrame:
    """Ids 0 to n - 1."""
    return spark.range(n).withColumn("value", value(F.col("id")) if value else F.col("id"))
