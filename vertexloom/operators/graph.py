"""Graphs as a pair of tables: vertices (id, value) and directed edges (src, dst, value)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """Vertex ids are unique; edges are a bag, in which multi-edges and self-loops stay.

    An edge whose source is no vertex never fires, so it is left out. One whose target is no vertex
    stays: it counts in the out-degree and as activity, and its messages reach nobody.
    """

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def build(vertices: DataFrame, edges: DataFrame) -> "Graph":
        """Of rows that repeat an id, the last by `ordinal` wins; without that column ids must be unique."""
        if "ordinal" in vertices.columns:
            vertices = last_wins(vertices)
        vertices = vertices.select("id", "value")
        if "value" not in edges.columns:
            edges = edges.withColumn("value", F.lit(0).cast("smallint"))
        edges = edges.select("src", "dst", "value")
        return Graph(vertices, edges.join(vertices.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "value"))

    @staticmethod
    def of(spark: SparkSession, vertices: list[tuple], edges: list[tuple], id_type: str = "bigint", value_type: str = "bigint", edge_type: str = "bigint") -> "Graph":
        """From lists of (id, value) and (src, dst, value)."""
        v = spark.createDataFrame([(i, x, k) for k, (i, x) in enumerate(vertices)], f"id {id_type}, value {value_type}, ordinal bigint")
        return Graph.build(v, spark.createDataFrame(edges, f"src {id_type}, dst {id_type}, value {edge_type}"))

    def undirected(self) -> "Graph":
        """Every edge both ways; a self-loop becomes two."""
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "value")
        return Graph.build(self.vertices, self.edges.unionByName(back))

    def partitioned(self, n: int) -> "Graph":
        """Vertices by id and edges by source in the same `n` partitions."""
        n = max(1, n)
        return Graph(self.vertices.repartition(n, "id"), self.edges.repartition(n, "src"))

    def out_degrees(self) -> DataFrame:
        """id, degree of the vertices that have edges; edges to unknown targets count."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))

    def adjacency(self) -> DataFrame:
        """id, targets array<dst, value>, sorted."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dst", "value"))).alias("targets"))

    def dangling_edges(self) -> DataFrame:
        """Edges whose target is no vertex."""
        return self.edges.join(self.vertices.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst", "value")

    def with_values(self, vertices: DataFrame) -> "Graph":
        return Graph(vertices.select("id", "value"), self.edges)


def last_wins(rows: DataFrame, key: str = "id", value: str = "value", order: str = "ordinal") -> DataFrame:
    """One row a key: the value of its greatest ordinal. Partial maxima are taken before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def orphan_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose source is no vertex."""
    return edges.join(vertices.select(F.col("id").alias("src")), "src", "left_anti")
