"""The Graph500-style runner: load a described dataset, compute, dump, compare with its truth files."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..operators.algorithms import components, pagerank
from ..operators.graph import Graph
from ..operators.verify import verify_labels, verify_ranks
from ..sources.datasets import DatasetMeta
from ..sources.text import read_edge_list, read_id_list, read_truth
from .sinks import dump_csv

RUNS = ("wcc", "pagerank")


def load(spark: SparkSession, meta: DatasetMeta, ranks: bool) -> Graph:
    value = (lambda _: F.lit(1.0 / meta.vertices)) if ranks else None
    return Graph.build(read_id_list(spark, meta.vertex_file, value), read_edge_list(spark, meta.edge_file, undirected=not meta.directed))


def run(spark: SparkSession, meta: DatasetMeta, names: tuple[str, ...] = RUNS, wcc_supersteps: int = 50, rank_supersteps: int = 10, alpha: float = 0.85, out: str | None = None, partitions: int | None = None) -> dict[str, dict]:
    """A report for each name; a comparison that fails is in it as passed: false."""
    if not names or set(names) - set(RUNS):
        raise InvalidArgument(f"runs must be some of {RUNS}")
    reports = {}
    for name in names:
        truth = meta.truth_components if name == "wcc" else meta.truth_ranks
        if truth is None:
            raise InvalidArgument(f"no truth file for {name}")
        graph = load(spark, meta, name == "pagerank")
        done = components(graph, wcc_supersteps, partitions=partitions) if name == "wcc" else pagerank(graph, rank_supersteps, alpha, partitions=partitions)
        if out:
            dump_csv(done.vertices, f"{out}/{name}")
        report = verify_labels(done.vertices, read_truth(spark, truth)) if name == "wcc" else verify_ranks(done.vertices, read_truth(spark, truth, "double"))
        reports[name] = asdict(report) | {"executed": done.executed, "passed": report.passed}
    return reports
