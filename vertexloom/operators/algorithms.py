"""Built-in vertex programs: components by least labels, PageRank, weighted shortest paths."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import functions as F

from ..errors import InvalidArgument
from .graph import Graph
from .supersteps import Hook, Run, VertexProgram, run_program


def component_program() -> VertexProgram:
    """The value becomes the least id that reaches the vertex; the value as read is ignored."""
    better = F.col("msg") < F.col("value")
    return VertexProgram(
        "wcc",
        start=lambda: (F.col("id"), F.lit(True)),
        send=lambda: F.col("value"),
        merge=F.min,
        update=lambda: (F.least("value", "msg"), F.coalesce(better, F.lit(False))),
        times=lambda msg, _: msg,
    )


def components(graph: Graph, supersteps: int = 10, undirected: bool = False, **options) -> Run:
    """After n supersteps, the least id over paths of n - 1 edges at most, along their direction unless `undirected`."""
    return run_program(graph.undirected() if undirected else graph, component_program(), supersteps, **options)


def rank_program(alpha: float, teleport: float) -> VertexProgram:
    rank = F.lit(alpha) * F.coalesce("msg", F.lit(0.0)) + F.lit(teleport)
    return VertexProgram(
        "pagerank",
        start=lambda: (F.col("value"), F.lit(True)),
        send=lambda: F.col("value") / F.col("degree"),
        merge=F.sum,
        update=lambda: (rank, F.lit(True)),
        params={"alpha": alpha, "teleport": teleport},
        times=lambda msg, n: msg * n,
    )


def default_teleport(graph: Graph, alpha: float) -> float:
    """(1 - alpha) times the initial value, that of the least id with a positive one where they differ; 1 - alpha where none is positive."""
    positive = graph.vertices.filter("value > 0").agg(F.min_by("value", "id")).first()[0]
    return (1 - alpha) * (1.0 if positive is None else float(positive))


def pagerank(graph: Graph, supersteps: int = 10, alpha: float = 0.85, teleport: float | None = None, **options) -> Run:
    """n supersteps are n - 1 rank updates; mass sent to unknown targets is lost; without any edge the initial values stay."""
    if not 0 <= alpha <= 1:
        raise InvalidArgument("alpha must lie in 0..1")
    graph = graph.with_values(graph.vertices.select("id", F.col("value").cast("double").alias("value")))
    return run_program(graph, rank_program(alpha, default_teleport(graph, alpha) if teleport is None else teleport), supersteps, **options)


def distance_program(source) -> VertexProgram:
    better = F.col("msg") < F.col("value")
    is_source = F.col("id") == F.lit(source)
    return VertexProgram(
        "sssp",
        start=lambda: (F.when(is_source, F.lit(0)).otherwise(F.col("value")), is_source),
        send=lambda: F.col("value") + F.col("edge_value"),
        merge=F.min,
        update=lambda: (F.least("value", "msg"), F.coalesce(better, F.lit(False))),
        params={"source": source},
        times=lambda msg, _: msg,
    )


#: What stands for "not reached" in results unless the caller gives another value.
UNREACHED = 2147483647
#: What stands for it within a run, so that every distance of the type counts.
FARTHEST = {"bigint": (1 << 63) - 1, "int": (1 << 31) - 1, "double": float("inf"), "float": float("inf")}


def shortest_paths(graph: Graph, source, max_supersteps: int = 1000, unreached: int | float | None = UNREACHED, **options) -> Run:
    """Least sums of edge values from `source`. With `unreached` None, values as read stand for it."""
    if unreached is not None:
        far = FARTHEST["bigint" if isinstance(unreached, int) else "double"]
        graph = graph.with_values(graph.vertices.select("id", F.lit(far).cast("bigint" if isinstance(unreached, int) else "double").alias("value")))
    kind = dict(graph.vertices.dtypes)["value"]
    program = distance_program(source)
    typed = replace(program, start=lambda: (program.start()[0].cast(kind), program.start()[1]), send=lambda: program.send().cast(kind))
    run = run_program(graph, typed, max_supersteps, **options)
    if unreached is None:
        return run
    return replace(run, vertices=run.vertices.withColumn("value", F.when(F.col("value") == F.lit(far), F.lit(unreached)).otherwise(F.col("value")).cast(kind)))


#: Programs that jobs name: (graph, supersteps, parameters, options) to a run.
REGISTRY: dict[str, Callable[..., Run]] = {"wcc": components, "pagerank": pagerank, "sssp": shortest_paths}


def register(name: str, program: Callable[..., Run] | VertexProgram) -> None:
    """Makes a user's program known to jobs: a function (graph, supersteps, **options) to a run, or a vertex program."""
    if name.lower() in REGISTRY:
        raise InvalidArgument(f"there is an algorithm {name!r} already")
    REGISTRY[name.lower()] = program if not isinstance(program, VertexProgram) else lambda graph, supersteps=10, **options: run_program(graph, program, supersteps, **options)


def registered(name: str) -> Callable[..., Run]:
    if name.lower() not in REGISTRY:
        raise InvalidArgument(f"unknown algorithm {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name.lower()]


__all__ = ["Hook", "components", "pagerank", "register", "registered", "shortest_paths"]
