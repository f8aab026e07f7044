"""Bounded bulk-synchronous supersteps over a graph, each one a plan.

A program is declarative: how a vertex starts, what it sends along an edge, how the messages
for a vertex are merged (an aggregate, so map tasks combine them before the shuffle), and
what becomes of its value. In superstep 1 vertices start and send; in each later one they take in
messages and, where they changed, send. Only vertices that changed enter the join with edges.
The run ends at the bound, or after the first superstep in which no vertex that fires has an
edge; edges to unknown targets count.

Edges are dealt by source once and kept with that partitioning, so each superstep shuffles the
changed vertices and the merged messages, not the edges. The edges of a hub, a source of more than
`hub_edges`, are dealt to as many salts as they fill, and the hub's one row is repeated for each of
them. Equal edges are kept once with their number, where the program says what that many equal
messages amount to. The state after a superstep is
written as a table in the shared folder: lineage stays short, and a lost executor costs the
current superstep at most. The counts that decide on the halt are observed by that write.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.storage import discard_table, durable
from .graph import Graph


@dataclass(frozen=True)
class VertexProgram:
    """Expressions over columns id, value, degree; dst, edge_value; msg (the merged message, null: none)."""

    name: str
    start: Callable[[], tuple[Column, Column]]  #: (value, fires) in superstep 1
    send: Callable[[], Column]  #: the message along an edge
    merge: Callable[[Column], Column]  #: an aggregate of column msg
    update: Callable[[], tuple[Column, Column]]  #: (value, fires) in later supersteps
    times: Callable[[Column, Column], Column] | None = None  #: what n messages equal to msg amount to; None: each is sent
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Superstep:
    iteration: int
    updates: int
    messages: int


@dataclass(frozen=True)
class Run:
    vertices: DataFrame
    executed: int
    trace: list[Superstep]


Hook = Callable[[int, DataFrame], None]
#: Edges of one source that lie together, at most about.
HUB_EDGES = 100_000


def _written(state: DataFrame, before: DataFrame | None) -> tuple[DataFrame, int, int]:
    """The state as a durable table, and how many vertices fired and messages they send."""
    seen = Observation()
    out = durable(state.observe(seen, F.count_if("fires").alias("updates"), F.coalesce(F.sum(F.when(F.col("fires"), F.col("degree"))), F.lit(0)).alias("messages")), "state")
    if before is not None:
        discard_table(before)
    got = seen.get
    return out, int(got["updates"]), int(got["messages"])


def _salts(degree: Column, hub_edges: int) -> Column:
    return F.ceil(degree / hub_edges)


def _dealt(graph: Graph, partitions: int, hub_edges: int, once: bool) -> DataFrame:
    """src, salt, dst, edge_value, copies; dealt by source and salt, and, with `once`, equal edges as one row."""
    hubs = graph.edges.groupBy("src").agg(F.count("*").alias("degree")).filter(F.col("degree") > hub_edges).select("src", _salts(F.col("degree"), hub_edges).alias("salts"))
    salted = graph.edges.select("src", "dst", F.col("value").alias("edge_value")).join(hubs, "src", "left")
    salted = salted.select("src", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("dst", "edge_value"), F.col("salts"))).cast("bigint").alias("salt"), "dst", "edge_value")
    if not once:
        return salted.withColumn("copies", F.lit(1).cast("bigint")).repartition(partitions, "src", "salt")
    # map tasks take equal edges together before they are dealt
    return salted.groupBy("src", "salt", "dst", "edge_value").agg(F.count("*").alias("copies")).repartition(partitions, "src", "salt")


def run_program(graph: Graph, program: VertexProgram, supersteps: int, resume: tuple[int, DataFrame] | None = None, hook: Hook | None = None, partitions: int | None = None, hub_edges: int = HUB_EDGES) -> Run:
    """At most `supersteps` supersteps. `resume`: a superstep and the state (id, value, degree, fires) after it. `hook` sees each state."""
    if supersteps < 0:
        raise InvalidArgument("supersteps must not be negative")
    spark = graph.vertices.sparkSession
    if supersteps == 0:
        return Run(graph.vertices, 0, [])
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = _dealt(graph, n, hub_edges, program.times is not None).persist(StorageLevel.MEMORY_AND_DISK)
    trace: list[Superstep] = []
    try:
        if resume is None:
            degrees = edges.groupBy(F.col("src").alias("id")).agg(F.sum("copies").alias("degree"))
            value, fires = program.start()
            first = graph.vertices.join(degrees, "id", "left").select("id", "value", F.coalesce("degree", F.lit(0)).alias("degree"))
            state, updates, messages = _written(first.select("id", value.alias("value"), "degree", fires.alias("fires")), None)
            iteration = 1
            trace.append(Superstep(1, updates, messages))
            if hook:
                hook(1, state)
        else:
            iteration, given = resume
            state, updates, messages = _written(given.select("id", "value", "degree", "fires"), None)
        while iteration < supersteps and messages:
            iteration += 1
            senders = state.filter(F.col("fires") & (F.col("degree") > 0)).select(F.col("id").alias("src"), "value", "degree", _salts(F.col("degree"), hub_edges).alias("salts"))
            senders = senders.withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)"))).drop("salts")
            met = edges.join(senders, ["src", "salt"]).withColumn("msg", program.send())
            sent = met.select(F.col("dst").alias("id"), (program.times(F.col("msg"), F.col("copies")) if program.times else F.col("msg")).alias("msg"))
            merged = sent.groupBy("id").agg(program.merge(F.col("msg")).alias("msg"))
            value, fires = program.update()
            joined = state.join(merged, "id", "left").select("id", value.alias("value"), "degree", fires.alias("fires"))
            state, updates, messages = _written(joined, state)
            trace.append(Superstep(iteration, updates, messages))
            if hook:
                hook(iteration, state)
        return Run(state.select("id", "value"), iteration, trace)
    finally:
        edges.unpersist()


def trace_frame(graph: Graph, run: Run) -> DataFrame:
    """iteration, updates, messages of each superstep."""
    return graph.vertices.sparkSession.createDataFrame([(s.iteration, s.updates, s.messages) for s in run.trace], "iteration bigint, updates bigint, messages bigint")
