"""General vertex programs in Python: messages may go to any id, and values may be of any type.

Each superstep is one Arrow-batched pass over (vertex, messages, edges) rows, whose tagged output,
new values and messages, is written once and read by tag. Function-local state of one
partition is not shared across supersteps, as tasks may run again elsewhere: what must last
belongs into the vertex value. `init` and `finish` run on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.storage import discard_table, durable
from .graph import Graph
from .supersteps import Hook, Run, Superstep


@dataclass
class Context:
    """What a vertex sees in one superstep."""

    id: Any
    value: Any
    edges: list[tuple[Any, Any]]
    iteration: int
    changed: bool = False
    sent: list[tuple[Any, Any]] = field(default_factory=list)

    def set_value(self, value: Any) -> None:
        self.value, self.changed = value, True

    def send(self, target: Any, message: Any) -> None:
        self.sent.append((target, message))


class VertexFunction:
    """Override `compute`; `init` and `finish` may set up and close what the driver holds."""

    def init(self) -> None: ...

    def compute(self, context: Context, messages: list) -> None:
        raise NotImplementedError

    def finish(self, executed: int) -> None: ...


def run_function(graph: Graph, function: VertexFunction, message_type: str, max_supersteps: int, resume: tuple[int, DataFrame] | None = None, hook: Hook | None = None, partitions: int | None = None) -> Run:
    """Every vertex computes in every superstep, until none sends or the bound is reached.

    `hook` sees each superstep's tagged table (id, value, message, changed: null in messages), which is what
    `resume` takes with its number. `partitions`: how many the vertices are dealt to.
    """
    if max_supersteps < 0:
        raise InvalidArgument("max_supersteps must not be negative")
    types = dict(graph.vertices.dtypes)
    adjacency = graph.vertices.select("id").join(graph.adjacency(), "id", "left")
    adjacency = durable(adjacency.repartition(partitions, "id") if partitions else adjacency, "adjacency")
    values, inbox, before, trace, k = graph.vertices, None, None, [], 0
    if resume is not None:
        k, given = resume
        values, inbox = _split(given)
    function.init()
    while k < max_supersteps:
        k += 1
        rows = values.join(adjacency, "id")
        if inbox is None:
            rows = rows.withColumn("messages", F.expr(f"cast(array() as array<{message_type}>)"))
        else:
            gathered = inbox.groupBy("id").agg(F.sort_array(F.collect_list("message")).alias("messages"))
            rows = rows.join(gathered, "id", "left")

        def step(batches: Iterator[pd.DataFrame], iteration: int = k) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for key, value, targets, messages in zip(batch["id"], batch["value"], batch["targets"], batch["messages"], strict=True):
                    edges = [] if targets is None else [(t["dst"], t["value"]) for t in targets]
                    context = Context(key, value, edges, iteration)
                    function.compute(context, [] if messages is None else list(messages))
                    out.append((key, context.value, None, context.changed))
                    out += [(target, None, message, None) for target, message in context.sent]
                yield pd.DataFrame(out, columns=["id", "value", "message", "changed"], dtype=object)

        schema = f"id {types['id']}, value {types['value']}, message {message_type}, changed boolean"
        tagged = durable(rows.select("id", "value", "targets", "messages").mapInPandas(step, schema), "tagged")
        values, inbox = _split(tagged)
        counts = tagged.agg(F.count_if("changed").alias("u"), F.count_if(F.col("changed").isNull()).alias("m")).first()
        trace.append(Superstep(k, counts["u"], counts["m"]))
        if before is not None:
            discard_table(before)
        before = tagged
        if hook:
            hook(k, tagged)
        if not counts["m"]:
            break
    function.finish(k)
    discard_table(adjacency)
    return Run(values, k, trace)


def _split(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values and messages of a superstep."""
    return tagged.filter(F.col("changed").isNotNull()).select("id", "value"), tagged.filter(F.col("changed").isNull()).select("id", "message")


class LeastLabel(VertexFunction):
    """Components, written as a general function."""

    def compute(self, context: Context, messages: list) -> None:
        if context.iteration == 1:
            context.set_value(context.id)
        elif messages and min(messages) < context.value:
            context.set_value(min(messages))
        else:
            return
        for target, _ in context.edges:
            context.send(target, context.value)
