"""Storage, buckets of the state, hubs, parallel edges, user programs, environments and lost workers."""

import os
import signal
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from vertexloom.errors import InvalidArgument, StorageError
from vertexloom.functions import storage
from vertexloom.operators import algorithms
from vertexloom.operators.algorithms import components, pagerank, register, shortest_paths
from vertexloom.operators.graph import Graph
from vertexloom.operators.state import GraphState
from vertexloom.operators.supersteps import VertexProgram, _dealt
from vertexloom.operators.vertex_functions import LeastLabel, VertexFunction, run_function
from vertexloom.plans.jobs import Environment, Pipeline, ensure_local


def values(run):
    return {r["id"]: r["value"] for r in run.vertices.collect()}


def test_a_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(StorageError):
        storage.shared_folder(Session())
    Session.sparkContext.master = "local[4]"
    assert storage.shared_folder(Session()).startswith("file:")


def test_small_files_are_replaced_and_tables_removed(spark, tmp_path):
    path = f"file://{tmp_path}/a/b.json"
    for text in ("one", "two"):
        storage.write_text(spark, path, text)
        assert storage.read_text(spark, path) == text
    assert sorted(p for p in os.listdir(tmp_path / "a") if not p.startswith(".")) == ["b.json"]
    table = storage.durable(spark.range(3))
    assert table.count() == 3
    storage.discard_table(table)
    storage.discard_table(spark.range(3))


def test_upserts_rewrite_only_touched_buckets(spark, tmp_path):
    state = GraphState(spark, f"file://{tmp_path}/s", buckets=8)
    state.put_vertices(spark.range(200).select("id", F.col("id").alias("value")))
    before = state._current()["vertices"]
    state.put_vertices(spark.createDataFrame([(5, 50), (5, 51), (900, 1)], "id bigint, value bigint").coalesce(1))
    after = state._current()["vertices"]
    assert 1 <= sum(before.get(b) != after[b] for b in after) <= 2
    rows = {r["id"]: r["value"] for r in state.list_vertices().collect()}
    assert len(rows) == 201 and state.list_vertices().count() == 201
    assert (rows[5], rows[900], rows[7]) == (51, 1, 7) and state.get_vertex(5) == 51 and state.get_vertex(1000) is None
    state.put_vertices(spark.createDataFrame([], "id bigint, value bigint"))
    assert state.list_vertices().count() == 201


def test_a_hub_is_dealt_to_partitions(spark):
    star = [(0, i, 1) for i in range(1, 401)] + [(i, 0, 1) for i in range(1, 401)] + [(0, 1, 1)] * 50
    graph = Graph.of(spark, [(i, i) for i in range(401)], star)
    dealt = _dealt(graph, 16, 50, True)
    parts = {r["p"] for r in dealt.filter("src = 0").select(F.spark_partition_id().alias("p")).distinct().collect()}
    assert len(parts) >= 4 and dealt.count() == 800 and dealt.agg(F.sum("copies")).first()[0] == 850
    assert set(values(components(graph, 10, hub_edges=50)).values()) == {0}
    flat, split = (values(pagerank(graph, 5, hub_edges=n)) for n in (10**6, 50))
    assert all(abs(flat[i] - split[i]) < 1e-9 for i in flat)
    assert values(shortest_paths(graph, 5, hub_edges=50))[7] == 2


def test_a_bag_of_edges_for_programs_without_times(spark):
    program = replace(algorithms.rank_program(0.85, 0.15), times=None)
    edges = [(1, 2, 0)] * 3 + [(1, 1, 0), (2, 1, 0)]
    graph = Graph.of(spark, [(1, 1.0), (2, 1.0)], edges, value_type="double")
    each, once = values(algorithms.run_program(graph, program, 4)), values(pagerank(graph, 4, 0.85, 0.15))
    assert each == pytest.approx(once)


def test_distances_beyond_the_sentinel(spark):
    graph = Graph.of(spark, [(1, 0), (2, 0), (3, 0), (4, 0)], [(1, 2, 2_000_000_000), (2, 3, 2_000_000_000)])
    assert values(shortest_paths(graph, 1)) == {1: 0, 2: 2_000_000_000, 3: 4_000_000_000, 4: 2147483647}


def test_user_programs(spark):
    program = VertexProgram("test_greatest", lambda: (F.col("id"), F.lit(True)), lambda: F.col("value"), F.max, lambda: (F.greatest("value", "msg"), F.coalesce(F.col("msg") > F.col("value"), F.lit(False))))
    register(program.name, program)
    with pytest.raises(InvalidArgument):
        register("WCC", program)
    graph = Graph.of(spark, [(1, 0), (2, 0), (3, 0)], [(3, 2, 0), (2, 1, 0)])
    assert values(algorithms.registered("TEST_greatest")(graph, supersteps=5)) == {1: 3, 2: 3, 3: 3}
    del algorithms.REGISTRY["test_greatest"]


def test_a_vertex_function_goes_on_from_a_checkpoint(spark):
    graph = Graph.of(spark, [(i, i) for i in range(6)], [(i, i + 1, 0) for i in range(5)])
    kept = {}
    run_function(graph, LeastLabel(), "bigint", 3, hook=lambda k, t: kept.update({k: storage.durable(t)}))
    again = run_function(graph, LeastLabel(), "bigint", 20, resume=(3, kept[3]), partitions=2)
    assert set(values(again).values()) == {0} and again.trace[0].iteration == 4


def test_environments(spark):
    ensure_local(Environment.local())
    with pytest.raises(InvalidArgument):
        ensure_local(Environment.distributed())
    with pytest.raises(InvalidArgument):
        Environment("elsewhere")
    assert Pipeline(spark, "distributed").mode == "distributed"


class Dies(VertexFunction):
    """The worker that holds vertex 2 is killed in superstep 2; in local mode a task is not tried again."""

    def compute(self, context, messages):
        if context.iteration == 2 and context.id == 2:
            os.kill(os.getpid(), signal.SIGKILL)
        LeastLabel().compute(context, messages)


def test_a_lost_worker_is_an_error_and_no_wrong_result(spark):
    graph = Graph.of(spark, [(i, i) for i in range(4)], [(i, i + 1, 0) for i in range(3)])
    with pytest.raises(Exception, match="(?i)worker|EOF|crash"):
        run_function(graph, Dies(), "bigint", 5)
    assert set(values(run_function(graph, LeastLabel(), "bigint", 10)).values()) == {0}
