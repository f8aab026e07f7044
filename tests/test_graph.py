"""Graph construction rules and the built-in programs, on hand-computed cases."""

import pytest

from vertexloom.errors import InvalidArgument
from vertexloom.operators.algorithms import components, pagerank, registered, shortest_paths
from vertexloom.operators.graph import Graph
from vertexloom.operators.vertex_functions import LeastLabel, VertexFunction, run_function

PATH3 = ([(1, 1), (2, 2), (3, 3)], [(1, 2, 0), (2, 1, 0), (2, 3, 0), (3, 2, 0)])


def values(run):
    return {r["id"]: r["value"] for r in run.vertices.collect()}


@pytest.mark.parametrize("n, want, executed", [(0, [1, 2, 3], 0), (1, [1, 2, 3], 1), (2, [1, 1, 2], 2), (3, [1, 1, 1], 3), (10, [1, 1, 1], 4)])
def test_components_of_a_path(spark, n, want, executed):
    run = components(Graph.of(spark, *PATH3), n)
    assert values(run) == dict(zip([1, 2, 3], want, strict=True))
    assert run.executed == executed


def test_components_follow_edges_and_ignore_values(spark):
    vertices = [(1, 7), (2, 7), (3, 7)]
    up = components(Graph.of(spark, vertices, [(1, 2, 0), (2, 3, 0)]), 10)
    assert (values(up), up.executed) == ({1: 1, 2: 1, 3: 1}, 3)
    down = components(Graph.of(spark, vertices, [(3, 2, 0), (2, 1, 0)]), 10)
    assert (values(down), down.executed) == ({1: 1, 2: 2, 3: 3}, 2)
    both = components(Graph.of(spark, vertices, [(3, 2, 0), (2, 1, 0)]), 10, undirected=True)
    assert values(both) == {1: 1, 2: 1, 3: 1}


DANGLING = ([(1, 1.0), (2, 1.0), (3, 1.0)], [(1, 2, 0), (1, 3, 0), (2, 3, 0), (1, 99, 0)])


@pytest.mark.parametrize("n, want", [(1, [1, 1, 1]), (2, [0.15, 0.433333333, 1.283333333]), (3, [0.15, 0.1925, 0.560833333]), (10, [0.15, 0.1925, 0.356125])])
def test_rank_with_a_dangling_edge(spark, n, want):
    run = pagerank(Graph.of(spark, *DANGLING, value_type="double"), n)
    assert list(dict(sorted(values(run).items())).values()) == pytest.approx(want, abs=1e-8)
    assert run.executed == n


@pytest.mark.parametrize(
    "vertices, edges, n, want, executed",
    [
        ([(1, 1.0), (2, 1.0)], [(1, 2, 0), (2, 1, 0)], 3, [1, 1], 3),
        ([(1, 1.0), (2, 1.0)], [(1, 2, 0), (1, 2, 0), (1, 1, 0), (2, 1, 0)], 3, [1.122777778, 0.877222222], 3),
        ([(1, 1.0), (2, 1.0)], [], 10, [1, 1], 1),
        ([(i, 0.25) for i in range(1, 5)], [(1, 2, 0), (2, 1, 0), (3, 4, 0)], 3, [0.25, 0.25, 0.0375, 0.069375], 3),
    ],
)
def test_rank_cases(spark, vertices, edges, n, want, executed):
    run = pagerank(Graph.of(spark, vertices, edges, value_type="double"), n)
    assert list(dict(sorted(values(run).items())).values()) == pytest.approx(want, abs=1e-8)
    assert run.executed == executed


SSSP3 = ([(i, 2147483647) for i in (1, 2, 3)], [(1, 2, 10), (2, 3, 20), (1, 3, 100)])


@pytest.mark.parametrize("n, want", [(1, [0, 2147483647, 2147483647]), (2, [0, 10, 100]), (3, [0, 10, 30])])
def test_shortest_paths(spark, n, want):
    run = shortest_paths(Graph.of(spark, *SSSP3), 1, n)
    assert list(dict(sorted(values(run).items())).values()) == want


def test_shortest_paths_run_to_the_end(spark):
    run = shortest_paths(Graph.of(spark, *SSSP3), 1)
    assert (values(run), run.executed) == ({1: 0, 2: 10, 3: 30}, 3)


def test_keys_and_bags(spark):
    graph = Graph.of(spark, [(1, 5), (1, 9)], [(1, 2, 0), (1, 2, 0), (8, 1, 0)])
    assert [tuple(r) for r in graph.vertices.collect()] == [(1, 9)]
    assert graph.edges.count() == 2  # the orphan source goes, multi-edges stay
    assert [tuple(r) for r in graph.out_degrees().collect()] == [(1, 2)]
    assert graph.dangling_edges().count() == 2
    assert Graph.of(spark, [(1, 1)], [(1, 1, 0)]).undirected().edges.count() == 2


def test_partition_count_does_not_matter(spark):
    graph = Graph.of(spark, *PATH3)
    assert values(components(graph.partitioned(3), 10, partitions=2)) == values(components(graph, 10, partitions=7))


def test_general_function_equals_declarative_program(spark):
    graph = Graph.of(spark, *PATH3)
    run = run_function(graph, LeastLabel(), "bigint", 10)
    assert (values(run), run.executed) == ({1: 1, 2: 1, 3: 1}, components(graph, 10).executed)


def test_messages_reach_any_vertex(spark):
    class Mail(VertexFunction):
        """Everyone writes to vertex 3, a neighbour or not; unknown targets are dropped."""

        def compute(self, context, messages):
            if context.iteration == 1:
                context.send(3, context.id)
                context.send(77, 0)
            elif messages:
                context.set_value(sum(messages))

    assert values(run_function(Graph.of(spark, *PATH3), Mail(), "bigint", 5)) == {1: 1, 2: 2, 3: 6}


def test_bad_arguments(spark):
    with pytest.raises(InvalidArgument):
        components(Graph.of(spark, *PATH3), -1)
    with pytest.raises(InvalidArgument):
        registered("nothing")


def yardstick(vertices, edges, n):
    """Least labels by plain supersteps."""
    state, inbox, done = {v: v for v in vertices}, {}, 0
    for k in range(1, n + 1):
        done, out = k, []
        for v in vertices:
            if k == 1:
                send = True
            else:
                best = min(inbox.get(v, [state[v]]))
                send = best < state[v]
                state[v] = min(state[v], best)
            if send:
                out += [(d, state[v]) for s, d in edges if s == v]
        if not out:
            break
        inbox = {}
        for d, m in out:
            inbox.setdefault(d, []).append(m)
    return state, done


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    import random

    rng = random.Random(seed)
    vertices = rng.sample(range(12), 8)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(14)]
    n = rng.randrange(1, 7)
    run = components(Graph.of(spark, [(v, 0) for v in vertices], [(s, d, 0) for s, d in edges]), n)
    assert (values(run), run.executed) == yardstick(vertices, edges, n)


def test_queries_over_all_lines(spark, tmp_path):
    """Brute force over tables whose lines have unequal quantities."""
    import random

    from vertexloom.queries import QUERIES

    rng = random.Random(5)
    orders = [(o, rng.randrange(8)) for o in range(25)]
    lines = [(rng.randrange(25), rng.randrange(6), float(rng.randrange(1, 51))) for _ in range(30)]
    tables = {"customer": ([(c,) for c in range(9)], "c_custkey bigint"), "supplier": ([(k,) for k in range(7)], "s_suppkey bigint"), "orders": (orders, "o_orderkey bigint, o_custkey bigint"), "lineitem": (lines, "l_orderkey bigint, l_suppkey bigint, l_quantity double")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    ids = [2 * c for c in range(9)] + [2 * k + 1 for k in range(7)]
    pairs = [(2 * dict(orders)[o], 2 * k + 1, int(w)) for o, k, w in lines]
    edges = pairs + [(d, s, w) for s, d, w in pairs]

    def relaxed(weight):
        far = {v: 2147483647 for v in ids} | {min(s for s, _, _ in edges): 0}
        for _ in ids:
            for s, d, w in edges:
                if far[s] < 2147483647:
                    far[d] = min(far[d], far[s] + weight(w))
        return far

    def got(name):
        return {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()}

    assert got("out_degree") == {(v, n) for v in ids if (n := sum(s == v for s, _, _ in edges))}
    assert got("adjacency") == {(v, ",".join(f"{d}:{w}" for d, w in out)) for v in ids if (out := sorted((d, w) for s, d, w in edges if s == v))}
    assert got("wcc_customer_supplier") == set(yardstick(ids, [e[:2] for e in edges], 50)[0].items())
    assert got("sssp_weighted") == set(relaxed(lambda w: w).items())
    assert got("bfs_hops") == {(v, n) for v, n in relaxed(lambda w: 1).items() if n < 2147483647}
    rank = dict.fromkeys(ids, 1.0)
    for _ in range(9):
        rank = {v: 0.15 + 0.85 * sum(rank[s] / sum(a == s for a, _, _ in edges) for s, d, _ in edges if d == v) for v in ids}
    assert dict(got("pagerank_customer_supplier")) == pytest.approx(rank, abs=2e-6)
