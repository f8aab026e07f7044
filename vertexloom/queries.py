"""Registered queries of the graph engine, and the SQL that they are held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.storage import durable, own_folder
from .operators.algorithms import components, default_teleport, pagerank, shortest_paths
from .operators.graph import Graph, last_wins, orphan_edges
from .operators.state import Checkpoints, GraphState
from .operators.supersteps import trace_frame
from .operators.verify import label_differences, rank_differences
from .operators.vertex_functions import LeastLabel, run_function
from .streaming.bounded import Stream, TumblingCount
from .streaming.unbounded import session_windows, time_windows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers have even ids, suppliers odd ones."""
    c = _table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("id"))
    s = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id"))
    return c.unionAll(s).withColumn("value", F.col("id"))


def trade_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from customer to supplier for each line, weighted by quantity."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lines.join(orders, "l_orderkey").select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"), F.col("l_quantity").cast("bigint").alias("value"))


def trade_graph(spark: SparkSession, sf_dir: str, both: bool = True) -> Graph:
    pairs = trade_pairs(spark, sf_dir)
    if both:
        pairs = pairs.unionAll(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "value"))
    return Graph.build(trade_vertices(spark, sf_dir), durable(pairs, "trade"))


def ring_graph(spark: SparkSession, sf_dir: str, step: int | None, value: float = 1.0) -> Graph:
    """Customers, and an edge from each to the one `step` further on, which may not exist; none where step is None."""
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    edges = customers.select(F.col("id").alias("src"), (F.col("id") + (step or 0)).alias("dst")).filter(F.lit(step is not None))
    return Graph.build(customers.withColumn("value", F.lit(value)), edges)


V = "v AS (SELECT c_custkey * 2 AS id FROM customer UNION ALL SELECT s_suppkey * 2 + 1 FROM supplier)"
P = "p AS (SELECT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst, CAST(l_quantity AS BIGINT) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
E = "e AS (SELECT src, dst, w FROM p UNION ALL SELECT dst, src, w FROM p)"
E1 = "e AS (SELECT src, dst, w FROM p)"


def _labels_sql(edges: str, n: int) -> str:
    return f"""r(it, id, c) AS (
  SELECT 1, id, id FROM v
  UNION ALL
  SELECT it + 1, x.id, least(x.c, coalesce(m.c, x.c)) FROM (SELECT any_value(r.it) OVER () AS it, id, c FROM r) x
  LEFT JOIN (SELECT e.dst, min(r.c) AS c FROM r JOIN e ON r.id = e.src GROUP BY e.dst) m ON m.dst = x.id WHERE x.it < {n}
)"""


def _labels(edges: str, n: int) -> str:
    return f"WITH RECURSIVE {V}, {P}, {edges}, {_labels_sql(edges, n)}, w AS (SELECT id, c AS component FROM r WHERE it = {n})"


def _ranks(v: str, e: str, n: int, init: str = "1.0", teleport: str = "0.15") -> str:
    return f"""WITH RECURSIVE {v}, {e}, d AS (SELECT src, count(*) AS d FROM e WHERE src IN (SELECT id FROM v) GROUP BY src), r(it, id, x) AS (
  SELECT 1, id, CAST({init} AS DOUBLE) FROM v
  UNION ALL
  SELECT it + 1, y.id, 0.85 * coalesce(m.x, 0.0) + {teleport} FROM (SELECT any_value(r.it) OVER () AS it, id FROM r) y
  LEFT JOIN (SELECT e.dst, sum(r.x / d.d) AS x FROM r JOIN d ON d.src = r.id JOIN e ON e.src = r.id GROUP BY e.dst) m ON m.dst = y.id WHERE y.it < {n}
), w AS (SELECT id, x FROM r WHERE it = {n})"""


def _distances(n: int) -> str:
    return f"""WITH RECURSIVE {V}, {P}, {E}, r(it, id, d) AS (
  SELECT 1, id, CASE WHEN id = (SELECT min(src) FROM e) THEN 0 ELSE 2147483647 END FROM v
  UNION ALL
  SELECT it + 1, x.id, least(x.d, coalesce(m.d, x.d)) FROM (SELECT any_value(r.it) OVER () AS it, id, d FROM r) x
  LEFT JOIN (SELECT e.dst, min(r.d + e.w) AS d FROM r JOIN e ON r.id = e.src WHERE r.d < 2147483647 GROUP BY e.dst) m ON m.dst = x.id WHERE x.it < {n}
), w AS (SELECT id, CAST(d AS BIGINT) AS distance FROM r WHERE it = {n})"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return register


@query(_labels(E, 50) + " SELECT id, component FROM w")
def wcc_customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(trade_graph(spark, sf_dir), 50).vertices.withColumnRenamed("value", "component")


@query(_labels(E1, 3) + " SELECT id, component FROM w")
def wcc_directed_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(trade_graph(spark, sf_dir, both=False), 3).vertices.withColumnRenamed("value", "component")


@query(_labels(E, 50) + " SELECT component, count(*) AS members FROM w GROUP BY component")
def wcc_component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(trade_graph(spark, sf_dir, both=False), 50, undirected=True).vertices
    return found.groupBy(F.col("value").alias("component")).agg(F.count("*").alias("members"))


def _rounded(vertices: DataFrame) -> DataFrame:
    return vertices.select("id", F.round("value", 6).alias("rank"))


@query(_ranks(f"{V}, {P}", E, 10) + " SELECT id, round(x, 6) AS rank FROM w")
def pagerank_customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = trade_graph(spark, sf_dir)
    return _rounded(pagerank(graph.with_values(graph.vertices.withColumn("value", F.lit(1.0))), 10).vertices)


NATIONS = "v AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation)"
RING = "v AS (SELECT c_custkey AS id FROM customer)"
TRADE = "e AS (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"


@query(_ranks(NATIONS, TRADE, 10) + " SELECT id, round(x, 6) AS rank FROM w")
def pagerank_nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is an edge between nations: a bag of edges."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customers = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("src"))
    suppliers = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("dst"))
    edges = lines.join(orders, "l_orderkey").join(customers, "c_custkey").join(suppliers, "l_suppkey").select("src", "dst")
    return _rounded(pagerank(Graph.build(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.lit(1.0).alias("value")), edges), 10).vertices)


@query(_ranks(RING, "e AS (SELECT id AS src, id + 7 AS dst FROM v)", 6) + " SELECT id, round(x, 6) AS rank FROM w")
def pagerank_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pagerank(ring_graph(spark, sf_dir, 7), 6).vertices)


@query(f"WITH {RING} SELECT id, CAST(1.0 AS DOUBLE) AS rank FROM v")
def pagerank_no_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pagerank(ring_graph(spark, sf_dir, None), 10).vertices)


@query(_ranks(RING, "e AS (SELECT id AS src, id + 3 AS dst FROM v)", 5, "0.04", "0.15 * 0.04") + " SELECT id, round(x, 6) AS rank FROM w")
def pagerank_uniform_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pagerank(ring_graph(spark, sf_dir, 3, 0.04), 5).vertices)


def _from_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = trade_graph(spark, sf_dir)
    return shortest_paths(graph, graph.edges.agg(F.min("src")).first()[0]).vertices


@query(_distances(16) + " SELECT id, distance FROM w")
def sssp_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_first(spark, sf_dir).withColumnRenamed("value", "distance")


@query(f"WITH {RING} SELECT id % 7 = 0 AND id <= 7 * 11 AS reached, count(*) AS vertices FROM v GROUP BY 1")
def sssp_unreached_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Along rings of customers, 12 supersteps far."""
    found = shortest_paths(ring_graph(spark, sf_dir, 7), 0, 12).vertices
    return found.groupBy((F.col("value") < 2147483647).alias("reached")).agg(F.count("*").alias("vertices"))


@query(f"WITH {RING} SELECT id, greatest(id - 7 * 11, id % 7) AS component FROM v")
def wcc_ring_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long paths: 12 supersteps carry a label over 11 edges."""
    return components(ring_graph(spark, sf_dir, 7), 12).vertices.withColumnRenamed("value", "component")


@query(f"WITH {P}, {E} SELECT src AS id, count(*) AS degree FROM e GROUP BY src")
def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_graph(spark, sf_dir).out_degrees()


@query(f"WITH {P}, {E} SELECT src AS id, string_agg(dst || ':' || w, ',' ORDER BY dst, w) AS targets FROM e GROUP BY src")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = trade_graph(spark, sf_dir).adjacency()
    return listed.select("id", F.array_join(F.transform("targets", lambda t: F.concat_ws(":", t["dst"].cast("string"), t["value"].cast("string"))), ",").alias("targets"))


@query("SELECT o_custkey AS id, max_by(o_totalprice, o_orderkey) AS value FROM orders GROUP BY o_custkey")
def vertex_dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return last_wins(orders.select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("ordinal")))


@query(f"WITH {RING} SELECT id AS src, id + 7 AS dst FROM v WHERE id + 7 NOT IN (SELECT id FROM v)")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_graph(spark, sf_dir, 7).dangling_edges().select("src", "dst")


@query("SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)")
def orphan_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices = _table(spark, sf_dir, "supplier").filter("s_acctbal >= 0").select(F.col("s_suppkey").alias("id"))
    return orphan_edges(vertices, _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))).select("src", "dst")


@query("WITH e AS (SELECT o_custkey AS src, o_orderkey AS dst FROM orders) SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e WHERE dst IN (SELECT src FROM e)")
def undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    vertices = edges.select(F.col("src").alias("id"), F.lit(0).alias("value")).distinct()
    return Graph.build(vertices, edges).undirected().edges.select("src", "dst")


def _perturbed(rows: DataFrame, changed) -> DataFrame:
    """Every 7th id goes, every 11th has another value, every 13th stands under an id of its own."""
    kept = rows.filter("id % 7 != 0").withColumn("value", F.when(F.col("id") % 11 == 0, changed(F.col("value"))).otherwise(F.col("value")))
    return kept.withColumn("id", F.when(F.col("id") % 13 == 0, -F.col("id") - 1).otherwise(F.col("id")))


PERTURBED = """, q AS (SELECT CASE WHEN id % 13 = 0 THEN -id - 1 ELSE id END AS id, CASE WHEN id % 11 = 0 THEN {changed} ELSE {value} END AS value FROM w WHERE id % 7 <> 0),
j AS (SELECT q.id AS a, w.id AS b, q.value, w.{value} AS expected FROM q FULL JOIN w ON q.id = w.id)"""


@query(_labels(E, 50) + PERTURBED.format(changed="component + 1", value="component") + " SELECT count(a) AS total, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND value <> expected) AS mismatches, count(*) FILTER (WHERE b IS NULL) AS unexpected, count(*) FILTER (WHERE a IS NULL) AS missing FROM j")
def verify_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = components(trade_graph(spark, sf_dir), 50).vertices
    return label_differences(_perturbed(truth, lambda v: v + 1), truth)


@query(_ranks(f"{V}, {P}", E, 10) + PERTURBED.format(changed="x + 0.25", value="x") + " SELECT count(a) AS total, count(*) FILTER (WHERE b IS NULL) AS unexpected, count(*) FILTER (WHERE a IS NULL) AS missing, round(max(abs(value - expected)), 6) AS max_abs_diff, round(sum(abs(value - expected)), 6) AS l1 FROM j")
def verify_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = trade_graph(spark, sf_dir)
    truth = pagerank(graph.with_values(graph.vertices.withColumn("value", F.lit(1.0))), 10).vertices
    out = rank_differences(_perturbed(truth, lambda v: v + 0.25), truth)
    return out.withColumns({c: F.round(c, 6) for c in ("max_abs_diff", "l1")})


@query(f"""WITH RECURSIVE {V}, {P}, {E}, d AS (SELECT src, count(*) AS d FROM e GROUP BY src), r(it, id, c, ch) AS (
  SELECT 1, id, id, true FROM v
  UNION ALL
  SELECT it + 1, x.id, least(x.c, coalesce(m.c, x.c)), coalesce(m.c < x.c, false) FROM (SELECT any_value(r.it) OVER () AS it, id, c FROM r) x
  LEFT JOIN (SELECT e.dst, min(r.c) AS c FROM r JOIN e ON r.id = e.src WHERE r.ch GROUP BY e.dst) m ON m.dst = x.id WHERE x.it < 50
), t AS (SELECT it AS iteration, count(*) FILTER (WHERE ch) AS updates, CAST(coalesce(sum(d.d) FILTER (WHERE ch), 0) AS BIGINT) AS messages FROM r LEFT JOIN d ON d.src = r.id GROUP BY it)
SELECT CAST(iteration AS BIGINT) AS iteration, updates, messages FROM t WHERE iteration <= (SELECT min(iteration) FROM t WHERE messages = 0)""")
def superstep_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = trade_graph(spark, sf_dir)
    return trace_frame(graph, components(graph, 50))


@query(f"""WITH RECURSIVE {V}, {P}, {E}, r(it, id, h) AS (
  SELECT 1, id, CASE WHEN id = (SELECT min(src) FROM e) THEN 0 ELSE 2147483647 END FROM v
  UNION ALL
  SELECT it + 1, x.id, least(x.h, coalesce(m.h, x.h)) FROM (SELECT any_value(r.it) OVER () AS it, id, h FROM r) x
  LEFT JOIN (SELECT e.dst, min(r.h + 1) AS h FROM r JOIN e ON r.id = e.src WHERE r.h < 2147483647 GROUP BY e.dst) m ON m.dst = x.id WHERE x.it < 12
) SELECT id, CAST(h AS BIGINT) AS hops FROM r WHERE it = 12 AND h < 2147483647""")
def bfs_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = trade_graph(spark, sf_dir)
    even = Graph(graph.vertices, graph.edges.withColumn("value", F.lit(1).cast("bigint")))
    found = shortest_paths(even, graph.edges.agg(F.min("src")).first()[0], 12).vertices
    return found.filter("value < 2147483647").withColumnRenamed("value", "hops")


@query("SELECT event_id, round(value * 10, 6) AS value FROM events WHERE value * 10 >= 300")
def stream_map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Stream.from_table(_table(spark, sf_dir, "events"), "value", "event_id").map(lambda v: v * 10).filter(lambda v: v >= 300).rows
    return rows.select(F.col("ordinal").alias("event_id"), F.round("value", 6).alias("value"))


@query('SELECT w AS "window", count(*) AS n, min(event_id) AS first, max(event_id) AS last, round(sum(value), 4) AS total FROM (SELECT CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 64) AS BIGINT) AS w, event_id, value FROM events) GROUP BY w')
def stream_count_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = Stream.from_table(_table(spark, sf_dir, "events"), "value", "event_id").window(TumblingCount(64)).numbered()
    return numbered.groupBy("window").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def event_time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: windows by time."""
    out = time_windows(_table(spark, sf_dir, "events"), "ts", "1 hour", keys=("event_type",), aggregates=(F.count("*").alias("n"),))
    return out.select("event_type", F.col("window.start").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: windows by gaps."""
    out = session_windows(_table(spark, sf_dir, "events"), "ts", "30 minutes", ("user_id",), aggregates=(F.count("*").alias("n"),))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS live, c_acctbal AS saved FROM customer")
def state_upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    base = f"{own_folder(spark)}/state-{uuid.uuid4().hex}"
    state = GraphState(spark, f"{base}/live", value_type="double")
    state.put_vertices(rows)
    saved = state.snapshot(f"{base}/saved")
    state.put_vertices(rows.filter("id % 10 = 0").withColumn("value", F.col("value") + 1))
    live = state.list_vertices().withColumnRenamed("value", "live")
    return live.join(saved.list_vertices().withColumnRenamed("value", "saved"), "id")


@query(ORACLES["wcc_customer_supplier"])
def vertex_function_wcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general Python form of the components program."""
    return run_function(trade_graph(spark, sf_dir), LeastLabel(), "bigint", 50).vertices.withColumnRenamed("value", "component")


@query(ORACLES["pagerank_customer_supplier"])
def resume_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stopped after superstep 4 and resumed from its checkpoint, over other partitions."""
    graph = trade_graph(spark, sf_dir)
    graph = graph.with_values(graph.vertices.withColumn("value", F.lit(1.0)))
    teleport = default_teleport(graph, 0.85)
    points = Checkpoints(spark, own_folder(spark), f"job-{uuid.uuid4().hex}", "pagerank", {"alpha": 0.85, "teleport": teleport}, 2)
    pagerank(graph, 4, 0.85, teleport, hook=points.hook, partitions=3)
    return _rounded(pagerank(graph, 10, 0.85, teleport, resume=points.latest(), partitions=5).vertices)
