"""Registered queries of sources, sinks, streams, state, jobs and the dataset suite, and their SQL.

Text inputs are made from tables, in this application's part of the shared folder, and read back.
"""

from __future__ import annotations

import contextlib
import io
import json
import socket
import tarfile
import tempfile
import threading
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable
from pathlib import Path

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.parsing import field, floating, unsigned
from .functions.storage import durable, own_folder, write_text
from .operators.algorithms import REGISTRY, components, register, registered
from .operators.graph import Graph
from .operators.state import GraphState
from .operators.supersteps import VertexProgram
from .operators.verify import sample_mismatches
from .plans import benchmark_suite, cli
from .plans.http_api import server
from .plans.jobs import CheckpointSpec, Config, Environment, FileSource, JobService, JobSpec, Pipeline, dry_run, ensure_local, run_job
from .plans.sinks import dump_csv, print_sorted
from .queries import E, P, RING, V, _labels, _ranks, _table, ring_graph, trade_graph, trade_pairs, trade_vertices
from .sources import text
from .sources.datasets import extract_archive, largest_text_file, list_files, read_properties, sniff_format
from .sources.socket_lines import lines_to_frame, listen_lines
from .streaming.bounded import Stream, TumblingCount
from .streaming.unbounded import count_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return add


def _new(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _written(rows: DataFrame, line: Column, name: str) -> str:
    """The folder of text files with a line for each row."""
    path = _new(rows.sparkSession, name)
    rows.select(line.alias("value")).write.text(path)
    return path


def _joined(*parts: str | Column, by: str = ",") -> Column:
    return F.concat_ws(by, *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts))


# --- sources


@query("SELECT c_custkey AS id, CAST(floor(abs(c_acctbal)) AS BIGINT) AS value FROM customer")
def source_csv_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table(spark, sf_dir, "customer")
    path = _written(customers, _joined("c_custkey", F.floor(F.abs("c_acctbal")), F.lit("ignored")), "vertices")
    return text.read_vertices(spark, path).select("id", "value")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE 7 END AS value, CASE WHEN c_custkey % 3 = 0 THEN CAST(5 AS BIGINT) ELSE 7 END AS fixed FROM customer")
def source_csv_vertices_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing value is the id, or what the reader is told; blank lines and white space do not count."""
    key = F.col("c_custkey").cast("string")
    line = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), key, F.lit(" "))).otherwise(F.concat(key, F.lit(" , 7\r")))
    path = _written(_table(spark, sf_dir, "customer"), F.concat(line, F.lit("\n  ")), "vertices")
    other = text.read_vertices(spark, path, default=5).select("id", F.col("value").alias("fixed"))
    return text.read_vertices(spark, path).select("id", "value").join(other, "id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN CAST(1.0 AS DOUBLE) ELSE c_acctbal END AS value FROM customer")
def source_csv_vertices_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).otherwise(_joined("c_custkey", "c_acctbal"))
    return text.read_vertices(spark, _written(_table(spark, sf_dir, "customer"), line, "vertices"), kind="double").select("id", "value")


@query("SELECT o_custkey AS src, o_orderkey AS dst, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 256 END AS SMALLINT) AS value FROM orders")
def source_csv_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("o_orderkey") % 3 == 0, _joined("o_custkey", "o_orderkey")).otherwise(_joined("o_custkey", "o_orderkey", F.col("o_orderkey") % 256))
    return text.read_edges(spark, _written(_table(spark, sf_dir, "orders"), line, "edges"))


@query("WITH e AS (SELECT o_custkey AS src, o_orderkey AS dst FROM orders) SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e")
def source_edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White-space separated, with comments and fields that are ignored; undirected."""
    line = F.concat(F.when(F.col("o_orderkey") % 100 == 0, F.lit("# a comment\n")).otherwise(F.lit("")), _joined("o_custkey", "o_orderkey", "o_totalprice", by="\t "))
    return text.read_edge_list(spark, _written(_table(spark, sf_dir, "orders"), line, "edges"), undirected=True).select("src", "dst")


@query("SELECT c_custkey AS id, c_custkey * 2 + 1 AS value FROM customer")
def source_id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(_table(spark, sf_dir, "customer"), _joined("c_custkey", F.lit("ignored"), by=" "), "ids")
    return text.read_id_list(spark, path, lambda i: i * 2 + 1).select("id", "value")


@query("SELECT i AS id, 1.0 / (SELECT count(*) FROM orders) AS value FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS i)")
def source_generated_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "orders").count()
    return text.generated_vertices(spark, n, lambda _: F.lit(1.0 / n))


@query("SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS label, c_acctbal AS rank FROM customer")
def source_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table(spark, sf_dir, "customer")
    labels = text.read_truth(spark, _written(customers, _joined("c_custkey", "c_nationkey", by=" "), "truth")).withColumnRenamed("value", "label")
    return labels.join(text.read_truth(spark, _written(customers, _joined("c_custkey", "c_acctbal", by=" "), "truth"), "double").withColumnRenamed("value", "rank"), "id")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(1 AS BIGINT) AS degree FROM nation")
def source_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph from lists: nations with their regions."""
    rows = [(r["n_nationkey"], r["n_regionkey"]) for r in _table(spark, sf_dir, "nation").collect()]
    return Graph.of(spark, [(n, 0) for n, _ in rows], [(n, r, 0) for n, r in rows]).out_degrees()


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ordinal, n_name AS value FROM nation ORDER BY n_nationkey LIMIT 20")
def source_socket_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names sent to a listening port: line ends go, and lines beyond the twentieth are not read."""
    names = [r["n_name"] for r in _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]

    def send(port: int) -> None:
        def work() -> None:
            with contextlib.suppress(OSError), socket.create_connection(("127.0.0.1", port)) as s:
                s.sendall("".join(f"{n}\r\n" for n in names).encode())

        threading.Thread(target=work, daemon=True).start()

    return lines_to_frame(spark, listen_lines("127.0.0.1", 0, 20, timeout=60, ready=send))


@query("SELECT 'region_' || r_regionkey || '.csv' AS name, CAST(strlen(r_regionkey || ',' || r_name) + 1 AS BIGINT) AS bytes, ',' AS delimiter, 2 AS columns, row_number() OVER (ORDER BY strlen(r_name) DESC, r_regionkey DESC) = 1 AS largest FROM region")
def source_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packed folder of small files, extracted, listed and sniffed on the driver, which alone reads it."""
    with tempfile.TemporaryDirectory() as folder:
        raw = io.BytesIO()
        with tarfile.open(fileobj=raw, mode="w") as tar:
            for r in _table(spark, sf_dir, "region").collect():
                line = f"{r['r_regionkey']},{r['r_name']}\n".encode()
                info = tarfile.TarInfo(f"region_{r['r_regionkey']}.csv")
                info.size = len(line)
                tar.addfile(info, io.BytesIO(line))
        Path(folder, "a.tar.zst").write_bytes(zstandard.ZstdCompressor().compress(raw.getvalue()))
        extract_archive(f"{folder}/a.tar.zst", f"{folder}/out")
        files, best = list_files(f"{folder}/out"), largest_text_file(f"{folder}/out")
        longest = max((f for f in files if f[1] == best[1]), key=lambda f: f[0])
        rows = [(Path(f).name, n, (form := sniff_format(f)).delimiter, form.columns, (f, n) == longest) for f, n in files]
    return spark.createDataFrame(rows, "name string, bytes bigint, delimiter string, columns int, largest boolean")


@query("SELECT o_orderkey AS id, CAST(o_custkey AS BIGINT) AS a, o_totalprice AS b, lower(o_orderstatus) AS c, o_orderpriority LIKE '1%' AS d FROM orders")
def parsed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimming, splitting and strict numbers."""
    line = F.concat(F.lit("  "), _joined("o_orderkey", F.concat(F.lit(" +"), F.col("o_custkey").cast("string"), F.lit(" ")), "o_totalprice", "o_orderstatus", "o_orderpriority"), F.lit("\r"))
    rows = text.lines(spark, _written(_table(spark, sf_dir, "orders"), line, "fields")).select(F.split("line", ",", -1).alias("parts"))
    part = lambda k: field(F.col("parts"), k)
    return rows.select(unsigned(part(0)).alias("id"), unsigned(part(1)).alias("a"), floating(part(2)).alias("b"), F.lower(part(3)).alias("c"), F.startswith(part(4), F.lit("1")).alias("d"))


# --- sinks


@query("SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS value FROM customer")
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new(spark, "dump")
    dump_csv(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("value")), path)
    return text.read_vertices(spark, path).select("id", "value")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS ordinal, c_custkey || ',' || c_nationkey AS value FROM customer")
def sink_sorted_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = io.StringIO()
    print_sorted(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("value")), out)
    return lines_to_frame(spark, out.getvalue().splitlines())


# --- streams


@query("SELECT event_id, round(value * 10, 6) AS value FROM events WHERE value * 10 >= 300")
def stream_python_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python functions of values, in Arrow batches."""
    stream = Stream.from_table(_table(spark, sf_dir, "events"), "value", "event_id")
    rows = stream.map(lambda v: v * 10, "double").filter(lambda v: bool(v >= 300), python=True).rows
    return rows.select(F.col("ordinal").alias("event_id"), F.round("value", 6).alias("value"))


@query("SELECT CAST(r_regionkey AS BIGINT) AS ordinal, r_regionkey * 10 AS value FROM region WHERE r_regionkey * 10 >= 20")
def stream_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of a list, mapped, filtered and collected in order."""
    keys = [r["r_regionkey"] for r in _table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    got = Stream.of(spark, keys, "int").map(lambda v: v * 10).filter(lambda v: v >= 20).collect()
    return spark.createDataFrame([(keys.index(v // 10), v) for v in got], "ordinal bigint, value int")


@query('SELECT w AS "window", count(*) AS n, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last FROM (SELECT CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 64) AS BIGINT) AS w, event_id, value FROM events) GROUP BY w')
def stream_window_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = Stream.from_table(_table(spark, sf_dir, "events"), "value", "event_id").window(TumblingCount(64)).windows()
    return windows.select("window", F.size("values").cast("bigint").alias("n"), F.col("values")[0].alias("first"), F.element_at("values", -1).alias("last"))


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, unnest(range(CAST(floor(n / 8) AS BIGINT))) AS \"window\", CAST(8 AS BIGINT) AS n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) WHERE n >= 8")
def stream_unbounded_count_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured Streaming: full windows of eight events a user."""
    events = _table(spark, sf_dir, "events")
    base, source = _new(spark, "stream"), _new(spark, "events")
    events.select("user_id", "value").write.parquet(source)
    stream = spark.readStream.schema("user_id bigint, value double").parquet(source)
    found = count_windows(stream, "user_id", "value", 8)
    found.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("user_id", "window", F.size("values").cast("bigint").alias("n"))


# --- graphs, state


@query(f"WITH {P}, {E} SELECT src AS id, count(*) AS degree FROM e GROUP BY src")
def partitioned_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_graph(spark, sf_dir).partitioned(5).out_degrees()


@query(_labels(E, 50) + " SELECT component, count(*) AS members FROM w GROUP BY component")
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The program is found by its name, in any case of letters."""
    return registered("Wcc")(trade_graph(spark, sf_dir), supersteps=50).vertices.groupBy(F.col("value").alias("component")).agg(F.count("*").alias("members"))


@query("SELECT c_custkey AS id, c_custkey + 1 AS value, c_custkey AS expected FROM customer WHERE c_custkey % 11 = 0 ORDER BY c_custkey LIMIT 10")
def mismatch_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("value"))
    return sample_mismatches(truth.withColumn("value", F.when(F.col("id") % 11 == 0, F.col("id") + 1).otherwise(F.col("value"))), truth, 10)


def _order_state(spark: SparkSession, sf_dir: str) -> GraphState:
    orders = _table(spark, sf_dir, "orders")
    state = GraphState(spark, _new(spark, "state"), value_type="double", edge_type="double")
    state.put_vertices(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")))
    rows = orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_totalprice").alias("value"))
    state.put_edges(rows.filter("dst % 2 = 0"))
    state.put_edges(rows.filter("dst % 2 = 1"))
    return state


@query("SELECT o_custkey AS id, count(*) AS edges, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def state_edges_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_state(spark, sf_dir).list_edges().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("edges"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT k AS id, c_acctbal AS value, (SELECT count(*) FROM orders WHERE o_custkey = k) AS edges FROM (SELECT unnest([1, 2, 10, 77, -5]) AS k) LEFT JOIN customer ON c_custkey = k")
def state_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and outgoing edges by key, -5 being none."""
    state = _order_state(spark, sf_dir)
    rows = [(k, state.get_vertex(k), state.out_edges(k).count()) for k in (1, 2, 10, 77, -5)]
    return spark.createDataFrame(rows, "id int, value double, edges bigint")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS ordinal, c_custkey AS id, c_acctbal AS value FROM customer")
def state_ordered_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_state(spark, sf_dir).list_vertices(ordered=True).collect()
    return spark.createDataFrame([(k, r["id"], r["value"]) for k, r in enumerate(rows)], "ordinal bigint, id bigint, value double")


# --- jobs


def _trade_files(spark: SparkSession, sf_dir: str, kind: str = "csv") -> tuple[FileSource, FileSource]:
    pairs = trade_pairs(spark, sf_dir)
    edges = pairs.unionAll(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "value"))
    vertices = trade_vertices(spark, sf_dir)
    if kind == "parquet":
        paths = _new(spark, "v"), _new(spark, "e")
        vertices.select("id", F.lit(1.0).alias("value")).write.parquet(paths[0])
        edges.write.parquet(paths[1])
    else:
        paths = _written(vertices, F.col("id").cast("string"), "v"), _written(edges, _joined("src", "dst", "value"), "e")
    return FileSource(paths[0], kind), FileSource(paths[1], kind)


def _job(spark: SparkSession, sf_dir: str, algorithm: str, iterations: int, kind: str = "csv", **more) -> JobSpec:
    vertices, edges = _trade_files(spark, sf_dir, kind)
    return JobSpec(f"job-{uuid.uuid4().hex}", algorithm, vertices, edges, iterations, **more)


@query(_labels(E, 50) + " SELECT id, component FROM w")
def job_submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitted to the service as JSON, waited for and fetched."""
    service = JobService(spark)
    job = service.submit(JobSpec.from_json(_job(spark, sf_dir, "wcc", 50).to_json()))
    service.wait(job)
    return service.fetch(job).withColumnRenamed("value", "component")


@query(_ranks(f"{V}, {P}", E, 6) + " SELECT id, round(x, 6) AS rank FROM w")
def job_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of Parquet sources; the second run goes on where the first ended."""
    spec = _job(spark, sf_dir, "pagerank", 3, "parquet", checkpoint=CheckpointSpec(True, 1, _new(spark, "points")))
    run_job(spark, spec)
    again = run_job(spark, JobSpec.from_json(json.dumps(json.loads(spec.to_json()) | {"iterations": 6, "parallelism": 3})))
    return again.vertices.select("id", F.round("value", 6).alias("rank"))


@query("WITH RECURSIVE " + ", ".join((V, P, E)) + """, r(it, id, c) AS (
  SELECT 1, id, id FROM v
  UNION ALL
  SELECT it + 1, x.id, greatest(x.c, coalesce(m.c, x.c)) FROM (SELECT any_value(r.it) OVER () AS it, id, c FROM r) x
  LEFT JOIN (SELECT e.dst, max(r.c) AS c FROM r JOIN e ON r.id = e.src GROUP BY e.dst) m ON m.dst = x.id WHERE x.it < 3
) SELECT id, c AS greatest FROM r WHERE it = 3""")
def job_of_a_user_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vertex program of the user's, named in a job, with checkpoints."""
    better = F.col("msg") > F.col("value")
    program = VertexProgram("greatest", lambda: (F.col("id"), F.lit(True)), lambda: F.col("value"), F.max, lambda: (F.greatest("value", "msg"), F.coalesce(better, F.lit(False))))
    if program.name not in REGISTRY:
        register(program.name, program)
    spec = _job(spark, sf_dir, "greatest", 3, checkpoint=CheckpointSpec(True, 1, _new(spark, "points")))
    return run_job(spark, spec).vertices.withColumnRenamed("value", "greatest")


@query("SELECT * FROM (VALUES ('bad', 'failed', true), ('good', 'finished', false), ('none', 'not_found', false)) t(job, status, has_error)")
def job_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    service, spec = JobService(spark), _job(spark, sf_dir, "wcc", 1)
    values = json.loads(spec.to_json())
    service.submit(JobSpec.from_json(json.dumps(values | {"job_id": "good"})))
    service.submit(JobSpec.from_json(json.dumps(values | {"job_id": "bad", "edges": {"path": f"{spec.edges.path}-none", "format": "csv"}})))
    service.wait("good"), service.wait("bad")
    rows = [(x["job_id"], x["status"], x["error"] is not None) for x in service.listing()] + [("none", service.status("none"), False)]
    return spark.createDataFrame(rows, "job string, status string, has_error boolean")


@query("SELECT * FROM (VALUES (true, 'first,second', NULL), (false, 'first,bad', 'task bad failed: broken')) t(success, ran, message)")
def job_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks in order; the first failure ends a pipeline."""

    def broken(_: SparkSession) -> None:
        raise ValueError("broken")

    rows = []
    environment = Environment("local" if spark.sparkContext.master.startswith("local") else "distributed", Config({"k": "v"}))
    if environment.mode == "local":
        ensure_local(environment)
    for names in (("first", "second"), ("first", "bad", "third")):
        ran: list[str] = []
        pipeline = Pipeline(spark, environment=environment)
        for name in names:
            pipeline.submit(name, lambda s, name=name, ran=ran: (ran.append(name), broken(s) if name == "bad" else None))
        done = pipeline.execute()
        rows.append((done.success, ",".join(ran), done.error_message))
    return spark.createDataFrame(rows, "success boolean, ran string, message string")


@query("SELECT * FROM (VALUES ('pagerank', 7, 5)) t(algorithm, iterations, partitions)")
def job_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = json.loads(dry_run(JobSpec("j", "pagerank", FileSource("v"), FileSource("e"), 7, parallelism=5)))["plan"]
    return spark.createDataFrame([(plan["algorithm"], plan["max_iterations"], plan["partitions"])], "algorithm string, iterations int, partitions int")


@query("WITH l AS (SELECT CAST(c_custkey AS VARCHAR) || ',' || c_custkey % 7 AS value, c_custkey FROM customer) SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS ordinal, value FROM l")
def cli_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line prints components of triples of customers in numeric order."""
    customers = _table(spark, sf_dir, "customer")
    v = _written(customers, F.col("c_custkey").cast("string"), "v")
    e = _written(customers.filter("c_custkey >= 7"), _joined(F.col("c_custkey") % 7, "c_custkey"), "e")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        cli.main(["submit", "--algorithm", "wcc", "--vertices", v, "--edges", e, "--iterations", "4", "--undirected"])
    return lines_to_frame(spark, out.getvalue().splitlines())


# --- the dataset suite


def _suite(spark: SparkSession, sf_dir: str) -> str:
    """A described dataset of rings of ten vertices, whose components and ranks are known; the path of its properties."""
    n = _table(spark, sf_dir, "customer").count() // 10 * 10
    ids, base = spark.range(n), _new(spark, "suite")
    tens = F.col("id") - F.col("id") % 10
    ids.select(F.col("id").cast("string")).write.text(f"{base}/g.v")
    ids.select(_joined("id", tens + (F.col("id") + 1) % 10, by=" ")).write.text(f"{base}/g.e")
    ids.select(_joined("id", tens, by=" ")).write.text(f"{base}/graph500-9-WCC")
    ids.select(_joined("id", F.lit(1.0 / n), by=" ")).write.text(f"{base}/graph500-9-PR")
    keys = {"vertex-file": "g.v", "edge-file": "g.e", "meta.vertices": n, "meta.edges": n, "directed": "true"}
    write_text(spark, f"{base}/graph500-9.properties", "# a dataset\n" + "".join(f"graph.graph500-9.{k} = {v}\n" for k, v in keys.items()))
    return f"{base}/graph500-9.properties"


@query("WITH n AS (SELECT count(*) // 10 * 10 AS total FROM customer) SELECT 'wcc' AS name, CAST(total AS BIGINT) AS total, true AS passed, 11 AS executed FROM n UNION ALL SELECT 'pagerank', total, true, 4 FROM n")
def suite_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = benchmark_suite.run(spark, read_properties(_suite(spark, sf_dir), spark), rank_supersteps=4, partitions=3)
    return spark.createDataFrame([(k, r["total"], r["passed"], r["executed"]) for k, r in reports.items()], "name string, total bigint, passed boolean, executed int")


@query("""SELECT * FROM (VALUES ('GET /healthz', 200), ('POST /datasets', 200), ('GET /datasets', 200), ('POST /suite', 202), ('GET /jobs/s1', 200), ('GET /jobs/s1/result', 200),
  ('POST /jobs', 400), ('GET /jobs', 200), ('GET /jobs/none', 404), ('GET /workers', 200), ('GET /other', 404)) t(request, status)""")
def http_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health, datasets, suite jobs and results over HTTP, and requests that are refused."""
    service = JobService(spark)
    http = server(service)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    at, rows = f"http://127.0.0.1:{http.server_address[1]}", []

    def call(method: str, path: str, body: dict | None = None) -> None:
        try:
            with urllib.request.urlopen(urllib.request.Request(at + path, None if body is None else json.dumps(body).encode(), method=method), timeout=120) as got:
                code = got.status
        except urllib.error.HTTPError as e:
            code = e.code
        rows.append((f"{method} {path}", code))

    try:
        call("GET", "/healthz")
        call("POST", "/datasets", {"name": "rings", "properties": _suite(spark, sf_dir)})
        call("GET", "/datasets")
        call("POST", "/suite", {"dataset": "rings", "job_id": "s1", "runs": ["wcc"], "wcc_supersteps": 12})
        service.wait("s1")
        for path in ("/jobs/s1", "/jobs/s1/result"):
            call("GET", path)
        call("POST", "/jobs", {"job_id": "x"})
        for path in ("/jobs", "/jobs/none", "/workers", "/other"):
            call("GET", path)
    finally:
        http.shutdown()
    return spark.createDataFrame(rows, "request string, status int")


@query(f"WITH {RING} SELECT id, id % 7 AS component FROM v WHERE id < 7 * 12")
def hub_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a source beyond a bound lie in several partitions; the labels are the same."""
    graph = ring_graph(spark, sf_dir, 7)
    spokes = graph.vertices.select((F.col("id") % 7).alias("src"), F.col("id").alias("dst"), F.lit(0).cast("smallint").alias("value"))
    found = components(Graph(graph.vertices, durable(spokes.unionAll(graph.edges), "spokes")), 4, hub_edges=10).vertices
    return found.filter("id < 7 * 12").withColumnRenamed("value", "component")
