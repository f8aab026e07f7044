"""Strict readers, verification, state, checkpoints, jobs, streams and the command line."""

import json
import socket
import threading
import urllib.request

import pytest

from vertexloom.errors import InvalidArgument
from vertexloom.operators.algorithms import pagerank
from vertexloom.operators.graph import Graph
from vertexloom.operators.state import Checkpoints, GraphState
from vertexloom.operators.verify import RankReport, sample_mismatches, verify_labels, verify_ranks
from vertexloom.plans import benchmark_suite, cli
from vertexloom.plans.http_api import server
from vertexloom.plans.jobs import CheckpointSpec, Config, FileSource, JobService, JobSpec, Pipeline, run_job
from vertexloom.plans.sinks import dump_csv
from vertexloom.sources import text
from vertexloom.sources.datasets import largest_text_file, list_files, read_properties, sniff_format
from vertexloom.sources.socket_lines import lines_to_frame, listen_lines
from vertexloom.streaming.bounded import Stream, TumblingCount


def put(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content)
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_good_csv(spark, tmp_path):
    path = put(tmp_path, "v.csv", "1\n3,7\n5,8,9\n\n 6 , 7 \n")
    assert rows(text.read_vertices(spark, path, default=-1).drop("ordinal")) == [(1, -1), (3, 7), (5, 8), (6, 7)]
    assert rows(text.read_vertices(spark, path).drop("ordinal")) == [(1, 1), (3, 7), (5, 8), (6, 7)]
    assert rows(text.read_vertices(spark, path, kind="double").drop("ordinal")) == [(1, 1.0), (3, 7.0), (5, 8.0), (6, 7.0)]


@pytest.mark.parametrize("line", ["2,", "4,x", "-1", "id,value", "9223372036854775808", "1.5"])
def test_bad_vertices(spark, tmp_path, line):
    with pytest.raises(Exception, match="invalid vertex"):
        text.read_vertices(spark, put(tmp_path, "v.csv", f"1\n{line}\n")).collect()


@pytest.mark.parametrize("line, what", [("1,2,256", "edge value"), ("1", "missing edge target"), ("1,x", "edge target")])
def test_bad_edges(spark, tmp_path, line, what):
    with pytest.raises(Exception, match=what):
        text.read_edges(spark, put(tmp_path, "e.csv", line + "\n")).collect()


def test_last_row_wins(spark, tmp_path):
    vertices = text.read_vertices(spark, put(tmp_path, "v.csv", "1,5\n2,2\n1,9\n"))
    graph = Graph.build(vertices, text.read_edges(spark, put(tmp_path, "e.csv", "1,2\n")))
    assert rows(graph.vertices) == [(1, 9), (2, 2)]


def test_edge_lists(spark, tmp_path):
    path = put(tmp_path, "g.e", "# head\n1 2 9\n\n 3\t3\n")
    assert rows(text.read_edge_list(spark, path)) == [(1, 2, 0), (3, 3, 0)]
    assert rows(text.read_edge_list(spark, path, undirected=True)) == [(1, 2, 0), (2, 1, 0), (3, 3, 0), (3, 3, 0)]
    assert text.generated_vertices(spark, 3).count() == 3


def test_datasets(tmp_path):
    put(tmp_path, "a.csv", "# x\n1,2,3\n")
    put(tmp_path, "b.txt", "1 2\n" * 9)
    assert sniff_format(str(tmp_path / "a.csv")).columns == 3
    assert largest_text_file(str(tmp_path))[0].endswith("b.txt")
    assert [s for _, s in list_files(str(tmp_path))] == [10, 36]
    with pytest.raises(InvalidArgument):
        read_properties(put(tmp_path, "graph500-3.properties", "graph.graph500-3.vertex-file = v\n"))


def suite(tmp_path):
    put(tmp_path, "g.v", "1\n2\n3\n")
    put(tmp_path, "g.e", "1 2\n2 3\n")
    put(tmp_path, "graph500-3-WCC", "1 1\n2 1\n3 1\n")
    keys = {"vertex-file": "g.v", "edge-file": "g.e", "meta.vertices": 3, "meta.edges": 2, "directed": "false"}
    return put(tmp_path, "graph500-3.properties", "".join(f"graph.graph500-3.{k} = {v}\n" for k, v in keys.items()))


def test_suite(spark, tmp_path):
    meta = read_properties(suite(tmp_path))
    assert benchmark_suite.run(spark, meta, ("wcc",), out=str(tmp_path / "out"))["wcc"]["passed"]
    for bad in ((), ("sorting",), ("pagerank",)):
        with pytest.raises(InvalidArgument):
            benchmark_suite.run(spark, meta, bad)
    (tmp_path / "graph500-3-WCC").write_text("1 1\n2 2\n3 1\n")
    assert not benchmark_suite.run(spark, meta, ("wcc",))["wcc"]["passed"]


def test_verification(spark):
    truth = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id bigint, value bigint")
    assert verify_labels(truth, truth).passed
    planted = spark.createDataFrame([(1, 1), (1, 1), (2, 5), (9, 9)], "id bigint, value bigint")
    report = verify_labels(planted, truth)
    assert (report.total, report.mismatches, report.unexpected, report.missing) == (4, 1, 2, 1)
    assert not report.passed and json.loads(report.to_json())["missing"] == 1
    assert rows(sample_mismatches(planted, truth)) == [(2, 5, 1)]
    ranks = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, 3.0)], "id bigint, value double")
    assert not verify_ranks(ranks, truth).passed
    assert verify_ranks(truth, truth) == RankReport(3, 0, 0, 0.0, 0.0)


def test_state(spark, tmp_path):
    state = GraphState(spark, str(tmp_path / "live"))
    state.put_vertices(spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id bigint, value bigint"))
    state.put_edges(spark.createDataFrame([(1, 2, 10), (1, 3, 100)], "src bigint, dst bigint, value bigint"))
    state.put_edges(spark.createDataFrame([(2, 3, 20)], "src bigint, dst bigint, value bigint"))
    assert (state.get_vertex(2), state.get_vertex(999)) == (20, None)
    assert [state.out_edges(k).count() for k in (1, 2, 9)] == [2, 1, 0]
    saved = state.snapshot(str(tmp_path / "saved"))
    state.put_vertices(spark.createDataFrame([(1, 999)], "id bigint, value bigint"))
    assert (saved.get_vertex(1), state.get_vertex(1)) == (10, 999)
    assert [r["id"] for r in state.list_vertices(ordered=True).collect()] == [1, 2, 3]
    with pytest.raises(InvalidArgument):
        state.snapshot(str(tmp_path / "saved"))


def test_resumed_run_equals_uninterrupted(spark, tmp_path):
    graph = Graph.of(spark, [(1, 1.0), (2, 1.0), (3, 1.0)], [(1, 2, 0), (2, 3, 0), (3, 1, 0), (1, 3, 0)], value_type="double")
    whole = pagerank(graph, 7, teleport=0.15)
    points = Checkpoints(spark, str(tmp_path), "j", "pagerank", {"teleport": 0.15}, 2)
    assert points.latest() is None
    pagerank(graph, 5, teleport=0.15, hook=points.hook, partitions=2)
    assert points.latest()[0] == 4
    again = pagerank(graph, 7, teleport=0.15, resume=points.latest(), partitions=5)
    assert dict(rows(again.vertices)) == pytest.approx(dict(rows(whole.vertices)))
    with pytest.raises(InvalidArgument):
        Checkpoints(spark, str(tmp_path), "j", "wcc", {}, 2).latest()


def spec(tmp_path, **more):
    v, e = put(tmp_path, "v.csv", "1\n2\n3\n"), put(tmp_path, "e.csv", "1,2,0\n2,1,0\n2,3,0\n3,2,0\n")
    return JobSpec("job", "wcc", FileSource(v), FileSource(e), **more)


def test_jobs(spark, tmp_path):
    job = spec(tmp_path, checkpoint=CheckpointSpec(True, 1, str(tmp_path / "cp")))
    assert JobSpec.from_json(job.to_json()) == job
    assert rows(run_job(spark, job).vertices) == [(1, 1), (2, 1), (3, 1)]
    assert (tmp_path / "cp/job/checkpoint_latest.json").exists()
    with pytest.raises(InvalidArgument):
        JobSpec("x", "sssp", FileSource(""), FileSource("")).validated()


def test_service_and_http(spark, tmp_path):
    service = JobService(spark)
    http = server(service)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{http.server_address[1]}"
    body = spec(tmp_path, iterations=4).to_json().encode()
    assert urllib.request.urlopen(urllib.request.Request(f"{at}/jobs", body)).status == 202
    assert service.wait("job", 120) == "finished"
    assert rows(service.fetch("job")) == [(1, 1), (2, 1), (3, 1)]
    assert json.loads(urllib.request.urlopen(f"{at}/jobs/job").read())["status"] == "finished"
    assert json.loads(urllib.request.urlopen(f"{at}/healthz").read())["status"] == "ok"
    with pytest.raises(urllib.error.HTTPError, match="400"):
        urllib.request.urlopen(urllib.request.Request(f"{at}/jobs", b"{}"))
    http.shutdown()
    assert service.status("none") == "not_found"
    broken = JobSpec("bad", "wcc", FileSource(str(tmp_path / "absent")), FileSource(str(tmp_path / "absent")))
    service.submit(broken)
    assert service.wait("bad", 60) == "failed" and service.error("bad")
    with pytest.raises(InvalidArgument):
        service.fetch("bad")


def test_pipeline(spark):
    seen = []
    good = Pipeline(spark).submit("a", lambda s: seen.append(1)).execute()
    assert good.success and seen == [1]
    bad = Pipeline(spark).submit("b", lambda s: 1 / 0).submit("c", lambda s: seen.append(2)).execute()
    assert not bad.success and bad.error_message.startswith("task b failed") and seen == [1]
    with pytest.raises(InvalidArgument):
        Pipeline(spark, "elsewhere")
    config = Config()
    config.put("a", 1)
    assert (config.get("a"), config.get("b", "x")) == ("1", "x")


def test_command_line(spark, tmp_path, capsys):
    job = spec(tmp_path)
    args = ["submit", "--algorithm", "wcc", "--vertices", job.vertices.path, "--edges", job.edges.path]
    assert cli.main([*args, "--dry-run"]) == 0
    assert json.loads(capsys.readouterr().out)["plan"]["max_iterations"] == 10
    assert cli.main(args) == 0
    assert capsys.readouterr().out.split() == ["1,1", "2,1", "3,1"]
    assert cli.main(["suite", "inspect", str(tmp_path)]) == 0
    assert cli.main(["submit", "--algorithm", "sssp", "--vertices", "v", "--edges", "e"]) == 2


def test_csv_sink(spark, tmp_path):
    dump_csv(spark.createDataFrame([(1, 2.0)], "id bigint, value double"), str(tmp_path / "out"))
    assert [p.read_text() for p in (tmp_path / "out").glob("part-*") if p.stat().st_size] == ["1,2.0\n"]


def test_streams(spark):
    assert Stream.of(spark, [1, 2, 3, 4]).map(lambda x: x * 10).filter(lambda x: x >= 30).collect() == [30, 40]
    assert Stream.of(spark, [1, 2, 3, 4]).map(lambda x: x * 10, "bigint").filter(lambda x: x >= 30, python=True).collect() == [30, 40]
    assert Stream.of(spark, [1, 2, 3, 4, 5]).window(TumblingCount(2)).collect() == [[1, 2], [3, 4], [5]]
    assert Stream.of(spark, [3, 4]).window(TumblingCount(0)).collect() == [[3], [4]]
    assert Stream.of(spark, []).window(TumblingCount(2)).collect() == []


def test_unbounded_count_windows(spark, tmp_path):
    from vertexloom.streaming.unbounded import count_windows

    spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 9.0)], "k string, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = count_windows(spark.readStream.schema("k string, v double").parquet(str(tmp_path / "in")), "k", "v", 2)
    query = stream.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("windows")) == [("a", 0, [1.0, 2.0])]


def test_socket_source(spark):
    got, port = [], threading.Event()
    where = []
    thread = threading.Thread(target=lambda: got.extend(listen_lines("127.0.0.1", 0, 2, 30, lambda p: (where.append(p), port.set()))))
    thread.start()
    port.wait(30)
    with socket.create_connection(("127.0.0.1", where[0])) as s:
        s.sendall(b"a\r\nb\nc\n")
    thread.join(30)
    assert got == ["a", "b"]
    assert rows(lines_to_frame(spark, got)) == [(0, "a"), (1, "b")]
