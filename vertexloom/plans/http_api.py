"""A small HTTP face of the job service.

GET /healthz, /workers, /jobs, /jobs/<id>, /jobs/<id>/result (the first rows, `?limit=`), /datasets;
POST /jobs (a job description), /datasets (name and properties file), /suite (dataset, runs, supersteps, alpha).
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from ..errors import VertexloomError
from ..operators.supersteps import Run
from ..sources.datasets import DatasetMeta, read_properties
from . import benchmark_suite
from .jobs import JobService, JobSpec, new_job_id

MAX_BODY = 4 << 20
#: Rows of a result that one reply holds at most.
MAX_ROWS = 10_000


def server(service: JobService, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    datasets: dict[str, DatasetMeta] = {}

    def register(body: dict) -> dict:
        datasets[body["name"]] = meta = read_properties(body["properties"], service.spark)
        return {"name": body["name"], "vertices": meta.vertices, "edges": meta.edges}

    def suite(body: dict) -> dict:
        meta, job = datasets[body["dataset"]], body.get("job_id") or new_job_id()
        options = {k: body[k] for k in ("wcc_supersteps", "rank_supersteps", "alpha", "partitions") if k in body}
        service.start(job, lambda: benchmark_suite.run(service.spark, meta, tuple(body.get("runs", benchmark_suite.RUNS)), **options))
        return {"job_id": job}

    def result(job: str, limit: int) -> object:
        done = service.result(job)
        return [r.asDict() for r in done.vertices.orderBy("id").limit(min(limit, MAX_ROWS)).collect()] if isinstance(done, Run) else done

    posts = {"/jobs": lambda body: {"job_id": service.submit(JobSpec.from_json(json.dumps(body)))}, "/datasets": register, "/suite": suite}

    class Handler(BaseHTTPRequestHandler):
        def reply(self, code: int, body: object) -> None:
            raw = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            listed = {"/healthz": lambda: {"status": "ok"}, "/workers": service.workers, "/jobs": service.listing, "/datasets": lambda: sorted(datasets)}
            if url.path in listed:
                return self.reply(200, listed[url.path]())
            kind, _, rest = url.path.strip("/").partition("/")
            job, _, part = rest.partition("/")
            if kind != "jobs" or not job or part not in ("", "result"):
                return self.reply(404, {"error": "not found"})
            status = service.status(job)
            if part == "" or status == "not_found":
                return self.reply(404 if status == "not_found" else 200, {"job_id": job, "status": status, "error": service.error(job)})
            try:
                self.reply(200, result(job, int(parse_qs(url.query).get("limit", ["100"])[0])))
            except (VertexloomError, ValueError) as e:
                self.reply(409, {"error": str(e)})

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if self.path not in posts:
                return self.reply(404, {"error": "not found"})
            if size > MAX_BODY:
                return self.reply(413, {"error": "body too large"})
            try:
                self.reply(200 if self.path == "/datasets" else 202, posts[self.path](json.loads(self.rfile.read(size).decode())))
            except (VertexloomError, ValueError, TypeError, KeyError) as e:
                self.reply(400, {"error": str(e)})

        def log_message(self, *_: object) -> None: ...

    return ThreadingHTTPServer((host, port), Handler)
