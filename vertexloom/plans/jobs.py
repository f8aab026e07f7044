"""Jobs: their description, plan, execution, and a service that runs them."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidArgument
from ..operators.algorithms import default_teleport, registered
from ..operators.graph import Graph
from ..operators.state import Checkpoints
from ..operators.supersteps import Run
from ..sources import text


class Config:
    """String settings."""

    def __init__(self, values: dict[str, str] | None = None):
        self.values = dict(values or {})

    def put(self, key: str, value: object) -> None:
        self.values[key] = str(value)

    def get(self, key: str, default: str | None = None) -> str | None:
        return self.values.get(key, default)


@dataclass(frozen=True)
class Environment:
    """Where pipelines run, and their settings."""

    mode: str = "local"
    config: Config = field(default_factory=Config)

    def __post_init__(self) -> None:
        if self.mode not in ("local", "distributed"):
            raise InvalidArgument(f"unknown mode {self.mode!r}")

    @staticmethod
    def local() -> "Environment":
        return Environment("local")

    @staticmethod
    def distributed() -> "Environment":
        return Environment("distributed")


def ensure_local(environment: Environment) -> None:
    if environment.mode != "local":
        raise InvalidArgument("a local pipeline needs an environment of mode local")


@dataclass(frozen=True)
class FileSource:
    path: str
    format: str = "csv"  # or parquet


@dataclass(frozen=True)
class CheckpointSpec:
    enabled: bool = False
    interval: int = 0
    base_dir: str = ""


@dataclass(frozen=True)
class JobSpec:
    job_id: str
    algorithm: str
    vertices: FileSource
    edges: FileSource
    iterations: int = 10
    alpha: float = 0.85
    source: int | None = None
    undirected: bool = False
    parallelism: int = 4
    mode: str = "local"
    name: str = ""
    checkpoint: CheckpointSpec = field(default_factory=CheckpointSpec)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(raw: str) -> "JobSpec":
        values = json.loads(raw)
        return JobSpec(**values | {"vertices": FileSource(**values["vertices"]), "edges": FileSource(**values["edges"]), "checkpoint": CheckpointSpec(**values.get("checkpoint", {}))})

    def validated(self) -> "JobSpec":
        registered(self.algorithm)
        if self.iterations < 0 or self.parallelism < 1:
            raise InvalidArgument("iterations must not be negative and parallelism must be positive")
        if self.algorithm == "sssp" and self.source is None:
            raise InvalidArgument("sssp needs a source")
        if self.checkpoint.enabled and self.checkpoint.interval > 0 and not self.checkpoint.base_dir:
            raise InvalidArgument("checkpoints need a folder")
        return self


def new_job_id() -> str:
    return f"job_{time.time_ns()}"


@dataclass(frozen=True)
class ExecutionPlan:
    job_id: str
    algorithm: str
    max_iterations: int
    partitions: int

    @staticmethod
    def of(spec: JobSpec) -> "ExecutionPlan":
        return ExecutionPlan(spec.job_id, spec.algorithm, spec.iterations, spec.parallelism)


def dry_run(spec: JobSpec) -> str:
    return json.dumps({"job": asdict(spec), "plan": asdict(ExecutionPlan.of(spec))}, indent=2, sort_keys=True)


def load_graph(spark: SparkSession, spec: JobSpec) -> Graph:
    """Ranks read numbers, 1.0 where missing; all else reads integers, the id where missing."""

    def read(source: FileSource, csv: Callable[[], DataFrame]) -> DataFrame:
        if source.format not in ("csv", "parquet"):
            raise InvalidArgument(f"unknown format {source.format!r}")
        return spark.read.parquet(source.path) if source.format == "parquet" else csv()

    kind = "double" if spec.algorithm == "pagerank" else "bigint"
    vertices = read(spec.vertices, lambda: text.read_vertices(spark, spec.vertices.path, kind=kind))
    return Graph.build(vertices, read(spec.edges, lambda: text.read_edges(spark, spec.edges.path)))


def run_job(spark: SparkSession, spec: JobSpec) -> Run:
    """One way for all modes, for registered user programs too; resumes the job's latest checkpoint where there is one."""
    spec.validated()
    graph = load_graph(spark, spec)
    options: dict = {"partitions": spec.parallelism}
    params: dict = {}
    if spec.algorithm == "pagerank":
        params = {"alpha": spec.alpha, "teleport": default_teleport(graph, spec.alpha)}
        options |= params
    elif spec.algorithm == "sssp":
        params = {"source": spec.source}
        options |= params
    elif spec.undirected:
        options["undirected"] = params["undirected"] = True
    if spec.checkpoint.enabled and spec.checkpoint.interval > 0:
        points = Checkpoints(spark, spec.checkpoint.base_dir, spec.job_id, spec.algorithm, params, spec.checkpoint.interval)
        options |= {"hook": points.hook, "resume": points.latest()}
    bound = "max_supersteps" if spec.algorithm == "sssp" else "supersteps"
    return registered(spec.algorithm)(graph, **{bound: spec.iterations}, **options)


@dataclass(frozen=True)
class PipelineResult:
    success: bool
    error_message: str | None = None


class PipelineTask(Protocol):
    name: str

    def execute(self, spark: SparkSession) -> None: ...


class Pipeline:
    """Tasks in the order they were submitted; the first failure ends the run."""

    def __init__(self, spark: SparkSession, mode: str = "local", environment: Environment | None = None):
        self.environment = environment or Environment(mode)
        self.spark, self.tasks = spark, []
        if self.environment.mode == "local" and not spark.sparkContext.master.startswith("local"):
            raise InvalidArgument(f"mode local, but the session runs on {spark.sparkContext.master}")

    @property
    def mode(self) -> str:
        return self.environment.mode

    def submit(self, name: str, task: Callable[[SparkSession], None]) -> "Pipeline":
        self.tasks.append((name, task))
        return self

    def execute(self) -> PipelineResult:
        for name, task in self.tasks:
            try:
                (task.execute if hasattr(task, "execute") else task)(self.spark)
            except Exception as e:
                return PipelineResult(False, f"task {name} failed: {e}")
        return PipelineResult(True)


class JobService:
    """Runs jobs on threads of this process: submit, status (running, finished, failed, not_found), fetch."""

    def __init__(self, spark: SparkSession):
        self.spark, self.lock = spark, threading.Lock()
        self.jobs: dict[str, dict] = {}

    def submit(self, spec: JobSpec) -> str:
        spec.validated()
        return self.start(spec.job_id, lambda: run_job(self.spark, spec))

    def start(self, job_id: str, task: Callable[[], object]) -> str:
        """Runs `task` under the name; what it returns is the job's result."""
        with self.lock:
            if self.jobs.get(job_id, {}).get("status") == "running":
                raise InvalidArgument(f"job {job_id} is running")
            job = self.jobs[job_id] = {"status": "running", "error": None, "run": None}

        def work() -> None:
            try:
                job["run"] = task()
                job["status"] = "finished"
            except Exception as e:
                job["error"], job["status"] = str(e), "failed"

        job["thread"] = threading.Thread(target=work, daemon=True)
        job["thread"].start()
        return job_id

    def status(self, job_id: str) -> str:
        return self.jobs.get(job_id, {"status": "not_found"})["status"]

    def error(self, job_id: str) -> str | None:
        return self.jobs.get(job_id, {}).get("error")

    def wait(self, job_id: str, timeout: float | None = None) -> str:
        if job_id in self.jobs:
            self.jobs[job_id]["thread"].join(timeout)
        return self.status(job_id)

    def result(self, job_id: str):
        if self.status(job_id) != "finished":
            raise InvalidArgument(f"job {job_id} is {self.status(job_id)}")
        return self.jobs[job_id]["run"]

    def fetch(self, job_id: str) -> DataFrame:
        return self.result(job_id).vertices

    def workers(self) -> list[str]:
        """The executors that are there now; the driver's own threads in local mode."""
        status = self.spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
        return sorted(status.keySet().mkString(",").split(","))

    def listing(self) -> list[dict]:
        return [{"job_id": k, "status": v["status"], "error": v["error"]} for k, v in sorted(self.jobs.items())]
