"""Graph state in versions of Parquet tables, and snapshots of runs that can be resumed.

Vertices lie in buckets by a hash of their id; an upsert rewrites the buckets that its rows fall in
and leaves the others, and a lookup reads one.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.storage import discard_table, durable, exists, read_text, write_text
from .graph import last_wins

BUCKETS = 64


class GraphState:
    """Vertices (id, value), upserted, and edges (src, dst, value), appended. Snapshots never change."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", value_type: str = "bigint", edge_type: str = "bigint", buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.vertex_schema, self.edge_schema = f"id {id_type}, value {value_type}", f"src {id_type}, dst {id_type}, value {edge_type}"
        if not exists(spark, self._meta):
            self._point({"version": 0, "buckets": buckets, "vertices": {}, "edges": []})

    @property
    def _meta(self) -> str:
        return f"{self.path}/current.json"

    def _point(self, meta: dict) -> None:
        write_text(self.spark, self._meta, json.dumps(meta))

    def _current(self) -> dict:
        return json.loads(read_text(self.spark, self._meta))

    @staticmethod
    def _bucket(key, n: int):
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def put_vertices(self, rows: DataFrame) -> None:
        """Upsert; of rows that repeat an id, the last by `ordinal` wins, or the last in the order of `rows` without that column."""
        meta = self._current()
        if "ordinal" not in rows.columns:
            rows = rows.withColumn("ordinal", F.monotonically_increasing_id())
        name, type_of = f"{self.path}/vertices-{meta['version'] + 1}", dict(x.split(" ", 1) for x in self.vertex_schema.split(", "))
        new = last_wins(rows).select(F.col("id").cast(type_of["id"]).alias("id"), F.col("value").cast(type_of["value"]).alias("value"))
        new = durable(new.withColumn("bucket", self._bucket("id", meta["buckets"])), "upsert")
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most as many as there are buckets
        paths = [meta["vertices"][str(b)] for b in touched if str(b) in meta["vertices"]]
        if paths:
            old = self.spark.read.schema(self.vertex_schema).parquet(*paths).withColumn("bucket", self._bucket("id", meta["buckets"]))
            whole = old.join(new.select("id"), "id", "left_anti").unionByName(new)
        else:
            whole = new
        if touched:
            whole.select("id", "value", "bucket").repartition("bucket").write.partitionBy("bucket").parquet(name)
        discard_table(new)
        self._point(meta | {"version": meta["version"] + 1, "vertices": meta["vertices"] | {str(b): f"{name}/bucket={b}" for b in touched}})

    def put_edges(self, rows: DataFrame) -> None:
        meta = self._current()
        target = f"{self.path}/edges-{meta['version'] + 1}"
        rows.select("src", "dst", "value").write.parquet(target)
        self._point(meta | {"version": meta["version"] + 1, "edges": [*meta["edges"], target]})

    def list_vertices(self, ordered: bool = False) -> DataFrame:
        return self._read(list(self._current()["vertices"].values()), ordered)

    def _read(self, paths: list[str], ordered: bool = False) -> DataFrame:
        rows = self.spark.read.schema(self.vertex_schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.vertex_schema)
        return rows.orderBy("id") if ordered else rows

    def list_edges(self) -> DataFrame:
        at = self._current()["edges"]
        return self.spark.read.schema(self.edge_schema).parquet(*at) if at else self.spark.createDataFrame([], self.edge_schema)

    def get_vertex(self, key):
        meta = self._current()
        kind = self.vertex_schema.split(", ")[0].split(" ", 1)[1]
        bucket = self.spark.range(1).select(self._bucket(F.lit(key).cast(kind), meta["buckets"])).first()[0]
        row = self._read([p for b, p in meta["vertices"].items() if int(b) == bucket]).filter(F.col("id") == F.lit(key)).first()
        return None if row is None else row["value"]

    def out_edges(self, key) -> DataFrame:
        return self.list_edges().filter(F.col("src") == F.lit(key))

    def snapshot(self, path: str) -> "GraphState":
        """The present content under another path. Versions are immutable, so naming them is enough."""
        if exists(self.spark, f"{path.rstrip('/')}/current.json"):
            raise InvalidArgument(f"{path} holds a state already")
        write_text(self.spark, f"{path.rstrip('/')}/current.json", json.dumps(self._current()))
        other = GraphState.__new__(GraphState)
        other.spark, other.path, other.vertex_schema, other.edge_schema = self.spark, path.rstrip("/"), self.vertex_schema, self.edge_schema
        return other


@dataclass(frozen=True)
class CheckpointMeta:
    job_id: str
    iteration: int
    algorithm: str
    params: dict = field(default_factory=dict)
    table: str = ""

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


class Checkpoints:
    """Snapshots of a job below <base>/<job_id>: cp_<k> tables, their descriptions, and the name of the latest."""

    def __init__(self, spark: SparkSession, base: str, job_id: str, algorithm: str, params: dict, interval: int = 1):
        if interval < 1:
            raise InvalidArgument("the checkpoint interval must be positive")
        self.spark, self.folder, self.job_id = spark, f"{base.rstrip('/')}/{job_id}", job_id
        self.algorithm, self.params, self.interval = algorithm, json.loads(json.dumps(params)), interval

    def hook(self, iteration: int, state: DataFrame) -> None:
        if iteration % self.interval:
            return
        table = f"{self.folder}/cp_{iteration}"
        state.write.mode("overwrite").parquet(table)
        text = CheckpointMeta(self.job_id, iteration, self.algorithm, self.params, table).to_json()
        write_text(self.spark, f"{self.folder}/checkpoint_{iteration}.json", text)
        write_text(self.spark, f"{self.folder}/checkpoint_latest.json", text)

    def latest(self) -> tuple[int, DataFrame] | None:
        """The superstep and state to resume from; refused where algorithm or parameters differ."""
        path = f"{self.folder}/checkpoint_latest.json"
        if not exists(self.spark, path):
            return None
        meta = CheckpointMeta(**json.loads(read_text(self.spark, path)))
        if (meta.algorithm, meta.params) != (self.algorithm, self.params):
            raise InvalidArgument(f"job {self.job_id} was run as {meta.algorithm} {meta.params}, not {self.algorithm} {self.params}")
        return meta.iteration, self.spark.read.parquet(meta.table)
