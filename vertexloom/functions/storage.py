"""Tables and small files in folders that driver and executors share."""

from __future__ import annotations

import atexit
import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import StorageError


@functools.cache
def _local_folder() -> str:
    folder = tempfile.TemporaryDirectory(prefix="vertexloom-")
    atexit.register(folder.cleanup)
    return f"file://{folder.name}"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of this machine, and only if the executors run in it too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise StorageError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local_folder()


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/vertexloom/{spark.sparkContext.applicationId}"


def durable(df: DataFrame, name: str = "t") -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def _path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def discard(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def discard_table(df: DataFrame) -> None:
    """Removes the folder of a table that `durable` returned; nothing may read it any more."""
    path = vars(df).get("_durable_path")
    if path:
        discard(df.sparkSession, path)


def discard_all(spark: SparkSession) -> None:
    """Removes all tables that this application wrote; no result that reads them may be in use."""
    discard(spark, own_folder(spark))


def write_bytes(spark: SparkSession, path: str, raw: bytes) -> None:
    """The whole file at once: written aside, then renamed over the old one, which is there until the new one is."""
    aside, fs = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    target, _ = _path(spark, path)
    out = fs.create(aside, True)
    out.write(raw)
    out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(aside), fs.makeQualified(target), options)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
