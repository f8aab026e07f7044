"""Dataset descriptions on the driver's side: properties files, folder listings, format sniffing, archives."""

from __future__ import annotations

import re
import shutil
import subprocess
import tarfile
from dataclasses import dataclass
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import InvalidArgument, StorageError
from ..functions.storage import exists, read_text


@dataclass(frozen=True)
class DatasetMeta:
    scale: int
    vertex_file: str
    edge_file: str
    vertices: int
    edges: int
    directed: bool
    truth_components: str | None = None
    truth_ranks: str | None = None


def read_properties(path: str, spark: SparkSession | None = None) -> DatasetMeta:
    """A `graph.graph500-<scale>.<key> = value` file; truth files stand beside it if there are any. With `spark`, in any store that Spark reads."""
    folder, _, name = path.rpartition("/")
    folder = folder or "."
    try:
        rows = (Path(path).read_text() if spark is None else read_text(spark, path)).splitlines()
    except (OSError, Py4JJavaError) as e:
        raise StorageError(str(e)) from e
    values = {}
    for row in map(str.strip, rows):
        if row and not row.startswith("#") and "=" in row:
            key, _, value = row.partition("=")
            values[key.strip()] = value.strip()
    named = re.search(r"graph500-(\d+)", name) or next((m for k in values if (m := re.search(r"graph500-(\d+)", k))), None)
    if not named:
        raise InvalidArgument(f"no scale in {path}")
    prefix = f"graph.graph500-{named[1]}."

    def need(key: str) -> str:
        if prefix + key not in values:
            raise InvalidArgument(f"{path} lacks {prefix}{key}")
        return values[prefix + key]

    def count(key: str) -> int:
        if not (text := need(key)).isdigit():
            raise InvalidArgument(f"{prefix}{key} is not a count: {text}")
        return int(text)

    def beside(suffix: str) -> str | None:
        at = f"{folder}/graph500-{named[1]}-{suffix}"
        return at if (Path(at).exists() if spark is None else exists(spark, at)) else None

    return DatasetMeta(int(named[1]), f"{folder}/{need('vertex-file')}", f"{folder}/{need('edge-file')}", count("meta.vertices"), count("meta.edges"), need("directed").lower() == "true", beside("WCC"), beside("PR"))


def list_files(folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of all files below a folder, by path."""
    return sorted((str(p), p.stat().st_size) for p in Path(folder).rglob("*") if p.is_file())


@dataclass(frozen=True)
class TextFormat:
    delimiter: str
    columns: int


def sniff_format(path: str, most: int = 50) -> TextFormat | None:
    """By the first line of the first `most` that is neither blank nor a comment: comma, else tab, else white space."""
    with open(path, errors="replace") as f:
        for _, row in zip(range(most), f, strict=False):
            row = row.strip()
            if row and not row.startswith("#"):
                mark = "," if "," in row else "\t" if "\t" in row else " "
                return TextFormat(mark, len(row.split() if mark == " " else row.split(mark)))
    return None


def largest_text_file(folder: str) -> tuple[str, int] | None:
    found = [f for f in list_files(folder) if Path(f[0]).suffix in (".txt", ".csv", ".tsv", ".edges", ".el")]
    return max(found, key=lambda f: f[1], default=None)


def extract_archive(archive: str, folder: str) -> None:
    """A .tar.zst archive, with the zstandard module or the zstd program."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    try:
        import zstandard
    except ImportError:
        if not (zstd := shutil.which("zstd")):
            raise StorageError("neither the zstandard module nor the zstd program is there") from None
        with subprocess.Popen([zstd, "-dc", archive], stdout=subprocess.PIPE) as p, tarfile.open(fileobj=p.stdout, mode="r|") as tar:
            tar.extractall(folder, filter="data")
        if p.returncode:
            raise StorageError(f"zstd cannot read {archive}") from None
        return
    with open(archive, "rb") as f, zstandard.ZstdDecompressor().stream_reader(f) as raw, tarfile.open(fileobj=raw, mode="r|") as tar:
        tar.extractall(folder, filter="data")
