"""Sinks of vertices (id, value)."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import DataFrame


def dump_csv(vertices: DataFrame, folder: str) -> None:
    """Part files of `id,value` lines."""
    vertices.select("id", "value").write.mode("overwrite").csv(folder)


def print_sorted(vertices: DataFrame, out: TextIO | None = None) -> None:
    """`id,value` lines in numeric order; rows arrive a partition at a time."""
    for row in vertices.select("id", "value").orderBy("id").toLocalIterator():
        print(f"{row['id']},{row['value']}", file=out or sys.stdout)
