"""A listening line source: accepts one connection and reads lines up to a bound or the end."""

from __future__ import annotations

import socket

from pyspark.sql import DataFrame, SparkSession

from ..errors import StorageError


def listen_lines(host: str, port: int, max_lines: int, timeout: float | None = None, ready=None) -> list[str]:
    """At most `max_lines` lines, each without its trailing line ends; `ready` is called with the bound port."""
    try:
        with socket.create_server((host, port)) as server:
            server.settimeout(timeout)
            if ready:
                ready(server.getsockname()[1])
            peer, _ = server.accept()
            with peer, peer.makefile("r", encoding="utf-8", newline="\n") as f:
                return [line.rstrip("\r\n") for _, line in zip(range(max_lines), f, strict=False)]
    except OSError as e:
        raise StorageError(str(e)) from e


def lines_to_frame(spark: SparkSession, rows: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rows)), "ordinal bigint, value string")
