"""Extensions on Structured Streaming: windows by count for each key, and windows by time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def count_windows(stream: DataFrame, key: str, value: str, size: int, key_type: str = "string", value_type: str = "double") -> DataFrame:
    """<key>, window, values: full windows of `size` rows of each key, in arrival order. The state of a key is below `size` rows."""
    size = max(1, size)

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, kept = state.get if state.exists else (0, [])
        kept = list(kept)
        out = []
        for batch in batches:
            kept += batch[value].tolist()
            while len(kept) >= size:
                out.append((keys[0], number, kept[:size]))
                kept, number = kept[size:], number + 1
        state.update((number, kept))
        yield pd.DataFrame(out, columns=[key, "window", "values"])

    rows = stream.select(F.col(key).cast(key_type).alias(key), F.col(value).cast(value_type).alias(value))
    made = f"{key} {key_type}, window bigint, values array<{value_type}>"
    return rows.groupBy(key).applyInPandasWithState(step, made, f"number bigint, kept array<{value_type}>", "append", GroupStateTimeout.NoTimeout)


def time_windows(df: DataFrame, ts: str, width: str, slide: str | None = None, late: str | None = None, keys: tuple[str, ...] = (), aggregates: tuple = ()) -> DataFrame:
    """Tumbling or sliding windows of event time, with a watermark where `late` is given; works on streams and tables."""
    rows = df.withWatermark(ts, late) if late else df
    return rows.groupBy(F.window(ts, width, slide), *keys).agg(*(aggregates or (F.count("*").alias("rows"),)))


def session_windows(df: DataFrame, ts: str, gap: str, keys: tuple[str, ...], late: str | None = None, aggregates: tuple = ()) -> DataFrame:
    rows = df.withWatermark(ts, late) if late else df
    return rows.groupBy(F.session_window(ts, gap), *keys).agg(*(aggregates or (F.count("*").alias("rows"),)))
