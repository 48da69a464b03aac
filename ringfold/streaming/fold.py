"""Summation over streams: addition is commutative, so a grouped sum can be kept up to date."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.coll import Coll, Emit, Pair


def sum_stream(stream: DataFrame, body: Callable[[Pair], Emit], time: str | None = None, late: str = "10 minutes") -> DataFrame:
    """The running sums of what the body emits, for complete or update mode; lookups into static collections are joins.

    time: the event-time column; rows later than ``late`` are dropped and, with a window in the key, state with them.
    """
    rows = stream.withWatermark(time, late) if time else stream
    return Coll(rows).sum(body).df


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Runs a stream into an in-memory table, for tests and small results."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).start()


def to_files(df: DataFrame, path: str, checkpoint: str, **options: Any) -> StreamingQuery:
    """Runs a stream whose keys hold a window into Parquet files, each window once it is closed."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).options(**options).start()
