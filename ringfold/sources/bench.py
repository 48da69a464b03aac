"""Timing of queries: one warm-up, then timed runs; mean and deviation in milliseconds."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame


def run_to_end(df: DataFrame) -> None:
    """Computes all rows and columns without sending them anywhere."""
    df.write.format("noop").mode("overwrite").save()


def benchmark(title: str, iterations: int, func: Callable[..., DataFrame], args: list[Any], show_results: bool = False, verbose: bool = True) -> tuple[float, float]:
    """Mean and standard deviation of ``iterations`` (2 or more) runs of func(*args)."""
    if iterations < 2:
        raise ValueError("2 iterations or more")
    run_to_end(func(*args))
    times = []
    for _ in range(iterations):
        began = time.perf_counter()
        run_to_end(func(*args))
        times.append(1000 * (time.perf_counter() - began))
    mean, deviation = statistics.mean(times), statistics.stdev(times)
    if verbose:
        print(f"{title}: mean {mean:.1f} ms, deviation {deviation:.1f} ms, {func(*args).count()} results")
    if show_results:
        func(*args).show(truncate=False)
    return mean, deviation
