"""Connected components of a link table, without gathering it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, spread_join


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links, contracted: each node with the least node that this partition ties it to."""
    up: dict = {}

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    kind = pa.string()
    for b in batches:
        kind = b.schema.field(0).type
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = sorted((root(x), root(y)))
            up[y] = x
            up.setdefault(x, x)
    nodes = [x for x in up if root(x) != x]
    for k in range(0, len(nodes), 10_000):
        part = nodes[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([root(x) for x in part], kind)], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node but the roots: root is the least node of its component.

    links: two columns of strings or of binaries. Partitions contract their links first; then alternating
    large-star and small-star steps join what is left until nothing changes. Each step writes its links. A
    node of very many links is joined without gathering them (spread_join).
    """
    kind = links.dtypes[0][1]
    step = kept(links.toDF("node", "root").mapInArrow(_forest, f"node {kind}, root {kind}"), "links")
    while _unsettled(step):
        both = step.union(step.select("root", "node"))
        least = both.groupBy("node").agg(F.min("root").alias("low")).select("node", F.least("node", "low").alias("low"))
        large = kept(spread_join(both, least, "node").where("root > node").select(F.col("root").alias("node"), F.col("low").alias("root")).where("node <> root").distinct(), "large")
        least = large.groupBy("node").agg(F.min("root").alias("low"))
        small = spread_join(large, least, "node").where("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root")).union(least.select("node", "low"))
        step = kept(small.distinct(), "small")
    return step


def _unsettled(step: DataFrame) -> bool:
    """Whether some node still has several roots, or a root has a root itself."""
    several = step.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    chained = step.join(step.select(F.col("root").alias("node")).distinct(), "node", "left_semi").select("node")
    return not several.union(chained).isEmpty()
