"""Exact deduplication by sorting whole contents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, lowered, text_of

#: First bytes of a text, and bytes of its digest, by which splitters tell texts apart: what bounds a sampled key.
HEAD, MARK = 32, 16

_ROWS = pa.schema([
    ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("pid", pa.int32()), ("run", pa.int64()),
    ("least", pa.int64()), ("most", pa.int64()), ("size", pa.int64()), ("edge", pa.int32()), ("text", pa.binary()),
])
_DDL = "doc_id long, text_sha256 string, pid int, run long, least long, most long, size long, edge int, text binary"
_LOW, _HIGH = 1, 2


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        norm = [lowered(t.as_py()) for t in b.column(1)]
        digests = [hashlib.sha256(t).digest() for t in norm]
        columns = [b.column(0), pa.array(norm, pa.binary()), pa.array([t[:HEAD] for t in norm], pa.binary()), pa.array([d[:MARK] for d in digests], pa.binary()), pa.array([d.hex() for d in digests], pa.string()), b.column(2)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "norm", "head", "mark", "text_sha256", "tie"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by their bytes; each is compared in full with its neighbour. A row gets its run's number,
    size, least and greatest id within this partition. A run's ids are held until it ends. At the end
    come two edge rows: the runs of the least and the greatest splitting key, with their texts; only these
    can go on in the partitions before and after."""
    pid = TaskContext.get().partitionId()
    run, ids, out = -1, [], []
    text = digest = key = None
    edges: dict[int, tuple] = {}

    def flush() -> None:
        real = [i for i in ids if i is not None]
        found = (pid, run, min(real, default=None), max(real, default=None), len(ids))
        out.extend((i, digest, *found, 0, None) for i in ids)
        if not edges or key < edges[_LOW][0]:
            edges[_LOW] = (key, found, text)
        if _HIGH not in edges or key > edges[_HIGH][0]:
            edges[_HIGH] = (key, found, text)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)

    for b in batches:
        for k, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
            t = t.as_py()
            if run < 0 or t != text:
                if run >= 0:
                    flush()
                run, ids, text, digest = run + 1, [], t, b.column(2)[k].as_py()
                key = (t[:HEAD], digest[: 2 * MARK])
            ids.append(i)
        while len(out) >= 10_000:
            yield batch(out[:10_000])
            del out[:10_000]
    if run >= 0:
        flush()
    for k in range(0, len(out), 10_000):
        yield batch(out[k : k + 10_000])
    if edges:
        yield batch([(None, None, *edges[e][1], e, edges[e][2]) for e in (_LOW, _HIGH)])


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """Groups documents whose texts are equal after lower-casing A-Z; a row for each document, with
    doc_id, keep_id (the group's row that stays), group_size, kept, text_sha256 (of the normalised bytes).

    Sampled splitters deal the normalised bytes by ranges; each range is sorted by all its bytes (externally, by Spark), so
    that equals are adjacent, and neighbours are compared in full. A splitter holds a text's first bytes, a part of its
    digest, its id and a row number, which bounds what the driver samples, and deals a group of any size, or
    one of texts that begin alike, over several ranges. A group that lies in several ranges is in each the one of the
    least or the greatest splitting key: these are joined with the next partition's by comparing their texts,
    two a partition, in a join by partition number.

    ``keep`` is ``smallest`` (default) or ``largest`` identifier. Null text: the empty text. Texts of any length are
    sorted and compared whole. Null ids never stay where the group has another; repeated rows count each; extra columns
    are ignored; an empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.monotonically_increasing_id().alias("tie"))
    norm = rows.mapInArrow(_normalise, "doc_id long, norm binary, head binary, mark binary, text_sha256 string, tie long")
    ordered = norm.repartitionByRange("head", "mark", "doc_id", "tie").sortWithinPartitions("norm", "doc_id", "tie")
    runs = kept(ordered.select("doc_id", "norm", "text_sha256").mapInArrow(_runs, _DDL), "runs")

    # Two rows for each partition that has rows; the partition's order among them is `at`. As many rows as
    # partitions, so windows over all of them are small.
    low, high = (runs.where(F.col("edge") == e) for e in (_LOW, _HIGH))
    order = low.select("pid", F.row_number().over(Window.orderBy("pid")).alias("at"))
    before = high.join(order, "pid").select((F.col("at") + 1).alias("at"), F.col("text").alias("text_before"))
    both = low.select("pid", F.col("run").alias("low"), "text").join(high.select("pid", F.col("run").alias("high")), "pid").join(order, "pid").join(before, "at", "left")
    joined = kept(both.select("pid", "at", "low", "high", F.coalesce(F.col("text") == F.col("text_before"), F.lit(False)).alias("goes_on")), "joined")
    # Edge runs form chains: a partition's high run begins one, unless it is its low run too and goes on from before.
    chain = joined.withColumn("begins", F.when(F.col("low") != F.col("high"), 1).otherwise(1 - F.col("goes_on").cast("int")))
    chain = chain.withColumn("chain_high", F.sum("begins").over(Window.orderBy("at")))
    chain = chain.withColumn("chain_before", F.lag("chain_high").over(Window.orderBy("at")))
    ends = chain.select("pid", F.col("high").alias("run"), F.col("chain_high").alias("chain")).union(chain.where("goes_on and low <> high").select("pid", "low", "chain_before"))
    parts = runs.where("edge > 0").groupBy("pid", "run").agg(*(F.max(c).alias(c) for c in ("least", "most", "size")))
    ends = kept(ends.join(parts, ["pid", "run"]), "ends")
    total = ends.groupBy("chain").agg(F.min("least").alias("all_least"), F.max("most").alias("all_most"), F.sum("size").alias("all_size"))
    # Two rows a partition at most: a size that the number of partitions bounds.
    whole = kept(ends.select("pid", "run", "chain").join(total, "chain").drop("chain"), "whole")

    own, all_ = ("least", "all_least") if keep == "smallest" else ("most", "all_most")
    out = runs.where("edge = 0").drop("edge", "text").join(F.broadcast(whole), ["pid", "run"], "left")
    keep_id = F.coalesce(F.col(all_), F.col(own))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("all_size", "size").alias("group_size"), F.coalesce(F.col("doc_id") == keep_id, F.lit(False)).alias("kept"), "text_sha256")
