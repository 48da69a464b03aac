"""Consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, text_of

#: Points of each shard on the ring, and cells of the ring in which a key's point is looked up.
VIRTUAL_NODES, CELLS = 128, 4096
RING = 1 << 32


def ring_points(spark: SparkSession, shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """The ring's points clockwise, each (position, shard); as many as shards * virtual_nodes."""
    at = F.shiftrightunsigned(F.xxhash64(F.concat_ws(":", F.lit("node"), (F.col("id") / virtual_nodes).cast("long"), F.col("id") % virtual_nodes)), 32)
    rows = spark.range(shards * virtual_nodes, numPartitions=1).select(at.alias("at"), (F.col("id") / virtual_nodes).cast("int").alias("shard"), "id").collect()
    return [(r["at"], r["shard"]) for r in sorted(rows, key=lambda r: (r["at"], r["id"]))]


def flows(points: list[tuple[int, int]], counts: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Which keys go where: (arc, first, end, shard, slot of the first), by a key's number within its arc.

    Arc k holds the keys between point k-1 and point k. A shard takes the keys of its own arcs,
    clockwise, until it is full; the rest continue clockwise from their arc in their order
    and go to the next shards with room.
    """
    room, out, over = list(capacity), [], []
    slot = [0] * len(capacity)

    def put(arc: int, first: int, n: int, shard: int) -> None:
        out.append((arc, first, first + n, shard, slot[shard]))
        room[shard] -= n
        slot[shard] += n

    for arc, (_, shard) in enumerate(points):
        n = min(counts[arc], room[shard])
        if n:
            put(arc, 0, n, shard)
        over.append((arc, n, counts[arc] - n))
    waiting: list[tuple[int, int, int]] = []
    for lap in range(2):
        for arc, (_, shard) in enumerate(points):
            while waiting and room[shard]:
                a, first, left = waiting[0]
                n = min(left, room[shard])
                put(a, first, n, shard)
                if n < left:
                    waiting[0] = (a, first + n, left - n)
                else:
                    waiting.pop(0)
            if not lap and over[arc][2]:
                waiting.append(over[arc])
    assert not waiting, "the capacities don't hold all keys"
    return out


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """Puts every row into one of ``shards`` shards whose row counts differ by one at most.

    A row's key is the hash of its id, a place on the ring; its shard is that of the next point
    clockwise. With N = q * shards + r rows, shards 0 to r-1 hold q+1 rows at most and the others q: what
    a full shard can't take continues clockwise. DataFrame functions only; nothing is gathered but
    the ring's points and the number of keys between them, whose count the parameters bound.

    Returns doc_id, size (UTF-8 bytes and 8), text_crc32, shard, slot (from 0, without gaps within a shard).
    Null text: no bytes. Null ids share one place on the ring; rows of one id, repeated rows among them,
    are ordered by size, checksum and place in the input, and overflow like others. Extra columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    raw = text_of(text_col).cast("binary")
    place = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("long")), 32)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw).cast("long") + 8).alias("size"), F.crc32(raw).alias("text_crc32"), place.alias("place"))
    rows = kept(rows, "rows")

    # The points as intervals within cells, so that the lookup is an equi-join of bounded size.
    points = ring_points(spark, shards, virtual_nodes)
    width, cells, low = RING // CELLS, [], 0
    for arc, (at, _) in [*enumerate(points), (0, (RING - 1, 0))]:  # beyond the last point the ring closes
        for c in range(low // width, at // width + 1) if at >= low else ():
            cells.append((c, max(low, c * width), min(at + 1, (c + 1) * width), arc))
        low = max(low, at + 1)
    intervals = spark.createDataFrame(cells, "cell int, low long, high long, arc int")
    cell = (F.col("place") / width).cast("int")
    found = rows.withColumn("cell", cell).join(F.broadcast(intervals), "cell").where("place >= low and place < high")

    # Numbers within arcs, without a task for each arc: sorted ranges, each row's number in its
    # partition, and the rows of each arc in the partitions before.
    found = found.select("doc_id", "size", "text_crc32", "arc", "place", F.monotonically_increasing_id().alias("tie"))
    keys = ["arc", "place", "doc_id", "size", "text_crc32", "tie"]
    ranged = found.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "size", "text_crc32", "arc", F.monotonically_increasing_id().alias("at"))
    ranged = kept(ranged.withColumn("pid", F.shiftrightunsigned("at", 33).cast("int")), "ranged")
    held = ranged.groupBy("pid", "arc").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least")).collect()
    counts, seen = [0] * len(points), []
    for r in sorted(held, key=lambda r: (r["pid"], r["arc"])):
        seen.append((r["pid"], r["arc"], counts[r["arc"]] - r["least"]))
        counts[r["arc"]] += r["n"]
    total = sum(counts)
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    base = spark.createDataFrame(seen or [(0, 0, 0)], "pid int, arc int, shift long")
    flow = spark.createDataFrame(flows(points, counts, capacity) or [(0, 0, 0, 0, 0)], "arc int, first long, end long, shard int, slot0 long")
    number = F.col("at") + F.col("shift")
    out = ranged.join(F.broadcast(base), ["pid", "arc"]).withColumn("number", number).join(F.broadcast(flow), "arc").where("number >= first and number < end")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("number") - F.col("first")).alias("slot"))
