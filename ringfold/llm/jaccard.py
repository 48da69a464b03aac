"""N-gram Jaccard join, size-aware: subsets of small sets, inverted lists of large ones."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_WORDS, Block, exchange, mix
from .common import discard, kept, spread_join, text_of
from .components import components

#: Words of a shingle, and the least Jaccard similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Set sizes at which small may end; the cost decides.
BOUNDARIES = (0, 8, 16, 32, 64, 128)


def shingle_sets(block: Block, k: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Of each document the sorted distinct hashes of its k-word shingles, and their digest (empty: no set)."""
    sets, digests = [], []
    start = 0
    hashes = block.table[block.words] if len(block.words) else np.zeros(0, np.uint64)
    rolled = hashes
    for j in range(1, k):
        rolled = mix(rolled[:-1], hashes[j:]) if len(hashes) > j else rolled[:0]
    for end in block.ends.tolist():
        n = end - start
        if n >= k:
            own = np.unique(rolled[start : end - k + 1])
        elif n:
            one = np.full(1, n, np.uint64)
            for j in range(start, end):
                one = mix(one, hashes[j : j + 1])
            own = one
        else:
            own = np.zeros(0, np.uint64)
        sets.append(own)
        digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if n else b"")
        start = end
    return sets, digests


def _first(digests: list[bytes]) -> list[int]:
    """The first document of each set in a block."""
    seen: dict[bytes, int] = {}
    for i, d in enumerate(digests):
        if d:
            seen.setdefault(d, i)
    return list(seen.values())


_SETS = "n long, digest binary, ids array<long>, least long, keys array<struct<key:long,pos:int>>, elements array<long>, bits array<long>"
_KEY = pa.struct([("key", pa.int64()), ("pos", pa.int32())])
#: 64-bit words of a set's parity bits.
BITS = 8


def parity(elements: np.ndarray) -> np.ndarray:
    """BITS words in which each element flips one bit. Two sets' words differ in no more bits than the sets
    differ in elements, so that too many differing bits rule a pair out without its elements."""
    counts = np.bincount((elements % np.uint64(64 * BITS)).astype(np.int64), minlength=64 * BITS) & 1
    return np.packbits(counts.astype(np.uint8), bitorder="little").view("<i8")


def _similar(n: Column, m: Column, both: Column, percent: int) -> Column:
    return 100 * both >= percent * (n + m - both)


def _possible(a: str, b: str, percent: int) -> Column:
    """Whether the sizes, and what is left from the shared key on in the global order, allow similarity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * left >= percent * (n + m))


def _few_differ(a: str, b: str, percent: int) -> Column:
    """Whether the parity bits allow similarity: similar sets differ in (100 - p) / (100 + p) of their elements at most."""
    differ = sum((F.bit_count(F.col(f"{a}.bits")[k].bitwiseXOR(F.col(f"{b}.bits")[k])) for k in range(BITS)), F.lit(0))
    return (100 + percent) * differ.cast("long") <= (100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _verified(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar. The set of a goes along with the pair to the set of b.
    Pairs name as b the node that more pairs have: these differ in a, and where they are too many for one task, the
    adaptive skew join splits them and copies b's set to each part."""
    x = reps.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("elements").alias("x"))
    y = reps.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("elements").alias("y"))
    joined = kept(pairs, "pairs").join(x, "a").join(y, "b")
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return joined.where(_similar(F.col("n"), F.col("m"), both, percent)).select("a", "b")


def boundary(reps: DataFrame) -> int:
    """The set size up to which subsets cost less than scanning lists: rows written, against list entries that
    are written and each compared with its list's center. (Subsets seldom meet a partner by chance.)"""
    q = F.size("keys").cast("long")
    per = reps.groupBy(F.floor(F.log2(F.col("n").cast("double"))).alias("power")).agg(F.sum(q * (q - 1) / 2).alias("subsets"), F.sum(2 * q).alias("lists")).collect()
    costs = {}
    for b in BOUNDARIES:
        power = b.bit_length() - 1 if b else -1
        # Sets just above the boundary need subsets too, for partners below it.
        costs[b] = sum((r["subsets"] if r["power"] <= power and b else 0) + (r["lists"] if r["power"] >= power else 0) for r in per)
    return min(BOUNDARIES, key=lambda b: (costs[b], b))


def _lists(reps: DataFrame, small: int, percent: int) -> DataFrame:
    """Inverted lists (key, node, n, pos). Sets below ``small``, and those that may pair with them, are listed
    under every two of their prefix elements; sets from ``small`` on under single ones, and so are sets so small
    that one common element may do (two such sets have 100 / percent elements at most)."""
    singles = (F.col("n") >= small) | (percent * F.col("n") <= 100)
    one = reps.where(singles).select(F.explode("keys").alias("k"), "node", "n").select("k.key", "node", "n", "k.pos")
    if not small:
        return one
    few = reps.where(percent * F.col("n") < 100 * small)
    two = few.select(F.posexplode("keys").alias("i", "k"), "keys", "node", "n").select(F.col("k").alias("k1"), F.explode(F.expr("slice(keys, i + 2, size(keys))")).alias("k2"), "node", "n")
    return one.union(two.select(F.xxhash64("k1.key", "k2.key", F.lit("two")).alias("key"), "node", "n", "k1.pos"))


def similar_sets(reps: DataFrame, percent: int) -> DataFrame:
    """Links between nodes that tie exactly the sets together which all similar pairs would; as components() has them.

    First every set is held against one set of each of its lists: the most central one, which has the
    fewest rarer elements of its own. What links is contracted. Then, in lists that still hold several
    components, members outside the list's largest component are held against the others, but only where sizes, places
    and parity bits leave similarity possible, which is decided in the join: pairs that are written are nearly all
    links. A list's members are dealt by bands of sizes, since only sets of like sizes pair.
    """
    reps = kept(reps, "reps")
    lists = kept(_lists(reps, boundary(reps), percent), "lists")
    hub = F.min(F.struct("pos", F.xxhash64("node").alias("h"), "node", "n")).alias("hub")
    hubs = kept(lists.groupBy("key").agg(F.count(F.lit(1)).alias("size"), hub).where("size > 1").select("key", "hub"), "hubs")
    found = lists.alias("s").join(hubs, "key").where(F.col("s.node") != F.col("hub.node")).where(_possible("s", "hub", percent))
    # The hub is the one that many pairs have.
    pairs = found.select(F.col("s.node").alias("a"), F.col("hub.node").alias("b")).distinct()
    tied = kept(components(_verified(pairs, reps, percent)), "tied")

    named = lists.join(tied.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = kept(named, "named")
    discard(reps.sparkSession, [lists, hubs])
    parts = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    open_ = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("size", "root")).alias("main")).where("parts > 1")
    open_ = kept(open_.select("key", F.col("main.root").alias("main")), "open")
    # Sizes that may pair are in the same band or in neighbouring ones, whose width is a trifle more than 100 / percent.
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent) * 1.000001)).cast("int") if percent < 100 else F.col("n").cast("int")
    members = named.join(open_, "key").join(reps.select("node", "bits"), "node").withColumn("band", band)
    members = kept(members, "members")
    discard(reps.sparkSession, [named, open_])
    few = members.where("root <> main").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    s, t = few.alias("s"), members.alias("t")
    across = s.join(t, (F.col("s.key") == F.col("t.key")) & (F.col("s.band") == F.col("t.band")) & (F.col("s.root") != F.col("t.root")) & ((F.col("t.root") == F.col("s.main")) | (F.col("s.node") < F.col("t.node"))) & _possible("s", "t", percent) & _few_differ("s", "t", percent))
    pairs = across.select(F.col("s.node").alias("a"), F.col("t.node").alias("b")).distinct()
    out = components(_verified(pairs, reps, percent).union(tied.select("node", "root")))
    discard(reps.sparkSession, [reps, members, tied])
    return out


def _node(least: str, digest: str) -> Column:
    """A set's name, in the order of its least id: 8 bytes, after a byte that is 1 where no id is known, and its digest."""
    at = F.coalesce(F.col(least), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    return F.concat(F.when(F.col(least).isNull(), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), F.unhex(F.lpad(F.hex(at), 16, "0")), F.col(digest))


def _least(node: str) -> Column:
    """The id that a name begins with."""
    at = F.conv(F.hex(F.substring(node, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(F.substring(node, 1, 1) == F.unhex(F.lit("00")), at.cast("long"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Ties documents whose sets of distinct word shingles have a Jaccard similarity of ``percent`` or more; a row
    for each document with doc_id, n_shingles and component_id (the least id reachable by links).

    Words are lower-cased (A-Z); a text of fewer words than a shingle is one shingle. Shingles are 64-bit hashes.
    Sets are ordered by how many sets of the corpus have an element, so that similar sets share rare elements at their
    beginning; elements that no other set has are never listed. Small sets are listed under pairs of elements,
    large ones under single elements, and the boundary is where the counted costs are least. Equal sets are one
    node, named so that the least name of a component has its least id. Verification intersects whole sets. No list
    is cut off: see similar_sets.

    Null, empty or blank texts: no shingles, their own component. Null ids are ignored in component ids unless a
    component has no other; repeated rows share a component; extra columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.lit(1).alias("flag"))

    def ask(block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
        sets, digests = shingle_sets(block, shingle)
        firsts = [sets[i] for i in _first(digests)]
        keys, counts = np.unique(np.concatenate(firsts) if firsts else np.zeros(0, np.uint64), return_counts=True)
        return [(keys, counts)]

    def answer(block: Block, told: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sets, digests = shingle_sets(block, shingle)
        firsts = _first(digests)
        keys = np.unique(np.concatenate([sets[i] for i in firsts])) if firsts else np.zeros(0, np.uint64)
        if len(keys) != (len(told[0]) if told else 0):
            raise RuntimeError("a block has another number of shingles than it has asked about")
        members: dict[bytes, list[int | None]] = {}
        for i, d in zip(block.doc_ids, digests, strict=True):
            members.setdefault(d, []).append(i)
        found, places, elements, bits, at = [], [], [], [], []
        for i in firsts:
            own = sets[i]
            held = told[0][np.searchsorted(keys, own)]
            alone = int((held == 1).sum())
            prefix = len(own) - (percent * len(own) + 99) // 100 + 2
            shared = np.zeros(0, np.int64)
            if alone < prefix:
                order = np.lexsort((own, held))[:prefix]
                shared = np.flatnonzero(held[order] > 1)
            at.append(len(shared) > 0)
            if len(shared):
                found.append(own[order[shared]].view(np.int64))
                places.append(shared.astype(np.int32))
                elements.append(own.view(np.int64))
                bits.append(parity(own))

        def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
            """A list for each listed set, null for the others."""
            lens = iter(map(len, parts))
            ends = np.cumsum([0] + [next(lens) if x else 0 for x in at])
            values = kind if isinstance(kind, pa.Array) else pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
            offsets = pa.array([None if i < len(at) and not at[i] else e for i, e in enumerate(ends.tolist())], pa.int32())
            return pa.ListArray.from_arrays(offsets, values)

        flat = [pa.array(np.concatenate(x) if x else np.zeros(0), t) for x, t in ((found, pa.int64()), (places, pa.int32()))]
        keyed = pa.StructArray.from_arrays(flat, names=["key", "pos"])
        names = [digests[i] for i in firsts]
        ids = [members[d] for d in names]
        least = [min((i for i in m if i is not None), default=None) for m in ids]
        columns = [pa.array([len(sets[i]) for i in firsts], pa.int64()), pa.array(names, pa.binary()), pa.array(ids, pa.list_(pa.int64())), pa.array(least, pa.int64()), lists(found, keyed), lists(elements, pa.int64()), lists(bits, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SETS.split(", ")])
        if b"" in members:
            none = members[b""]
            columns = [pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([none], pa.list_(pa.int64())), *(pa.nulls(1, c.type) for c in columns[3:])]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SETS.split(", ")])

    # A row for each distinct set of a block, with the ids of all its documents there.
    made: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        made.append(kept(df, "counts"))
        return made[-1]

    sets = kept(exchange(rows, ask, answer, _SETS, keep, block_words), "sets")
    discard(docs.sparkSession, made)
    real = sets.where("digest is not null")
    groups = real.groupBy("digest").agg(F.min("least").alias("least"), F.sum(F.size("ids")).alias("size")).withColumn("node", _node("least", "digest"))
    groups = kept(groups, "groups")
    reps = real.where("keys is not null").groupBy("digest").agg(*(F.first(c).alias(c) for c in ("n", "keys", "elements", "bits")))
    reps = reps.join(groups.select("digest", "node"), "digest").drop("digest")
    tied = similar_sets(reps, percent)
    # Sets of one document that is tied to none need no join.
    linked = tied.select("node", "root").union(tied.select(F.col("root").alias("node"), "root").distinct())
    several = groups.join(linked, "node", "left").where("root is not null or size > 1").withColumn("name", F.coalesce("root", "node")).select("digest", _least("name").alias("component_id"))
    several = kept(several, "several")
    out = spread_join(real.select("digest", "n", "ids"), several, "digest", "left")
    none = sets.where("digest is null").select("digest", "n", "ids", F.lit(None).cast("long").alias("component_id"))
    each = out.select("digest", "n", "ids", "component_id").union(none).select(F.explode("ids").alias("doc_id"), "n", "component_id")
    return each.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
