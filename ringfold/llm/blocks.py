"""Exact corpus-wide counts for blocks of documents, without any task holding all of them.

A partition's documents are cut into blocks, which are written once as word numbers; everything later reads
these blocks, so that a lost executor or another order of reading can't pair a block with another's counts.
Each block sends the sorted distinct keys that it has (hashes of words, word pairs, shingles), with its own
counts, to the owners of the keys' ranges; an owner adds up what all blocks have sent and answers each block
with the totals of exactly the keys that it sent. A block and the answers to it meet by the block's number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lowered, rows_at_once

#: Words from which a block is closed; one document is never cut. Larger blocks send fewer messages and repeat fewer
#: keys; a worker holds some 100 bytes a word. Corpora of many TB on large executors want more.
BLOCK_WORDS = 1 << 18
#: Estimated bytes of input for each owner of a kind of key: what an owner adds up at once follows it.
OWNER_BYTES = 4 << 20
#: Rows of whole texts that are sent to a worker at once: it reads one after the other, but JVM and worker hold all that are sent.
ROWS = 256
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the pairs (a, b), in order."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(29))) * _M1 + b
        x = (x ^ (x >> np.uint64(32))) * _M2
        return x ^ (x >> np.uint64(29))


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _planes(a: np.ndarray) -> bytes:
    """Compressed bytes of an array, those of equal weight together."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)


def _unplanes(b: bytes, dtype: str, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, n).T).reshape(-1).view(dtype)


def pack_totals(a: np.ndarray) -> bytes:
    """In 32 bits where all fit, else in 64."""
    return _planes(a.astype("<u4" if a.max(initial=0) <= 0xFFFFFFFF else "<u8"))


def unpack_totals(b: bytes, n: int) -> np.ndarray:
    wide = zstandard.frame_content_size(b) == 8 * n
    return _unplanes(b, "<u8" if wide else "<u4", n)


def pack_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unplanes(b, "<u8", n), dtype=np.uint64)


@dataclass
class Block:
    """Documents as word numbers: those of document i are words[ends[i-1]:ends[i]]; table has the words' hashes."""

    doc_ids: list[int | None]
    flags: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    table: np.ndarray

    def encode(self) -> tuple:
        lens = np.diff(self.ends, prepend=np.int64(0))
        return self.doc_ids, _planes(self.flags), _planes(lens), _planes(self.words), self.table.tobytes(), len(self.words)

    @classmethod
    def decode(cls, doc_ids: list, flags: bytes, lens: bytes, words: bytes, table: bytes, n: int) -> Block:
        k = len(doc_ids)
        return cls(doc_ids, _unplanes(flags, "u1", k), np.cumsum(_unplanes(lens, "<i8", k)), _unplanes(words, "<i4", n), np.frombuffer(table, "<u8"))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def read_blocks(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[Block]:
    """Blocks of (doc_id, text, flag) rows."""
    numbers, ids, flags, lens, words, total = _Numbers(), [], [], [], [], 0

    def close() -> Block:
        all_words = np.concatenate(words) if words else np.zeros(0, np.int32)
        table = np.fromiter(map(word_hash, numbers), np.uint64, len(numbers))
        return Block(ids, np.array(flags, np.uint8), np.cumsum(np.array(lens, np.int64)), all_words, table)

    for b in batches:
        for i, text, flag in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            own = lowered(text.as_py()).split()
            ids.append(i)
            flags.append(flag)
            lens.append(len(own))
            words.append(np.fromiter(map(numbers.__getitem__, own), np.int32, len(own)))
            total += len(own)
            if total >= block_words:
                yield close()
                numbers, ids, flags, lens, words, total = _Numbers(), [], [], [], [], 0
    if ids:
        yield close()


#: What a block asks about: for each kind of key, sorted distinct keys and its own counts of them.
Ask = Callable[[Block], list[tuple[np.ndarray, np.ndarray]]]
_ASKED = "block long, owner int, n long, keys binary, counts binary"
_TOLD = "block long, owner int, told binary, n long, kinds long, total long"
_DOCS = "block long, doc_ids array<long>, flags binary, lens binary, words binary, hashes binary, n long"
_BLOCK = ("block", "doc_ids", "flags", "lens", "words", "hashes", "n")


def _decoded(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, Block]]:
    columns = [rows.column(c) for c in _BLOCK]
    for k in range(rows.num_rows):
        at, *parts = (c[k].as_py() for c in columns)
        yield at, Block.decode(*parts)


def _owners(rows: DataFrame) -> int:
    """As many as the session's shuffle partitions, or more for more input, by the optimizer's estimate where it has one."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    few = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Plans of unknown size say the greatest long number.
    return max(few, min(size // OWNER_BYTES, 1 << 14)) if size < 1 << 60 else few


def exchange(rows: DataFrame, ask: Ask | list[Ask], answer: Callable[[Block, list[np.ndarray]], Iterator[pa.RecordBatch]], schema: str, keep: Callable[[DataFrame], DataFrame], block_words: int = BLOCK_WORDS, totals: list | None = None) -> DataFrame:
    """answer(block, corpus counts of the keys of each kind) for each block of rows (doc_id, text, flag).

    Several asks, of one kind of key each, are asked and answered one after the other, so that the keys of one kind at a
    time are under way. keep materialises the blocks and the owners' answers. totals, if given, gets (distinct keys counted above 0,
    sum of counts) of each kind before answer is called.
    """
    owners = _owners(rows)
    splits = np.array([(i << 64) // owners for i in range(1, owners)], dtype=np.uint64)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        for k, block in enumerate(read_blocks(batches, block_words)):
            row = ((TaskContext.get().partitionId() << 24) + k, *block.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=list(_BLOCK))

    def send(batches: Iterator[pa.RecordBatch], turn: int, ask: Ask) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, block in _decoded(b):
                for kind, (keys, counts) in enumerate(ask(block), turn):
                    cut = [0, *np.searchsorted(keys, splits).tolist(), len(keys)]
                    out = []
                    for o in range(owners):
                        lo, hi = cut[o], cut[o + 1]
                        if hi > lo:
                            out.append((at, kind * owners + o, hi - lo, pack_keys(keys[lo:hi]), _planes(counts[lo:hi].astype("<u4"))))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "owner", "n", "keys", "counts"])

    def add_up(asked: pa.Table) -> pa.Table:
        blocks, lens = asked["block"].to_pylist(), asked["n"].to_pylist()
        owner = asked["owner"][0].as_py()
        keys = np.concatenate([unpack_keys(k.as_py(), n) for k, n in zip(asked["keys"], lens, strict=True)])
        counts = np.concatenate([_unplanes(c.as_py(), "<u4", n) for c, n in zip(asked["counts"], lens, strict=True)])
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        del keys
        first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        del ordered
        sums = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(first))
        mine = np.empty(len(order), np.int64)
        mine[order] = sums[np.cumsum(first) - 1]
        del order, first, counts
        told, at = [], 0
        for n in lens:
            told.append(pack_totals(mine[at : at + n]))
            at += n
        pa.default_memory_pool().release_unused()  # groups differ in size, and a worker outlives them
        k = len(blocks)
        stats = [int((sums > 0).sum())] + [0] * (k - 1), [int(sums.sum())] + [0] * (k - 1)
        return pa.table([pa.array(blocks, pa.int64()), pa.array([owner] * k, pa.int32()), pa.array(told, pa.binary()), pa.array(lens, pa.int64()), pa.array(stats[0], pa.int64()), pa.array(stats[1], pa.int64())], names=["block", "owner", "told", "n", "kinds", "total"])

    def meet(docs: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for _, block in _decoded(docs):
            parts = sorted(zip(told["owner"].to_pylist(), told["n"].to_pylist(), range(len(told)), strict=True))
            kinds: dict[int, list[np.ndarray]] = {}
            for owner, n, k in parts:
                kinds.setdefault(owner // owners, []).append(unpack_totals(told["told"][k].as_py(), n))
            totals_ = [np.concatenate(kinds[k]) if k in kinds else np.zeros(0, "<u4") for k in range(1 + max(kinds, default=-1))]
            out += answer(block, totals_)
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out, out[0].schema)

    with rows_at_once(rows.sparkSession, ROWS):
        blocks = keep(rows.mapInArrow(write, _DOCS))
    told = None
    for turn, one in enumerate(ask if isinstance(ask, list) else [ask]):
        asked = blocks.mapInArrow(partial(send, turn=turn, ask=one), _ASKED)
        answers = keep(asked.groupBy("owner").applyInArrow(add_up, _TOLD))
        told = answers if told is None else told.union(answers)
        del asked
        discard(rows.sparkSession)  # what was asked
    if totals is not None:
        found = {r["kind"]: (r["kinds"], r["total"]) for r in told.groupBy((F.col("owner") / owners).cast("int").alias("kind")).agg(F.sum("kinds").alias("kinds"), F.sum("total").alias("total")).collect()}
        totals += [found.get(k, (0, 0)) for k in range(1 + max(found, default=0))]
    return blocks.groupBy("block").cogroup(told.select("block", "owner", "told", "n").groupBy("block")).applyInArrow(meet, schema)
