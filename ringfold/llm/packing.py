"""Sum-of-squares online packing of documents into fixed token windows."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

WINDOW = 1024
#: The tokenizer's own splitting of texts before merges, as published with its vocabulary (a fixed value).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are looked over for runs without white space, and longer runs go to the slower
#: encoder, which takes any run in near-linear time.
LONG_TEXT, LONG_RUN = 20_000, 5_000


class Encoder:
    """Token ids of texts, by a byte-level BPE file of the ``tokenizers`` library.

    Its vocabulary's ids are the ranks of its merges, so ``tiktoken`` gives the same ids in a third
    of the time. Strings of added tokens inside a text are ordinary text, or with ``added`` these tokens, as
    the library has it by default; texts with such strings then go to the library's encoder.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.added = sorted(special) if added else []
        if not added:
            self.tokenizer.encode_special_tokens = True
        # Byte-level vocabularies write printable bytes as themselves and the others as 256, 257, ...
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in self.tokenizer.get_vocab().items() if t not in special}
        self.fast = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self.added) or len(text) > LONG_TEXT and max(map(len, text.split()), default=0) > LONG_RUN:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return array("I", ids).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, added: bool = False) -> Encoder:
    """One for each worker process."""
    return Encoder(path, added)


class Packer:
    """Online packing of pieces into windows by the sum-of-squares rule.

    ``levels[h]`` counts the windows filled up to level h. A piece of size s goes to the
    level (or a new window) for which the sum of ``levels ** 2`` over partial windows
    becomes least; of equal choices the fullest window wins.
    """

    def __init__(self, window: int, max_open: int | None, first_id: int):
        self.window, self.max_open, self.next = window, max_open, first_id
        self.levels = np.zeros(window + 1, dtype=np.int64)
        #: Open windows by level, each the list of its pieces (doc, start, ids, doc_tokens).
        self.open: dict[int, list[list[tuple]]] = {}
        self.count = 0

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at, seq = 0, self.next
        self.next += 1
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), total, seq, at
            at += n

    def add(self, piece: tuple) -> Iterator[tuple]:
        w, n, size = self.window, self.levels, len(piece[2]) // 4
        if size == w:
            yield from self._close([piece])
            return
        # Change of the sum of squares for each level h that can take the piece; 0 is a new window.
        h = np.arange(0, w - size + 1)
        gain = 2 * n[h + size] + 1
        gain[-1] = 0  # a full window is no longer partial
        gain[1:] += 1 - 2 * n[1 : w - size + 1]
        gain[1:][n[1 : w - size + 1] == 0] = np.iinfo(np.int64).max
        level = int(len(gain) - 1 - np.argmin(gain[::-1]))
        pieces = []
        if level:
            pieces = self.open[level].pop()
            n[level] -= 1
            self.count -= 1
        pieces.append(piece)
        if level + size == w:
            yield from self._close(pieces)
            return
        self.open.setdefault(level + size, []).append(pieces)
        n[level + size] += 1
        self.count += 1
        if self.max_open is not None and self.count > self.max_open:
            yield from self.settle(end=False)

    def settle(self, end: bool = True) -> Iterator[tuple]:
        """Fills up open windows, fullest first, with the pieces of the emptiest ones, cut where needed.
        At most the last window stays partial; it is kept open unless this is the end."""
        windows = [pieces for level in sorted(self.open, reverse=True) for pieces in self.open[level]]
        fills = [sum(len(p[2]) for p in pieces) // 4 for pieces in windows]
        i, j = 0, len(windows) - 1
        while i < j:
            while fills[i] < self.window and i < j:
                doc, start, ids, total = windows[j].pop()
                size = len(ids) // 4
                take = min(self.window - fills[i], size)
                windows[i].append((doc, start, ids[: 4 * take], total))
                fills[i] += take
                if take < size:
                    windows[j].append((doc, start + take, ids[4 * take :], total))
                fills[j] -= take
                if not fills[j]:
                    j -= 1
            if fills[i] == self.window:
                yield from self._close(windows[i])
                i += 1
        rest = windows[i : j + 1]
        self.open, self.count = {}, 0
        self.levels[:] = 0
        for pieces in rest:
            fill = sum(len(p[2]) for p in pieces) // 4
            if end or fill == self.window:
                yield from self._close(pieces)
            elif fill:
                self.open[fill] = [pieces]
                self.levels[fill] = self.count = 1


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 0, max_open: int | None = None, added: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most ``window`` tokens; a row for each piece.

    A document is its text's token ids (``added``: see Encoder) and one ``end_id``. Each task packs its own
    partition online: whole windows of a long document become sequences of their own, the
    rest goes to the fill level that the sum-of-squares rule picks. What is partial at a task's end is cut
    and filled up, which leaves one padded sequence a task. Open windows hold less than the task's own
    tokens; ``max_open`` bounds them where that is wanted, by filling them up earlier. No shuffle.

    Null or empty text: only the end id; texts of any length are encoded whole. Null ids stay null; repeated rows are packed each for
    itself; ties go to the fullest window; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, added)
        packer = Packer(window, max_open, TaskContext.get().partitionId() << 32)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        schema = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

        rows: list[tuple] = []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    rows += packer.add((doc, start, ids[4 * start : 4 * (start + window)], total))
                if len(rows) >= 20_000:
                    yield batch(rows)
                    rows = []
        rows += packer.settle()
        if rows:
            yield batch(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, SCHEMA)
