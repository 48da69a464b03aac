"""SentencePiece encoding and decoding: the best-scoring pieces of a text, and back."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Stands for a space inside pieces (a fixed value of the format).
SPACE = "▁"
#: What a character without piece costs beyond the worst piece; it becomes bytes.
UNKNOWN = 10.0
#: Chunks whose pieces a worker remembers at most, and ids from which a batch is sent on.
CACHE, BATCH_IDS = 300_000, 4_000_000
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Pieces:
    """A piece vocabulary as an Aho-Corasick automaton.

    encode() finds the segmentation with the greatest sum of scores in one pass: the automaton reports, at each
    position, the longest piece that ends there and by its output links all shorter ones; each
    relaxes the best score at that position. A space becomes the mark of the format, one more is put in front;
    characters without piece become their UTF-8 bytes, as does the mark itself where a text has it.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton, self.bytes = ahocorasick.Automaton(), [0] * 256
        self.shown: list[bytes] = [b""] * model.get_piece_size()
        worst, joined = 0.0, False
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.shown[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                score = model.get_score(i)
                worst = min(worst, score)
                joined |= SPACE in piece.lstrip(SPACE)
                self.automaton.add_word(piece, (i, len(piece), score))
                self.shown[i] = piece.replace(SPACE, " ").encode()
        self.automaton.make_automaton()
        self.unknown = worst - UNKNOWN
        #: No piece goes on beyond a space, so a text is the sum of its chunks; else it is one chunk.
        self.chunks = (lambda s: [s]) if joined else _CHUNK.findall
        self.known: dict[str, tuple[bytes, float]] = {}

    def best(self, chunk: str) -> tuple[list[int], float]:
        """Ids and score of one chunk by a single Viterbi pass."""
        n = len(chunk)
        score, back = [0.0] * (n + 1), [(-1, 1)] * (n + 1)
        unknown, at = self.unknown, 0
        for last, (i, size, value) in self.automaton.iter(chunk):
            end = last + 1
            while at < end:
                at += 1
                score[at] = score[at - 1] + unknown
            value += score[end - size]
            if value > score[end]:
                score[end], back[end] = value, (i, size)
        while at < n:
            at += 1
            score[at] = score[at - 1] + unknown
        out, end = [], n
        while end:
            i, size = back[end]
            out += [i] if i >= 0 else [self.bytes[b] for b in reversed(chunk[end - 1].encode("utf-8", "surrogatepass"))]
            end -= size
        return out[::-1], score[n]

    def encode(self, text: str) -> tuple[bytes, float]:
        """Ids, as little-endian 32-bit numbers, and their score. The empty text has none."""
        if not text:
            return b"", 0.0
        if SPACE in text:  # the mark itself is a character without piece
            parts, ids, total = (" " + text).split(SPACE), [], 0.0
            mark = np.array([self.bytes[b] for b in SPACE.encode()], "<i4").tobytes()
            for k, part in enumerate(parts):
                own = self._encode(part.replace(" ", SPACE))
                ids += [mark, own[0]] if k else [own[0]]
                total += own[1] + (self.unknown if k else 0.0)
            return b"".join(ids), total
        return self._encode(SPACE + text.replace(" ", SPACE))

    def _encode(self, s: str) -> tuple[bytes, float]:
        if len(self.known) > CACHE:
            self.known.clear()
        known, found = self.known, []
        for chunk in self.chunks(s):
            one = known.get(chunk)
            if one is None:
                ids, score = self.best(chunk)
                one = known[chunk] = np.array(ids, "<i4").tobytes(), score
            found.append(one)
        return b"".join([ids for ids, _ in found]), sum(score for _, score in found)

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for; the first space is the one that encoding has put in front."""
        return b"".join(map(self.shown.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One for each worker process."""
    return Pieces(path)


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), n_ids, score, and round_trip: whether decoding gives back the whole text.

    No shuffle; a task holds its vocabulary, a bounded memory of chunks, and one batch of texts.
    Null or empty text: no ids, score 0. Null ids stay null; repeated rows are encoded each; ties go to the
    longer last piece; extra columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            ids = [r[1] for r in rows]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), lists, pa.array(np.diff(ends).astype(np.int64)), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.bool_())], names=["doc_id", "ids", "n_ids", "score", "round_trip"])

        rows, size = [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                ids, score = own.encode(text)
                rows.append((i, ids, score, own.decode(np.frombuffer(ids, "<i4").tolist()) == text))
                size += len(ids) // 4
                if size >= BATCH_IDS:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_ids long, score double, round_trip boolean")


def decode_ids(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of id arrays. Null or empty arrays: the empty text. An id outside the vocabulary fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode(x.as_py() or []) for x in b.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
