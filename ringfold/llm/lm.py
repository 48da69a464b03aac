"""Language-model scoring by a weighted backoff automaton."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_WORDS, Block, exchange, mix, word_hash
from .common import kept, remainder, text_of

#: Words of the longest n-gram.
ORDER = 2
#: Words of a block, more than elsewhere: n-grams of three kinds repeat less between larger blocks.
SCORED_WORDS = 3 * BLOCK_WORDS
#: Tokens for which an automaton is made at once: it takes some 440 bytes a token of a worker, 540 while it is made (check_s). No text is cut.
WALKED = 1 << 17
#: Weight of the shorter history: as many imagined occurrences after each history, dealt as after the shorter one.
PRIOR = 500.0
#: Texts' bounds; no word has white space in it.
START, END = np.uint64(word_hash(b" ")), np.uint64(word_hash(b"\n"))


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive, non-empty parts, each added up by itself."""
    return np.add.reduceat(values, np.concatenate(([0], ends[:-1]))) if len(ends) else np.zeros(0)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys, by sorting: np.unique alone hashes them first, which took 0.2 s instead of 0.01 s for one kind of a block."""
    ordered = np.sort(keys)
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return ordered[new]


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text with its END, and where the texts end."""
    ends = block.ends + np.arange(1, len(block.ends) + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, END, np.uint64)
    own = np.ones(len(out), bool)
    own[ends - 1] = False
    out[own] = block.table[block.words]
    return out, ends


def _levels(hashes: np.ndarray, ends: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For n-grams of 1, 2, ... tokens: the key of the one that ends at each place, the places that have one, and
    each place's number within its text."""
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    within = np.arange(len(hashes)) - np.repeat(starts, np.diff(ends, prepend=0))
    at = hashes
    for j in range(1, order + 1):
        if j > 1:
            before = np.empty_like(at)
            before[1:] = at[:-1]
            if j == 2:
                before[starts] = START
            at = mix(before, hashes)
        yield at, np.flatnonzero(within >= j - 2), within


class Grams:
    """A block's n-grams: of each length j the sorted distinct keys, and which one ends at each place.

    A text is read as START and its tokens, so a place has n-grams of j tokens from the text's place j - 2 on;
    ``which[j]`` is the key's number there, ``place[j]`` a place of each key. A
    key of j tokens is mixed from that of the j - 1 tokens before the last one, its history, and the last one.
    """

    def __init__(self, hashes: np.ndarray, ends: np.ndarray, order: int):
        self.keys, self.which, self.place = [], [], []
        for at, where, self.within in _levels(hashes, ends, order):
            keys, which = np.unique(at[where], return_inverse=True)
            full, place = np.zeros(len(hashes), np.int64), np.zeros(len(keys), np.int64)
            full[where], place[which] = which, where
            self.keys.append(keys)
            self.which.append(full)
            self.place.append(place)


class Automaton:
    """The part of the corpus's backoff automaton that a block of texts walks through.

    States are the histories that the corpus has: the root (none), START, and each n-gram of fewer than ``order``
    tokens that it counts. A state has an arc for each token that the corpus has after its history, with
    log10 P(token | history), to the state of the longest known history then. For all other tokens it has a failure
    arc, to the state of its history without the first token, with the weight that the shorter history has. The
    root has an arc for every token, unseen ones too. Discounting is linear: a history of c occurrences keeps
    c / (c + prior) of its mass for what it has been followed by, so each state's probabilities add up to one.

    An arc is an n-gram: the last token read in the state of those before it. So arcs have the n-grams' numbers,
    and a state of some depth (its tokens) finds its arc at a place by the n-gram of one token more that ends there.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], log_root: np.ndarray, texts: float, priors: list[float]):
        """counts: corpus counts of the keys of each length; log_root: log10 P of the keys of one token; texts: the
        corpus's texts, which are START's occurrences."""
        order = len(counts)
        # State numbers: 0 root, 1 START, then the keys of 1, 2, ... tokens; without histories there is the root alone.
        base = np.cumsum([2] + [len(k) for k in grams.keys[: order - 1]]).tolist()
        self.start = min(order - 1, 1)
        fail_to, fail = np.zeros(base[-1], np.int64), np.zeros(base[-1])
        known = counts[0] > 0
        p, weights, depths = 10.0**log_root, [log_root], [known * self.start]
        targets = [np.where(known, base[0] + np.arange(len(known)), 0) * self.start]
        #: For each depth, the number of each place's arc from there, below 0 where it fails.
        self.arcs, passed = [grams.which[0].tolist()], len(known)
        for j in range(2, order + 1):
            place, own, prior = grams.place[j - 1], counts[j - 1].astype(np.float64), priors[j - 2]
            opens = (grams.within[place] == 0) if j == 2 else np.zeros(len(place), bool)
            shorter = grams.which[j - 2][place - 1]  # the history, where it isn't START
            held = np.where(opens, texts, counts[j - 2][shorter]) if j == 2 else counts[j - 2][shorter].astype(np.float64)
            p = (own + prior * p[grams.which[j - 2][place]]) / (held + prior)
            weights.append(np.log10(p))
            targets.append(base[j - 1] + np.arange(len(place)) if j < order else base[j - 2] + grams.which[j - 2][place])
            depths.append(np.full(len(place), min(j, order - 1)))
            if len(place):
                self.arcs.append(np.where(own > 0, passed + np.arange(len(place)), -1)[grams.which[j - 1]].tolist())
            else:
                self.arcs.append([-1] * len(grams.within))
            passed += len(place)
            # The histories of j - 1 tokens fail to those of j - 2.
            n = counts[j - 2].astype(np.float64)
            mine = slice(base[j - 2], base[j - 2] + len(n))
            fail[mine] = np.log10(prior / (n + prior))
            fail_to[mine] = base[j - 3] + grams.which[j - 3][grams.place[j - 2]] if j > 2 else 0
            if j == 2:
                fail[1] = np.log10(prior / (texts + prior))
        self.weights, self.targets, self.depths = (np.concatenate(x).tolist() for x in (weights, targets, depths))
        self.fail, self.fail_to = fail.tolist(), fail_to.tolist()

    def walk(self, ends: list[int]) -> list[float]:
        """Log10 probability of each text: one walk from left to right that carries the state."""
        weights, targets, depths, fail, fail_to = self.weights, self.targets, self.depths, self.fail, self.fail_to
        places, out, at = zip(*self.arcs, strict=True), [], 0
        for end in ends:
            state = depth = self.start
            total = 0.0
            for arcs in islice(places, end - at):
                arc = arcs[depth]
                while arc < 0:
                    total += fail[state]
                    state = fail_to[state]
                    depth -= 1
                    arc = arcs[depth]
                total += weights[arc]
                state, depth = targets[arc], depths[arc]
            out.append(total)
            at = end
        return out


_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, prior: float | tuple[float, ...] = PRIOR, block_words: int = SCORED_WORDS, order: int = ORDER) -> DataFrame:
    """Scores every whole text under an n-gram model of the texts whose crc32(id) modulo ``folds`` isn't ``held``.

    Tokens are lower-cased (A-Z) words and one end. P(w) = (c(w)+1) / (N+V+1); P(w | h) =
    (c(h w) + prior P(w | h')) / (c(h) + prior), where h' is h without its first token and prior may differ by
    the length of h. As an automaton: an arc for each n-gram of the corpus of 2 to ``order`` tokens, a failure arc of
    weight prior / (c(h) + prior) to h' for the rest. All counts are exact and of the whole corpus; the
    automaton is never held in one place, as each block of texts gets the states and arcs that it walks through (see
    blocks), and then reads its texts from left to right.

    Null or empty text: the end alone. Null ids count as the empty id in the fold rule; repeated rows are learnt
    and scored each; texts of any length are read in full (a block holds one text at least);
    extra columns are ignored; an empty table gives no rows. With no training text N and V are 0.
    """
    priors = [float(prior)] * (order - 1) if isinstance(prior, (int, float)) else [float(x) for x in prior]
    if order < 1 or len(priors) != order - 1 or min(priors, default=1.0) <= 0:
        raise ValueError(f"order {order} takes {order - 1} priors above 0, not {prior}")
    fold = remainder(id_col, folds)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), (fold != held).cast("int").alias("flag"))
    totals: list[tuple[int, int]] = []

    def ask(block: Block, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        hashes, ends = tokens(block)
        trained = np.repeat(block.flags, np.diff(ends, prepend=0)).astype(np.float64)
        *_, (at, where, _) = _levels(hashes, ends, size)
        keys, which = np.unique(at[where], return_inverse=True)
        return [(keys, np.bincount(which, trained[where], len(keys)).astype(np.uint32))]

    def answer(block: Block, told: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        v, n = totals[0]
        hashes, ends = tokens(block)
        keys = [distinct(at[where]) for at, where, _ in _levels(hashes, ends, order)]
        told = [*told, *(np.zeros(0, "<u4") for _ in range(order - len(told)))]
        if any(len(k) != len(t) for k, t in zip(keys, told, strict=True)):
            raise RuntimeError("a block has another number of n-grams than it has asked about")
        texts = float(told[0][np.searchsorted(keys[0], END)])
        first = 0
        while first < len(ends):
            # An automaton for some texts at a time, one at least.
            start = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, start + WALKED, "right")))
            own, at = ends[first:last] - start, hashes[start : int(ends[last - 1])]
            grams = Grams(at, own, order)
            counts = [t[np.searchsorted(k, g)] for k, t, g in zip(keys, told, grams.keys, strict=True)]
            held_ = counts[0].astype(np.float64)
            log_root = np.log10((held_ + 1) / (n + v + 1))
            words = grams.which[0]
            score = Automaton(grams, counts, log_root, texts, priors).walk(own.tolist())
            size = np.diff(own, prepend=0)
            columns = [
                pa.array(block.doc_ids[first:last], pa.int64()), pa.array(block.flags[first:last] == 0), pa.array(size), pa.array(sums((held_ > 0)[words].astype(np.int64), own)),
                pa.array([n] * len(own), pa.int64()), pa.array(sums(log_root[words], own)), pa.array(score, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCHEMA.split(", ")])
            first = last

    # The totals are known before the last step's function is shipped.
    asks = [partial(ask, size=j) for j in range(1, order + 1)]
    return exchange(rows, asks, answer, _SCHEMA, lambda df: kept(df, "counts"), block_words, totals)
