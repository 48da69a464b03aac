"""Toxicity by class-conditional Kneser-Ney models of words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import mix
from .common import lowered, remainder, text_of

#: Labelled documents of each class that are learnt from at most.
PER_CLASS = 4_000
#: The absolute discount of an n-gram's documents, as a share of its class's documents, 0.75 at least (ordinary, toxic:
#: what few toxic documents have proves nothing), and the weight of the shorter history, as a multiple of the class's documents.
DISCOUNT, PRIOR = (0.005, 0.05), 16.0
#: Words of a passage.
PASSAGE = 4
#: The score from which a document counts as toxic, the curve's steepness, and the ratio at which it
#: reaches REJECT where labels can't tell.
REJECT, STEEPNESS, FALLBACK = 0.7, 10.0, 1.0
#: Bytes of the beginnings under which rare words are counted together, least and most, and how many times as large a beginning's
#: share of one class's documents has to be as its share of the other's.
BEGINNING, TELLING = (4, 12), 4
#: Entries that a task counts before it hands them on.
ENTRIES = 200_000
#: Tokens whose ratios are worked out at once.
TOKENS = 1 << 18
#: Marks of a labelled document, each of as many least hashes of its three-word sequences; of documents that share one, one is learnt from.
MARKS, HASHES = 4, 4

_WORD = re.compile(rb"[0-9a-z'\x80-\xff]+")
#: The history of a text's first word; no token is empty.
START = b""


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and apostrophes."""
    return _WORD.findall(lowered(text))


class Families:
    """Rare words that begin alike are read as one: a word that few documents have in just this form, but many of one
    class and few of the other in forms with the same beginning, proves as much as one word that they all have. What has
    no such beginning stays itself, and so do all words that are known themselves."""

    def __init__(self, known: Iterable[bytes] = (), telling: dict[bytes, float] | None = None):
        """known: words beyond the discount; telling: how strongly a beginning parts the classes."""
        self.telling = telling or {}
        self.heads = {b[: BEGINNING[0]] for b in self.telling}
        self.known = {w for w in known if w[: BEGINNING[0]] in self.heads}

    def one(self, word: bytes) -> bytes:
        found = [(self.telling[word[:k]], k) for k in range(BEGINNING[0], min(len(word), BEGINNING[1]) + 1) if word[:k] in self.telling]
        # No token has a hyphen.
        return word[: max(found)[1]] + b"-" if found and word not in self.known else word

    def read(self, words: list[bytes]) -> list[bytes]:
        heads, n = self.heads, BEGINNING[0]
        return [self.one(w) if w[:n] in heads else w for w in words] if heads else words


def beginnings(word: bytes) -> list[bytes]:
    return [word[:k] for k in range(BEGINNING[0], min(len(word), BEGINNING[1]) + 1)]


class Model:
    """The log-ratio of two Kneser-Ney bigram models, toxic (1) and ordinary (0).

    With documents in place of occurrences, each class discounts its own counts and gives what that frees to
    the shorter history, and at last to one shared distribution, that of Kneser-Ney continuation counts
    (the distinct words that a word follows, in either class):

    P(w)   = (max(n(w) - D, 0) + sum(min(n, D)) * shared(w)) / sum(n)
    P(w|h) = (max(n(hw) - D, 0) + (sum over h of min(n, D) + prior) * P(w)) / (n(h) + prior)

    An expression rare in both gets the same probability from both but for the freed mass, which ``rare`` has.
    So only words, histories and pairs beyond the discount are kept: as many as a few documents' words.
    """

    def __init__(self, docs: tuple[int, int], words: Iterable[tuple[bytes, int, int, int]], mass: tuple[tuple[int, int], tuple[float, float]], kinds: int, pairs: Iterable[tuple[bytes, bytes, int, int]], histories: Iterable[tuple[bytes, int, int, float, float]], discount: tuple[float, float] = DISCOUNT, prior: float = PRIOR, families: Families | None = None):
        """docs: documents by class; words: (word, n0, n1, continuations) beyond the discount in a class; mass: sums of
        n and of min(n, D) over all words, by class; kinds: distinct pairs; pairs: (h, w, n0, n1) beyond the
        discount; histories: (h, n0, n1, sums of min(n, D)) of these; families: as what rare words are read."""
        self.families = families or Families()
        self.discounts = discounts(docs, discount)
        total, freed = mass
        back = [freed[c] / total[c] if total[c] else 1.0 for c in (0, 1)]
        self.rare = math.log(back[1]) - math.log(back[0]) if min(back) > 0 else 0.0
        self.number: dict[bytes, int] = {}
        p: dict[bytes, list[float]] = {}
        for w, *n, shared in words:
            p[w] = [(max(n[c] - self.discounts[c], 0.0) / total[c] if total[c] else 0.0) + back[c] * shared / kinds for c in (0, 1)]
            self.number[w] = len(self.number) + 1  # 0: any other word
        prior_ = [max(prior * d, 1.0) for d in docs]
        weight: dict[bytes, list[float]] = {}
        n_h: dict[bytes, list[float]] = {}
        for h, n0, n1, f0, f1 in histories:
            n_h[h] = [n0 + prior_[0], n1 + prior_[1]]
            weight[h] = [(f + x) / m for f, x, m in zip((f0, f1), prior_, n_h[h], strict=True)]
            self.number.setdefault(h, len(self.number) + 1)
        size = len(self.number) + 1
        self.word, self.history = np.full(size, self.rare), np.zeros(size)
        for w, (p0, p1) in p.items():
            self.word[self.number[w]] = math.log(p1) - math.log(p0)
        for h, (w0, w1) in weight.items():
            self.history[self.number[h]] = math.log(w1) - math.log(w0)
        found = {}
        for h, w, *n in pairs:
            if h in weight and w in p:
                both = [max(n[c] - self.discounts[c], 0.0) / n_h[h][c] + weight[h][c] * p[w][c] for c in (0, 1)]
                found[self.number[h] * size + self.number[w]] = math.log(both[1]) - math.log(both[0])
        self.keys = np.array(sorted(found), np.int64)
        self.pair = np.array([found[k] for k in self.keys.tolist()])

    def ratios(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """log P(toxic) - log P(ordinary) of each token of each text, given the token before it."""
        texts = list(map(self.families.read, texts))
        lens = np.array([len(t) for t in texts], np.int64)
        at = np.fromiter((self.number.get(w, 0) for t in texts for w in t), np.int64, int(lens.sum()))
        ends = np.cumsum(lens)
        before = np.empty_like(at)
        before[1:] = at[:-1]
        before[(ends - lens)[lens > 0]] = self.number.get(START, 0)
        out = self.history[before] + self.word[at]
        if len(self.keys):
            key = before * (len(self.number) + 1) + at
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out = np.where((self.keys[k] == key) & (before > 0) & (at > 0), self.pair[k], out)
        return np.split(out, ends[:-1]) if len(ends) else []


def discounts(docs: tuple[int, int], share: tuple[float, float] = DISCOUNT) -> list[float]:
    return [max(0.75, x * n) for x, n in zip(share, docs, strict=True)]


def normalised(ratios: np.ndarray) -> tuple[float, float]:
    """The difference of a text's two log-likelihoods by its length: of the whole text, and of the passage of
    PASSAGE words for which it is greatest (a shorter text is one, as if filled up with words without evidence)."""
    n = len(ratios)
    if n <= PASSAGE:
        return float(ratios.sum()) / max(n, 1), float(ratios.sum()) / PASSAGE
    upto = np.concatenate(([0.0], np.cumsum(ratios)))
    return float(upto[-1]) / n, float((upto[PASSAGE:] - upto[:-PASSAGE]).max()) / PASSAGE


def calibrate(values: list[tuple[float, int]]) -> float:
    """The ratio that best parts the classes. A cut's worth is the share of toxic rows above it less
    ten times the share of ordinary ones; the middle of all cuts worth nearly as much as the best is
    taken, so that mislabelled rows move it little. Never 0 or less."""
    ones = sum(y for _, y in values)
    zeros = len(values) - ones
    if not ones or not zeros:
        return FALLBACK
    values = sorted(values)
    worth, cuts = -9.0, []
    for (x, y), (after, _) in zip(values, values[1:], strict=False):
        worth += -1 / ones if y else 10 / zeros
        if after > x:
            cuts.append((worth, x, after))
    best = max((c[0] for c in cuts), default=0.0)
    near = [c for c in cuts if c[0] >= best - 0.02]
    cut = (near[0][1] + near[-1][2]) / 2 if near else FALLBACK
    return cut if cut > 0 else FALLBACK


def marks(text: str | None) -> list[int]:
    """MARKS numbers that texts are the likelier to share the more three-word sequences they do: each mixes
    the least hashes of the sequences in HASHES orders."""
    own = tokens(text)
    grams = {b" ".join(own[k : k + 3]) for k in range(max(len(own) - 2, 1))}
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64, len(grams))
    least = [int(mix(hashes, np.full_like(hashes, k)).min()) for k in range(MARKS * HASHES)]
    return [hash(tuple(least[k * HASHES : (k + 1) * HASHES])) for k in range(MARKS)]


def _one_of_copies(rows: DataFrame) -> DataFrame:
    """Of labelled documents of one class that share a mark, as near copies do, only the one of least hash, with
    all its columns: a label of a text that was copied a thousand times is one label."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([marks(t.as_py()) for t in b.column(2)], pa.list_(pa.int64()))], names=["doc_id", "toxic", "marks"])

    at = rows.select("doc_id", "toxic", "text").mapInArrow(mark, "doc_id long, toxic int, marks array<long>").select("doc_id", "toxic", F.struct(F.xxhash64("doc_id"), "doc_id").alias("order"), F.posexplode("marks").alias("k", "mark"))
    first = at.groupBy("toxic", "k", "mark").agg(F.min("order").alias("first"))
    beaten = at.join(first, ["toxic", "k", "mark"]).where("order <> first").select("doc_id").distinct()
    # As many rows at most as documents are learnt from.
    return rows.join(F.broadcast(beaten), "doc_id", "left_anti")


def _families(parts: DataFrame, sizes: tuple[int, int]) -> Families:
    """parts: documents (n0, n1) of beginnings (h) and of words (w). A beginning tells if its shares of the two classes'
    documents differ by more than both discounts, and TELLING times; that many have as many at most as documents have words, over the discount's share."""
    if not min(sizes):
        return Families()
    d = discounts(sizes)
    low, high, share = ([(F.col(f"n{c}") + x * d[c]) / F.lit(float(sizes[c])) for c in (0, 1)] for x in (-1, 1, 0))
    more = [F.when(share[c] >= TELLING * share[1 - c], low[c] / high[1 - c]).otherwise(F.lit(0.0)) for c in (0, 1)]
    found = parts.where("h is not null").select("h", F.greatest(*more).alias("tells")).where("tells > 1").collect()
    known = parts.where("w is not null").where((F.col("n0") > d[0]) | (F.col("n1") > d[1])).select("w").collect()
    return Families((bytes(r["w"]) for r in known), {bytes(r["h"]): r["tells"] for r in found})


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[Model, float]:
    """Fits models and the cut on labelled documents: of each class the ``per_class`` ids of least hash, a bound on
    what is broadcast and gathered; of near copies among them one. The models learn from two thirds of them,
    the cut from the rest. A word, beginning or pair counts once a document. Rare words are read by
    their beginnings (see Families), which are learnt from the models' documents too.

    docs: doc_id, text; labels: doc_id, toxic, already without held-out rows.
    """
    ranked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [ranked.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]).select("doc_id", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(3)) == 0).alias("curve")))
    labelled = docs.join(chosen, "doc_id").persist()
    rows = _one_of_copies(labelled)

    fitted = rows.where("not curve").select("toxic", "text")

    def counted(own: Callable[[list[bytes]], set[tuple]]) -> DataFrame:
        """Documents by the two parts of what own(tokens) has, by class."""

        def part(found: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
            for c in (0, 1):
                items = list(found[c].items())
                for k in range(0, len(items), 50_000):
                    some = items[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([g[j] for g, _ in some], pa.binary()) for j in (0, 1)] + [pa.array([n if c == d else 0 for _, n in some], pa.int64()) for d in (0, 1)], names=["h", "w", "n0", "n1"])
                found[c].clear()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for b in batches:
                for toxic, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    found[toxic].update(own(tokens(text.as_py())))
                    if len(found[0]) + len(found[1]) >= ENTRIES:
                        yield from part(found)
            yield from part(found)

        return fitted.mapInArrow(count, "h binary, w binary, n0 long, n1 long").groupBy("h", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).persist()

    # Beginnings (as h), words, and documents in all (neither).
    parts_ = counted(lambda own: {(None, None), *((None, w) for w in own), *((x, None) for w in set(own) for x in beginnings(w))})
    all_ = parts_.where("h is null and w is null").select("n0", "n1").first()
    sizes = (all_["n0"], all_["n1"]) if all_ else (0, 0)
    families = _families(parts_, sizes)
    parts_.unpersist()
    # Pairs, words (no history: null).
    grams = lambda own: {*((None, w) for w in own), *zip([START, *own], own, strict=False)}
    counts = counted(lambda own: grams(families.read(own)))
    d = discounts(sizes)
    # Counts beyond a discount are so many at most as documents have distinct words, over the discount's share.
    beyond = (F.col("n0") > d[0]) | (F.col("n1") > d[1])
    freed = [F.sum(F.least(F.col(f"n{c}").cast("double"), F.lit(d[c]))).alias(f"f{c}") for c in (0, 1)]
    words, pairs = counts.where("h is null"), counts.where("h is not null")
    mass = words.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), *freed).first()
    kept_words = words.where(beyond)
    follows = pairs.join(F.broadcast(kept_words.select("w")), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("before"))
    known = kept_words.join(follows, "w").select("w", "n0", "n1", "before").collect()
    kept_pairs = pairs.where(beyond).collect()
    histories = pairs.groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), *freed).where("f0 < n0 or f1 < n1").collect()
    kinds = max(pairs.count(), 1)
    counts.unpersist()
    text = lambda x: bytes(x)
    model = Model(
        sizes, sorted((text(r["w"]), r["n0"], r["n1"], r["before"]) for r in known), ((mass["n0"] or 0, mass["n1"] or 0), (mass["f0"] or 0.0, mass["f1"] or 0.0)), kinds,
        [(text(r["h"]), text(r["w"]), r["n0"], r["n1"]) for r in kept_pairs], sorted((text(r["h"]), r["n0"], r["n1"], r["f0"], r["f1"]) for r in histories), families=families,
    )
    values = _ratios(rows.where("curve").select("toxic", "text"), model).select("_passage", "toxic").collect()
    labelled.unpersist()
    return model, calibrate([(r["_passage"], r["toxic"]) for r in values])


def _ratios(rows: DataFrame, model: Model, carry: bool = False) -> DataFrame:
    """Adds ``_whole`` and ``_passage`` to rows, and leaves out the text unless it is to be carried along."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if carry or c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            at = b.schema.get_field_index
            found: list[tuple[float, float]] = []
            part, size = [], 0
            for t in b.column(at("text")):
                part.append(tokens(t.as_py()))
                size += len(part[-1])
                if size >= TOKENS:
                    found += map(normalised, own.ratios(part))
                    part, size = [], 0
            found += map(normalised, own.ratios(part))
            columns = [*(b.column(at(c)) for c in names), pa.array([x for x, _ in found], pa.float64()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "_whole", "_passage"])

    added = [T.StructField(c, T.DoubleType()) for c in ("_whole", "_passage")]
    return rows.mapInArrow(score, T.StructType([*(rows.schema[c] for c in names), *added]))


def _score(cut: float, reject: float) -> Column:
    """A logistic curve that passes ``reject`` at the cut."""
    return 1 / (1 + F.exp(F.lit(-STEEPNESS) * (F.col("_passage") / F.lit(cut) - 1) - F.lit(math.log(reject / (1 - reject)))))


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, reject: float = REJECT) -> DataFrame:
    """The documents (doc_id, text and any other columns) whose score is below ``reject``; see score_toxicity.
    No shuffle: texts stay where they are read. All columns come back as they were, whatever their names."""
    model, cut = learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")), trained(labels), per_class)
    # Under names of their own, columns can't clash with the ratios.
    own = docs.select(*(F.col(f"`{c}`").alias("text" if c == "text" else f"c{i}") for i, c in enumerate(docs.columns)))
    out = _ratios(own, model, carry=True).where(_score(cut, reject) < reject)
    return out.select(*(F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def trained(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(remainder("doc_id", 3) != 1)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, reject: float = REJECT) -> DataFrame:
    """Scores every document; doc_id, held_out, score (0 to 1), predicted (1 if score >= reject), and the
    log-likelihood ratios by length of the whole text and of its likeliest passage, whole and passage.

    Words of many endings, each of them rare, are read by their beginnings (see Families).
    Two Kneser-Ney models, of toxic and of ordinary texts, give each word, after the word before it, a
    difference of log-likelihoods (see Model); all words of the whole text count. The sum over a passage of PASSAGE words,
    by its length, says how much likelier it is as a toxic one, and a text counts by its likeliest passage. (By
    the whole text's length, which column whole has, a few toxic words of a long text are lost: the README has
    figures.) Every passage is judged alike, so a long text is hardly likelier to be rejected than a short
    one. Labels are learnt from rows whose crc32(id) modulo 3 isn't 1; the others are held out.

    Null or empty texts, and those without letters, get the score of ratio 0; texts of any length are read in full;
    null ids are never learnt from but scored; rows that repeat a label count once (toxic wins a tie); repeated
    documents are scored each; without labels of both classes the cut is a fixed value; extra columns are ignored;
    an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    model, cut = learn(rows, trained(labels), per_class)
    out = _ratios(rows, model).withColumn("score", _score(cut, reject))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= reject).cast("int").alias("predicted"), F.col("_whole").alias("whole"), F.col("_passage").alias("passage"))
