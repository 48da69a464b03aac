"""Quality rules: surface counts, and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of, words_of

#: Buckets of the two multinomials, trusted documents that are learnt from at most, and what is added to each bucket.
BUCKETS, TRUSTED, ADDED = 10_000, 20_000, 1.0
#: Least mean log-ratio of a document that stays.
LEAST_RATIO = -0.08
#: Rules on the surface (fixed values): fewest words, and the greatest share of words in repeated windows in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50


def features(words: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all words and of all pairs of neighbouring words."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.pmod(F.xxhash64(F.get(words, i), w), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of three words that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        def twice(ordered: Column) -> Column:
            beside = lambda x, k: F.get(ordered, k)["h"].eqNullSafe(x["h"])
            hit = F.filter(ordered, lambda x, k: beside(x, k - 1) | beside(x, k + 1))
            return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(F.array_sort(pairs), twice))

    windows = F.transform(F.slice(words, 3, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(F.get(words, i), F.get(words, i + 1), w))
    return let(windows, covered)


def surface(text: Column, words: Column) -> dict[str, Column]:
    """The base counts of a text."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words).cast("long"),
    }


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, sample: int = TRUSTED, added: float = ADDED) -> list[float]:
    """log P(bucket | trusted) - log P(bucket | all documents) of every bucket.

    docs: doc_id, text. trusted: doc_id, of which the ``sample`` rows of least hash are learnt from, a bound
    on what is broadcast; the raw corpus is all of docs. Without any trusted text all ratios are 0.
    """
    chosen = trusted.select(F.col("doc_id").alias("_trusted")).where("_trusted is not null").distinct().orderBy(F.xxhash64("_trusted"), "_trusted").limit(sample)
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["_trusted"], "left")
    each = rows.select(F.col("_trusted").isNotNull().cast("int").alias("good"), F.explode(let(words_of(F.col("text")), lambda w: features(w, buckets))).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good")).collect()  # as many rows as buckets
    raw, good = [0] * buckets, [0] * buckets
    for r in counts:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    if not sum(good):
        return [0.0] * buckets
    n, m = sum(raw) + added * buckets, sum(good) + added * buckets
    return [math.log((g + added) / m) - math.log((r + added) / n) for r, g in zip(raw, good, strict=True)]


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """Judges every document; doc_id, the surface counts, base_failed, ratio and kept.

    ratio is the mean, over all words and word pairs of the text, of the log-ratio of their hash bucket
    between a multinomial of trusted documents and one of the whole corpus; a document is kept if it
    doesn't fail the base rules and its ratio is ``least_ratio`` or more. DataFrame functions only; the model
    is ``buckets`` numbers.

    Null or empty text: no words, ratio 0, base_failed. Null ids are never trusted but judged; repeated rows
    get a verdict each; extra columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    ratios = log_ratios(rows, trusted, buckets)
    weight = F.expr("cast(split('" + ",".join(map(repr, ratios)) + "', ',') as array<double>)")
    words = words_of(F.col("text"))

    def judged(w: Column) -> Column:
        total = lambda f: F.aggregate(f, F.lit(0.0), lambda a, b: a + F.get(weight, b)) / F.greatest(F.size(f), F.lit(1))
        return F.struct(*(c.alias(k) for k, c in surface(F.col("text"), w).items()), let(features(w, buckets), total).alias("ratio"))

    out = rows.select("doc_id", let(words, judged).alias("q")).select("doc_id", "q.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= least_ratio))
