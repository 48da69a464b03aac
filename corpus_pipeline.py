"""From raw documents to packed training sequences: five stages, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfold.llm.common import discard, kept, table, unused
from ringfold.llm.exact_dedup import content_sort
from ringfold.llm.jaccard import jaccard_join
from ringfold.llm.packing import pack
from ringfold.llm.queries import public_tokenizer
from ringfold.llm.secrets import find_secrets, redact
from ringfold.llm.toxicity import drop_toxic


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """docs with a number for each row, and its column's name. They are written, so that every later read has the same numbers."""
    row = unused("row", docs.columns)
    rows = kept(docs.withColumn(row, F.monotonically_increasing_id()), name)
    discard(docs.sparkSession)  # what the stage before has shuffled
    return rows, row


def _one_each(docs: DataFrame, row: str, groups: DataFrame, name: str) -> DataFrame:
    """Of each group of numbered docs the row of the smallest id stays, of equal ids that of the least number, and
    a row without id only if no other has one. groups: row, group; rows not in it stay. The rows that go are
    written first, so that their size decides on the join."""
    members = kept(groups.join(docs.select(F.col(row).alias("row"), "doc_id"), "row"), name + "_groups")
    best = members.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    gone = unused("gone", docs.columns)
    dropped = kept(members.join(best, "row", "left_anti").select(F.col("row").alias(gone)), name)
    return docs.join(dropped, F.col(row) == F.col(gone), "left_anti").drop(row)


# Every stage takes documents with null ids and texts, empty and very long texts, repeated rows, further columns of any
# name, and an empty table; all but the last keep the rows' columns as they are.


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go. Null and empty texts stay; repeated rows are judged alike."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts one stays, that of the smallest id; of equal ids any one, and one without id only if
    no other has one. Null texts equal empty ones."""
    rows, row = _numbered(docs, "exact_rows")
    groups = content_sort(rows.select(F.col(row).alias("row"), "text"), id_col="row", keep="smallest")
    return _one_each(rows, row, groups.where("group_size > 1").select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group")), "copies")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) one row stays, that of the smallest
    id, as in exact_dedup. Texts without words are in no group: all of them stay."""
    rows, row = _numbered(docs, "near_rows")
    groups = jaccard_join(rows.select(F.col(row).alias("row"), "text"), id_col="row")
    return _one_each(rows, row, groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), "near_copies")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to marks of their kind; n_chars, where there is one, follows. All rows stay, and null
    texts stay null."""
    mine = unused("spans", docs.columns)
    plain = docs.withColumnRenamed("secret_spans", mine) if "secret_spans" in docs.columns else docs
    found = find_secrets(plain).withColumn("text", redact(F.col("text"), F.col("secret_spans")))
    if "n_chars" in docs.columns:
        changed = F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", changed)
    return found.select(*(F.col(mine).alias(c) if c == "secret_spans" else F.col(f"`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token windows: a row for each piece, null and empty texts with the end token alone."""
    return pack(docs, public_tokenizer(), added=True)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secret_scans", secret_scans), ("packing", packing)]

#: The models of toxicity, the packing and its token ids aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
