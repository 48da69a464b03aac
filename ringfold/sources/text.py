"""Delimited text, declared types, and handles around results."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.coll import Coll


@dataclass(frozen=True)
class string:  # noqa: N801  named like the type that it declares
    """Text of at most n characters; readers cut longer values."""

    n: int = 25


class date:  # noqa: N801
    """A day, written yyyy-mm-dd."""


Record = Mapping[str, Any]
_KINDS = {int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), date: T.DateType()}


def spark_type(kind: Any) -> T.DataType:
    return T.StringType() if kind is str or kind is string or isinstance(kind, string) else _KINDS[kind]


def schema_of(record: Record) -> T.StructType:
    return T.StructType([T.StructField(k, spark_type(v)) for k, v in record.items()])


def read_csv(spark: SparkSession, path: str, record: Record, delimiter: str = "|", quote: str = '"', include: Iterable[str] | None = None, distinct: bool = False) -> Coll:
    """Reads text without header into a bag of records, or with ``distinct`` a set.

    record: names and types (int, float, bool, str, string(n), date) of the columns in order; columns beyond
    them, as after a trailing delimiter, are ignored. include: the columns wanted. quote: "" for none.
    """
    df = spark.read.schema(schema_of(record)).csv(path, sep=delimiter, quote=quote, dateFormat="yyyy-MM-dd", enforceSchema=True)
    names = list(record if include is None else include)
    cut = lambda c: F.substring(c, 1, record[c].n).alias(c) if isinstance(record[c], string) else F.col(c)
    df = df.select(*map(cut, names))
    return Coll(df.distinct() if distinct else df, names, unique=distinct)


def read_parquet(spark: SparkSession, path: str, small: bool = False) -> Coll:
    """A bag of records from Parquet; only the columns that queries use are read."""
    return Coll(spark.read.parquet(path), small=small)


def from_rows(spark: SparkSession, rows: Iterable[Mapping[str, Any] | tuple], record: Record, distinct: bool = False) -> Coll:
    """A collection of the caller's rows."""
    names = list(record)
    df = spark.createDataFrame([tuple(r[c] for c in names) if isinstance(r, Mapping) else tuple(r) for r in rows], schema_of(record))
    return Coll(df.distinct() if distinct else df, names, unique=distinct)


class Result:
    """A handle around a collection: size, point lookup, printing, export to dictionaries."""

    def __init__(self, coll: Coll):
        self.coll = coll

    @classmethod
    def from_dict(cls, spark: SparkSession, entries: Mapping[tuple, Any], record: Record, value: Mapping[str, Any] | None = None) -> Result:
        """Of a dictionary from key tuples to True, or to tuples of the fields of ``value``."""
        value = value or {}
        rows = [(*k, *(v if value else ())) for k, v in entries.items()]
        df = spark.createDataFrame(rows, schema_of({**record, **value}))
        return cls(Coll(df, list(record), list(value), unique=True))

    def to_df(self) -> DataFrame:
        return self.coll.result()

    def to_dict(self) -> dict[tuple, Any]:
        """All entries on the client; for results that fit there."""
        n = len(self.coll.keys)
        return {tuple(r)[:n]: tuple(r)[n:] or True for r in self.to_df().collect()}

    def size(self) -> int:
        return self.coll.df.count()

    def get(self, *key: Any) -> Any:
        """The value of a key, or None; nothing is inserted."""
        df = self.to_df()
        for name, k in zip(self.coll.keys, key, strict=True):
            df = df.where(F.col(name).eqNullSafe(F.lit(k)))
        found = df.first()
        return None if found is None else tuple(found)[len(key) :] or True

    def set(self, spark: SparkSession, key: tuple, value: Any = True) -> Result:
        """A result with one entry more, or replaced."""
        kept = self.coll.df
        same = F.lit(True)
        for name, k in zip(self.coll.keys, key, strict=True):
            same = same & F.col(name).eqNullSafe(F.lit(k))
        one = spark.createDataFrame([(*key, *(() if value is True else value))], kept.select(*self.coll.columns).schema)
        return Result(Coll(kept.select(*self.coll.columns).where(~same).union(one), self.coll.keys, self.coll.values, unique=True))

    def scalar(self) -> Any:
        """The number of a one-row result without keys."""
        return self.to_df().first()[0]

    def print(self, most: int = 20) -> None:
        """Up to ``most`` entries, numbers with two decimals."""
        show = lambda x: f"{x:.2f}" if isinstance(x, float) else str(x)
        n = len(self.coll.keys)
        for r in self.to_df().limit(most).collect():
            key, value = ", ".join(map(show, r[:n])), ", ".join(map(show, r[n:])) or "true"
            print(f"{{ <{key}> -> {value} }}")
