"""Relational algebra on sets of records."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.coll import Coll, Fields


def _set(df: DataFrame) -> Coll:
    return Coll(df.distinct(), df.columns, unique=True)


def selection(where: Callable[[Fields], Column], r: Coll) -> Coll:
    """The records that fulfil a condition, as a set."""
    return _set(r.df.select(*r.keys).where(where(Fields({k: F.col(k) for k in r.keys}))))


def projection(to: Callable[[Fields], Mapping[str, Any]], r: Coll) -> Coll:
    """Each record's image, without duplicates."""
    return _set(r.df.select(*(v.alias(k) for k, v in to(Fields({k: F.col(k) for k in r.keys})).items())))


def union(a: Coll, b: Coll) -> Coll:
    return _set(a.df.select(*a.keys).unionByName(b.df.select(*b.keys)))


def bag_union(a: Coll, b: Coll) -> Coll:
    """Multiplicities (or any other values) of common keys add up."""
    from .semiring import add

    return add(a, b)


def intersection(a: Coll, b: Coll) -> Coll:
    return Coll(a.df.select(*a.keys).intersect(b.df.select(*a.keys)), a.keys, unique=True)


def difference(a: Coll, b: Coll) -> Coll:
    return Coll(a.df.select(*a.keys).subtract(b.df.select(*a.keys)), a.keys, unique=True)


def dom(d: Coll) -> Coll:
    """The keys of a map, as a set."""
    df = d.df.select(*d.keys)
    return Coll(df, d.keys, unique=True) if d.unique else _set(df)


def _prefixed(r: Coll, name: str) -> DataFrame:
    return r.df.select(*(F.col(c).alias(f"{name}_{c}") for c in r.keys))


def product(a: Coll, b: Coll, name1: str, name2: str) -> Coll:
    """All pairs of records, fields prefixed by the relations' names. Its size is the product of both: for small inputs."""
    return Coll(_prefixed(a, name1).crossJoin(_prefixed(b, name2)), unique=a.unique and b.unique)


def theta_join(on: Callable[[Fields], Column], a: Coll, b: Coll, name1: str, name2: str) -> Coll:
    """Pairs that fulfil a condition. Equalities in it are joined by hashing or sorting; only without any are all pairs tried."""
    left, right = _prefixed(a, name1), _prefixed(b, name2)
    fields = Fields({c: F.col(c) for c in left.columns + right.columns})
    return Coll(left.join(right, on(fields)), unique=a.unique and b.unique)


def hash_equal_join(a: Coll, b: Coll, name1: str, name2: str, col1: str, col2: str) -> Coll:
    """Pairs with equal columns: all matches, as a set of records with prefixed fields."""
    left, right = _prefixed(a, name1), _prefixed(b, name2)
    return _set(left.join(right, F.col(f"{name1}_{col1}") == F.col(f"{name2}_{col2}")))


def concat(r1: Mapping[str, Column], r2: Mapping[str, Column], name1: str, name2: str) -> dict[str, Column]:
    """One record of both, fields prefixed."""
    return {f"{name1}_{k}": v for k, v in r1.items()} | {f"{name2}_{k}": v for k, v in r2.items()}
