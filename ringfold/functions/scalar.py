"""Scalar functions of the query language, as Column expressions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract_year(d: Column) -> Column:
    return F.year(d).cast("long")


def starts_with(s: Column, k: Any) -> Column:
    return s.startswith(k)


def ends_with(s: Column, k: Any) -> Column:
    """True if s ends with k, wherever else k may occur in it."""
    return s.endswith(k)


def contains(s: Column, k: Any) -> Column:
    return s.contains(k)


def first_index(s: Column, k: Any) -> Column:
    """Place of the first occurrence, from 0; -1 if there is none."""
    return (F.instr(s, k) - 1).cast("long")


def substr(s: Column, first: int, last: int) -> Column:
    """Characters first to last, from 0, the last included."""
    return F.substring(s, first + 1, last - first + 1)


def dict_size(x: Column) -> Column:
    """Number of keys of a map, or of items of a vector."""
    return F.size(x).cast("long")


def to_string(x: Column) -> Column:
    return x.cast("string")


def divide(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def int_divide(a: Column, b: Column) -> Column:
    """Integer division, towards zero; null where b is zero."""
    return F.when(b != 0, F.call_function("div", a, b))


def promote(x: Column, kind: str = "double") -> Column:
    """A number or Boolean in a wider type."""
    return x.cast(kind)


def yyyymmdd(n: int) -> Column:
    """The timestamp literal of a date written as an integer."""
    return F.lit(f"{n // 10000:04d}-{n // 100 % 100:02d}-{n % 100:02d}").cast("timestamp_ntz")


def money(x: Column) -> Column:
    """An amount with cents, exactly."""
    return x.cast("decimal(12,2)")


def share(x: Column) -> Column:
    """A fraction with hundredths, exactly."""
    return x.cast("decimal(4,2)")


def unique(key: Any) -> Any:
    """Marks a key as unique; the mark itself is the ``unique`` argument of emit."""
    return key


def dense(size: int, key: Any) -> Any:
    """Accepted for its meaning to readers; physical layout is Spark's."""
    return key
