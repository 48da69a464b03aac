"""The algebra of collections: addition, scaling, products, zero."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.coll import VALUE, Coll, _add


def _same(a: Coll, b: Coll) -> None:
    if (a.keys, a.values) != (b.keys, b.values):
        raise ValueError(f"fields differ: {a.columns} and {b.columns}")


def add(a: Coll, b: Coll) -> Coll:
    """Merges two maps: values of common keys are added, others stay; a zero that comes out is kept."""
    _same(a, b)
    df = a.df.select(*a.columns).unionByName(b.df.select(*b.columns))
    if not a.values:
        return Coll(df.distinct(), a.keys, unique=True)
    kinds = {f.name: f.dataType for f in df.schema}
    return Coll(df.groupBy(*a.keys).agg(*(_add(v, None, kinds[v]) for v in a.values)), a.keys, a.values, unique=True)


def scale(s: Any, d: Coll) -> Coll:
    """Each value times s (a number, or a Boolean for Boolean values); scaling by 0 keeps the keys."""
    kinds = {f.name: f.dataType for f in d.df.schema}
    by = s if isinstance(s, Column) else F.lit(s)
    times = lambda v: (F.col(v) & by if isinstance(kinds[v], T.BooleanType) else F.col(v) * by).alias(v)
    return Coll(d.df.select(*d.keys, *map(times, d.values)), d.keys, d.values, d.unique)


def tensor(a: Coll, b: Coll) -> Coll:
    """{k1: {k2: v1 * v2}} in long form. All pairs of entries are the result; keys' names must differ."""
    if set(a.columns) & set(b.keys):
        raise ValueError("rename the keys of one side")
    (x,), (y,) = a.values, b.values
    right = b.df.select(*b.keys, F.col(y).alias("_right"))
    df = a.df.crossJoin(right).select(*a.keys, *b.keys, (F.col(x) * F.col("_right")).alias(x))
    return Coll(df, a.keys + b.keys, [x], a.unique and b.unique)


def add_records(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Field by field; both must have the same fields."""
    if a.keys() != b.keys():
        raise ValueError(f"fields differ: {sorted(a.keys() ^ b.keys())}")
    return {k: a[k] + b[k] for k in a}


def scale_record(r: dict[str, Column], s: Any) -> dict[str, Column]:
    return {k: v * s for k, v in r.items()}


def zero(kind: str | T.DataType) -> Any:
    """The neutral element of addition of a type: a Column for scalars, a dictionary of them for records."""
    if isinstance(kind, T.StructType):
        return {f.name: zero(f.dataType) for f in kind}
    kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    if isinstance(kind, T.StructType):
        return zero(kind)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(kind)  # number 0 of their encoding
    if isinstance(kind, T.BinaryType):
        return F.lit("").cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    return F.lit(0).cast(kind)


def empty(spark: SparkSession, schema: str, values: list[str] = []) -> Coll:  # noqa: B006
    """The empty collection of a schema, neutral in add()."""
    return Coll(spark.createDataFrame([], schema), None, values, unique=True)


def to_map(d: Coll, inner: list[str], name: str = "entries") -> DataFrame:
    """Nested maps at an output's edge: a row for each outer key, with a map of the inner ones, which must be few."""
    outer = [k for k in d.keys if k not in inner]
    key = F.col(inner[0]) if len(inner) == 1 else F.struct(*inner)
    value = F.col(d.values[0]) if len(d.values) == 1 else F.struct(*d.values)
    return d.df.groupBy(*outer).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))


def merge_maps(a: Column, b: Column) -> Column:
    """Adds two MapType values by key."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def fold(items: Column, zero_: Column) -> Column:
    """Adds up the items of a vector."""
    return F.aggregate(items, zero_, lambda acc, x: acc + x)


def vector_sum(items: Column, body: Callable[[Column], Any] = lambda x: x, when: Callable[[Column], Column] | None = None, kind: str = "double") -> Column:
    """Adds up body(x) for the items of a vector that fulfil ``when``, as a number of type ``kind``; Booleans by "or"."""
    chosen = F.filter(items, when) if when else items
    if kind == "boolean":
        return F.exists(chosen, body)
    return F.aggregate(chosen, zero(kind), lambda acc, x: (acc + body(x)).cast(kind))


def beside(d: Coll, by: list[str], name: str, total: Column) -> Coll:
    """Each entry with a total over all entries of its part ``by`` of the key, as a further value: one pass, without
    aggregating and joining back."""
    df = d.df.withColumn(name, total.over(Window.partitionBy(*by)))
    return Coll(df, d.keys, [*d.values, name], d.unique)


def lowest(d: Coll, by: list[str], value: str) -> Coll:
    """Least value by key: addition of the (min, +) semiring."""
    return Coll(d.df.groupBy(*by).agg(F.min(value).alias(value)), by, [value], unique=True)


def highest(d: Coll, by: list[str], value: str) -> Coll:
    """Greatest value by key: addition of the (max, +) semiring."""
    return Coll(d.df.groupBy(*by).agg(F.max(value).alias(value)), by, [value], unique=True)


def multiplicities(df: DataFrame) -> Coll:
    """A bag as a map from each row to how often it occurs."""
    return Coll(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(VALUE)), df.columns, [VALUE], unique=True)
