"""Collections and their one bulk operator, summation.

A collection is a finite map from a key (a record) to a value that can be added: a number, a record
of numbers, a Boolean (added by "or"), or in long form a nested map. It is encoded as a DataFrame
with declared key and value columns. ``Coll.sum`` calls its body once, with symbolic rows; the *shape* of
what the body emits chooses the relational operator, and lookups into other collections become joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name of the value column of a map whose value has no field names.
VALUE = "value"
#: Bytes for each task of a dealt probe, by the optimizer's estimate: for some columns of Parquet files 2 to 4 a row, so about a million rows.
TASK_BYTES = 2 << 20


class Cond:
    """A conjunction of Columns and of guards on lookups; guards at its top choose join types.

    Write guards first: ``look.found & (p.x > 1)``.
    """

    def __init__(self, columns: Iterable[Column] = (), guards: Iterable[tuple[Lookup, bool]] = ()):
        self.columns, self.guards = list(columns), list(guards)

    @staticmethod
    def of(x: Any) -> Cond:
        return x if isinstance(x, Cond) else Cond() if x is None or x is True else Cond([x])

    def column(self) -> Column:
        """As a plain Boolean; its guards then need match flags."""
        out = F.lit(True)
        for c in self.columns:
            out = out & c
        for look, wanted in self.guards:
            out = out & (look.flag() if wanted else ~look.flag())
        return out

    def __and__(self, other: Any) -> Cond:
        other = Cond.of(other)
        return Cond(self.columns + other.columns, self.guards + other.guards)

    __rand__ = __and__

    def __or__(self, other: Any) -> Column:
        return self.column() | Cond.of(other).column()

    __ror__ = __or__

    def __invert__(self) -> Cond:
        if not self.columns and len(self.guards) == 1:
            return Cond((), [(self.guards[0][0], not self.guards[0][1])])
        return Cond([~self.column()])


class Fields:
    """Symbolic record: attributes are Columns."""

    def __init__(self, columns: Mapping[str, Column]):
        self._columns = dict(columns)

    def __getattr__(self, name: str) -> Column:
        try:
            return self.__dict__["_columns"][name]
        except KeyError:
            raise AttributeError(f"no field {name!r}; there are {list(self._columns)}") from None

    def concat(self, other: Fields) -> Fields:
        """Fields of both; a name in both is refused."""
        if both := self._columns.keys() & other._columns.keys():
            raise ValueError(f"fields in both records: {sorted(both)}")
        return Fields({**self._columns, **other._columns})

    def dict(self) -> dict[str, Column]:
        return dict(self._columns)


class Lookup:
    """``index[key]`` inside a body. How it is used decides on the join:

    found at the top of the condition -> inner, or left semi if no value is read; missing -> left anti; a flag
    inside a value, or a default -> left outer with a match flag; a value without any guard -> inner, or
    with ``strict`` a left outer join that fails on a missing key.
    """

    def __init__(self, index: Coll, keys: tuple, number: int, strict: bool):
        self._index, self._keys, self._strict = index, keys, strict
        self._prefix = f"_look{number}_"
        self._read: set[str] = set()
        self._flagged = self._optional = self._dealt = False

    @property
    def found(self) -> Cond:
        return Cond((), [(self, True)])

    @property
    def missing(self) -> Cond:
        return Cond((), [(self, False)])

    def flag(self) -> Column:
        self._flagged = self._optional = True
        return F.coalesce(F.col(self._prefix + "found"), F.lit(False))

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.field(name)

    def field(self, name: str) -> Column:
        if name not in self._index.columns:
            raise AttributeError(f"no field {name!r}; there are {self._index.columns}")
        self._read.add(name)
        return F.col(self._prefix + name)

    @property
    def value(self) -> Column:
        """The value of a map that has one value column."""
        (name,) = self._index.values
        return self.field(name)

    def get(self, name: str, default: Any) -> Column:
        """The field, or the default where the key is missing (not where the field is null)."""
        flag, value = self.flag(), self.field(name)
        return F.when(flag, value).otherwise(F.lit(default))

    def _join(self, df: DataFrame, guards: list[bool]) -> DataFrame:
        idx, p = self._index, self._prefix
        names = {k: f"{p}key{i}" for i, k in enumerate(idx.keys)}
        on = [c.eqNullSafe(F.col(n)) if idx.null_keys else c == F.col(n) for c, n in zip(self._keys, names.values(), strict=True)]
        right = idx.df.select(*(F.col(k).alias(n) for k, n in names.items()), *(F.col(c).alias(p + c) for c in sorted(self._read)), *([F.lit(True).alias(p + "found")] if self._optional or (self._strict and not guards) else []))
        # Semi and anti joins don't mind repeated keys; a flag without a value needs each key once.
        if not idx.unique and self._optional and not self._read:
            right = right.dropDuplicates(list(names.values()))
        if self._dealt and not idx.null_keys and (n := _tasks(df.select(*self._keys), right)):
            # Both sides are dealt out alike, so no executor needs a copy of one of them.
            df, right = df.repartition(n, *self._keys), right.repartition(n, *names.values()).hint("merge")
        elif idx.small:
            right = F.broadcast(right)
        if False in guards:
            return df.join(right, on, "left_anti")
        if True in guards and not self._read and not self._optional:
            return df.join(right, on, "left_semi")
        if True in guards:
            return df.join(right, on, "inner")
        if self._optional or self._strict:
            out = df.join(right, on, "left")
            if self._strict and not self._optional:
                out = out.where(F.coalesce(F.col(p + "found"), F.raise_error(F.lit("lookup of a missing key")).cast("boolean")))
            return out
        return df.join(right, on, "inner")


class Pair:
    """Symbolic (key, value) of a collection: p[0], p[1], or their fields directly."""

    def __init__(self, coll: Coll, strict: bool = False):
        self._coll, self._strict, self._lookups = coll, strict, {}
        self._parts = Fields({k: F.col(k) for k in coll.keys}), Fields({v: F.col(v) for v in coll.values})

    def __getitem__(self, i: int) -> Fields:
        return self._parts[i]

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self._parts[name in self._coll.values], name)

    @property
    def count(self) -> Column:
        return F.col(VALUE)

    def concat(self) -> Fields:
        """Key and value fields as one record."""
        return self._parts[0].concat(self._parts[1])

    def look(self, index: Coll, *keys: Column) -> Lookup:
        """index[keys]; keys match the index's key columns by position. One join for equal lookups.

        A value that is read without guard or default has to exist: with ``strict`` in sum() a missing key fails at run
        time, without it the row is left out, as if ``found`` stood in the condition.
        """
        if len(keys) != len(index.keys):
            raise ValueError(f"{len(index.keys)} keys expected: {index.keys}")
        at = (id(index), tuple(map(str, keys)))
        if at not in self._lookups:
            self._lookups[at] = Lookup(index, keys, len(self._lookups), self._strict)
        return self._lookups[at]


@dataclass
class Emit:
    """{key: value} for each row that fulfils the condition."""

    key: dict[str, Column]
    value: dict[str, Any]
    when: Cond
    unique: bool = False


@dataclass
class Total:
    """A number or a record of numbers, without key."""

    value: dict[str, Column]
    when: Cond
    extra: Emit | None = field(default=None)


@dataclass
class Vector:
    """A value that collects its items: distinct ones, or with ``bag`` all of them."""

    item: Column
    bag: bool = False


def _fields(x: Any, name: str) -> dict[str, Any]:
    """Names and values of a record; conditions become plain Booleans here, before joins are chosen."""
    found = x.dict() if isinstance(x, Fields) else dict(x) if isinstance(x, Mapping) else {name: x}
    return {k: v.column() if isinstance(v, Cond) else v for k, v in found.items()}


def emit(key: Any, value: Any = True, when: Any = None, unique: bool = False) -> Emit:
    """Emits a map entry. key: a mapping of names to Columns, or Fields. value: True (a set), a Column or number,
    a mapping (a record), vector(...), or nested(...). unique: keys don't repeat, so nothing is added up."""
    key = _fields(key, "key")
    if isinstance(value, Emit):  # a nested map, in long form
        return Emit({**key, **value.key}, value.value, Cond.of(when) & value.when, unique)
    return Emit(key, {} if value is True else _fields(value, VALUE), Cond.of(when), unique)


def nested(key: Any, value: Any = True) -> Emit:
    """The value of an entry that is itself a map."""
    return emit(key, value)


def vector(item: Column, bag: bool = False) -> Vector:
    return Vector(item, bag)


def scalar(value: Any, when: Any = None) -> Total:
    """Emits a number for each row; without rows the sum is zero."""
    return Total(_fields(value, VALUE), Cond.of(when))


def rec(when: Any = None, **value: Any) -> Total:
    """Emits a record of numbers for each row."""
    return Total(_fields(value, VALUE), Cond.of(when))


def both(total: Any, per: Emit) -> Total:
    """Emits a record of a number and a map entry: a total and sums by key."""
    return Total(_fields(total, VALUE), per.when, per)


def _add(name: str, value: Any, kind: T.DataType | None) -> Column:
    if isinstance(value, Vector):
        return (F.collect_list if value.bag else F.collect_set)(F.col(name)).alias(name)
    return (F.bool_or(name) if isinstance(kind, T.BooleanType) else F.sum(name)).alias(name)


class Coll:
    """A collection: a DataFrame, its key columns and its value columns (none: a set or bag of keys)."""

    def __init__(self, df: DataFrame, keys: Iterable[str] | None = None, values: Iterable[str] = (), unique: bool = False, small: bool = False, null_keys: bool = False):
        self.values = list(values)
        self.keys = [c for c in df.columns if c not in self.values] if keys is None else list(keys)
        #: unique: keys don't repeat. small: may be broadcast whatever its statistics say; only for tables of fixed size.
        self.df, self.unique, self.small, self.null_keys = df, unique, small, null_keys

    @property
    def columns(self) -> list[str]:
        return self.keys + self.values

    def where(self, body: Callable[[Pair], Any] | None) -> Coll:
        if body is None:
            return self
        p = Pair(self)
        df = _lower(self, p, Cond.of(body(p)))
        return Coll(df, self.keys, self.values, self.unique and _once(p), self.small, self.null_keys)

    def sum(self, body: Callable[[Pair], Emit | Total], strict: bool = False) -> Any:
        """Adds up what the body emits for each entry; see emit, scalar, rec and both."""
        p = Pair(self, strict)
        out = body(p)
        return _summed(_lower(self, p, out.when), out, _once(p))

    def nest(self, *inner: str) -> Nested:
        """The same collection seen as a map of maps: the keys ``inner`` and the values are those of the inner maps."""
        return Nested(self, inner)

    def keep(self, path: str) -> Coll:
        """A result as the input of later queries: written as Parquet to a shared path, which must be new, and read from
        there, so that no query that uses it computes it again."""
        self.df.select(*self.columns).write.parquet(path)
        df = self.df.sparkSession.read.schema(self.df.select(*self.columns).schema).parquet(path)
        return Coll(df, self.keys, self.values, self.unique, self.small, self.null_keys)

    def join_build(self, key: str | Iterable[str], where: Callable[[Pair], Any] | None = None, out: Iterable[str] = (), checked: bool = False) -> Coll:
        """An index of rows by key with the columns ``out``; without any it is used for existence only.

        Keys should be unique where values are read: a row that meets a repeated key comes out once for each of
        its values, and what is made of it doesn't count as having unique keys. checked: fail at run time instead.
        """
        keys = [key] if isinstance(key, str) else list(key)
        rows = self.where(where).df
        names = {c: (c if c not in keys else c + "_") for c in out}
        df = rows.select(*keys, *(F.col(c).alias(n) for c, n in names.items()))
        if checked:
            least = [F.min(n).alias(n) for n in names.values()]
            once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"keys {keys} repeat")).cast("boolean")).otherwise(F.lit(True))
            df = df.groupBy(*keys).agg(*least, once.alias("_once")).where("_once").drop("_once")
        return Coll(df, keys, list(names.values()), unique=checked, small=self.small)

    def join_probe(self, index: Coll, key: str | Iterable[str], where: Callable[[Pair], Any] | None, body: Callable[[Lookup, Pair], Any], dealt: bool = False) -> Any:
        """For each row that fulfils ``where`` and whose key is in the index: body(index value, row), added up.

        dealt: large inputs go by key to as many tasks as their size asks for. For keys with few rows each, where most of what
        comes out is distinct, which a task holds at once: by the session's number of tasks each would hold more of a larger input.
        """
        keys = [key] if isinstance(key, str) else list(key)
        p = Pair(self)
        hit = p.look(index, *(F.col(k) for k in keys))
        hit._dealt = dealt
        first = Cond.of(where(p) if where else None) & hit.found
        out = body(hit, p)
        out.when = first & out.when
        return _summed(_lower(self, p, out.when), out, _once(p))

    def scalar(self, name: str = VALUE) -> Column:
        """The value of a one-row collection, as a subquery in another body."""
        return self.df.select(name).scalar()

    def finish(self, body: Callable[[Pair], Mapping[str, Any]]) -> Coll:
        """A projection of each entry to a record: {unique(record): True}."""
        return self.sum(lambda p: emit(body(p), unique=True))

    def result(self) -> DataFrame:
        """Key and value columns as a DataFrame; exact decimals become doubles."""
        kinds = dict(self.df.dtypes)
        return self.df.select(*(F.col(c).cast("double").alias(c) if kinds[c].startswith("decimal") else F.col(c) for c in self.columns))


class Inner:
    """The inner map of an outer entry, inside a body."""

    def __init__(self, pair: NestedPair):
        self._pair, self.totals = pair, {}

    def sum(self, body: Callable[[Pair], Emit | Total]) -> Any:
        """The sum of what the body emits for each inner entry: a map's entries, to emit or to nest in an entry, or for
        scalar() and rec() a number or record of the outer entry, as a Column or Fields."""
        out = body(self._pair)
        if isinstance(out, Emit):
            return out
        if out.extra or out.when.guards:
            raise ValueError("a total of an inner map can't hold lookups in its condition or sums by key")
        at = len(self.totals)
        when = out.when.column()
        made = {k: f"_inner{at}_{k}" for k in out.value}
        for k, v in out.value.items():
            self.totals[made[k]] = F.coalesce(F.sum(F.when(when, _col(v))), F.lit(0)).alias(made[k])
        columns = {k: F.col(c) for k, c in made.items()}
        return columns[VALUE] if list(columns) == [VALUE] else Fields(columns)


class NestedPair(Pair):
    """Symbolic (outer key, inner map): fields of the outer key, and ``inner``."""

    def __init__(self, coll: Coll, strict: bool = False):
        super().__init__(coll, strict)
        self._inner = Inner(self)

    @property
    def inner(self) -> Inner:
        return self._inner


class Nested:
    """A map of maps in long form; see Coll.nest."""

    def __init__(self, coll: Coll, inner: Iterable[str]):
        self.coll, self.inner = coll, list(inner)
        if missing := set(self.inner) - set(coll.keys):
            raise ValueError(f"no keys {sorted(missing)}; there are {coll.keys}")
        self.outer = [k for k in coll.keys if k not in self.inner]

    def sum(self, body: Callable[[NestedPair], Any], strict: bool = False) -> Any:
        """Adds up what the body emits for each outer entry, where it may sum over ``p.inner``. A body that emits the
        inner sum's entries goes through the long form once; one that uses inner totals adds these up by outer key first."""
        p = NestedPair(self.coll, strict)
        out = body(p)
        if not p.inner.totals:
            return _summed(_lower(self.coll, p, out.when), out, _once(p))
        df = self.coll.df.groupBy(*self.outer).agg(*p.inner.totals.values())
        outer = Coll(df, self.outer, list(p.inner.totals), unique=True)
        return _summed(_lower(outer, p, out.when), out, _once(p))


def _lower(coll: Coll, p: Pair, when: Cond) -> DataFrame:
    """The collection's rows joined with what the body has looked up, and filtered."""
    df = coll.df
    rest = list(when.columns)
    for look in p._lookups.values():
        df = look._join(df, [wanted for g, wanted in when.guards if g is look])
    for c in rest:
        df = df.where(c)
    return df


def _bytes(df: DataFrame) -> int:
    """The optimizer's estimate, but no more than its inputs have: that of a join is their product."""
    rows = df._jdf.queryExecution().optimizedPlan()
    inputs = rows.collectLeaves()
    of = lambda x: int(str(x.stats().sizeInBytes()))
    return min(of(rows), sum(of(inputs.apply(i)) for i in range(inputs.size())))


def _tasks(*sides: DataFrame) -> int:
    """One for every TASK_BYTES of all sides; Spark makes it the session's number of shuffle partitions at least. 0 if Spark may
    choose: for little input, or of unknown size, for which plans say the greatest long number."""
    size = sum(map(_bytes, sides))
    return min(-(-size // TASK_BYTES), 1 << 14) if TASK_BYTES <= size < 1 << 60 else 0


class Both(tuple):
    """A record of a total and sums by key, whose fields are collections: ``total`` and ``groups``, or by place."""

    total = property(lambda self: self[0])
    groups = property(lambda self: self[1])


def _once(p: Pair) -> bool:
    """Whether no lookup can have multiplied rows."""
    return all(x._index.unique or not x._read for x in p._lookups.values())


def _summed(df: DataFrame, out: Emit | Total, once: bool = True) -> Any:
    if isinstance(out, Total):
        named = df.select(*(_col(v).alias(k) for k, v in out.value.items()))
        sums = []
        for k, f in zip(out.value, named.schema, strict=True):
            zero = F.lit(False) if isinstance(f.dataType, T.BooleanType) else F.lit(0)
            sums.append(F.coalesce(_add(k, None, f.dataType), zero).alias(k))
        total = Coll(named.agg(*sums), [], list(out.value), unique=True, small=True)
        return Both((total, _summed(df, out.extra, once))) if out.extra else total
    keys, values = list(out.key), list(out.value)
    names = {k: _col(v).alias(k) for k, v in out.key.items()} | {k: _col(v).alias(k) for k, v in out.value.items()}
    if len(names) < len(keys) + len(values):
        raise ValueError(f"names in key and value: {sorted(set(keys) & set(values))}")
    flat = df.select(*names.values())
    if out.unique:
        return Coll(flat, keys, values, unique=once)
    if not values:
        return Coll(flat.distinct(), keys, unique=True)
    kinds = {f.name: f.dataType for f in flat.schema}
    return Coll(flat.groupBy(*keys).agg(*(_add(k, out.value[k], kinds[k]) for k in values)), keys, values, unique=True)


def _col(v: Any) -> Column:
    if isinstance(v, Cond):
        return v.column()
    if isinstance(v, Vector):
        return v.item
    return v if isinstance(v, Column) else F.lit(v).cast("long") if type(v) is int else F.lit(v)
