"""Queries with declared inputs, and a session that runs them on named collections."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.text import Record, schema_of
from .coll import Coll


def declared(**inputs: Record) -> Callable:
    """Declares the collections that a query takes, each as names and types of its fields (int, float, bool, str,
    string(n), date).

    Errors show early: at definition a parameter without declaration, a declaration without parameter, or an unknown type; at
    a call an argument that isn't a collection or lacks a field. The query then sees the declared fields
    only, in their declared types.
    """
    schemas = {name: schema_of(record) for name, record in inputs.items()}

    def wrap(f: Callable) -> Callable:
        names = list(inspect.signature(f).parameters)
        if set(names) != set(inputs):
            raise TypeError(f"{f.__name__} takes {names}, but {list(inputs)} are declared")

        @functools.wraps(f)
        def run(*args: Coll, **named: Coll) -> Any:
            given = inspect.signature(f).bind(*args, **named).arguments
            return f(**{name: _checked(name, given[name], schemas[name]) for name in names})

        run.inputs = dict(inputs)
        return run

    return wrap


def _checked(name: str, coll: Any, schema: Any) -> Coll:
    if not isinstance(coll, Coll):
        raise TypeError(f"{name} has to be a collection, not {type(coll).__name__}")
    if missing := [x.name for x in schema if x.name not in coll.columns]:
        raise TypeError(f"{name} lacks {missing}; it has {coll.columns}")
    have = dict(coll.df.dtypes)
    # Dates that are stored as timestamps, and numbers in other widths, come in the declared type.
    cast = [F.col(x.name).cast(x.dataType).alias(x.name) if have[x.name] != x.dataType.simpleString() else F.col(x.name) for x in schema]
    whole = set(coll.keys) <= {x.name for x in schema}
    return Coll(coll.df.select(*cast), [k for k in coll.keys if k in schema.names], [v for v in coll.values if v in schema.names], coll.unique and whole, coll.small, coll.null_keys)


class Session:
    """Named collections and the queries run on them: the result of one is an input of the next."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, Coll] | None = None):
        self.spark, self.tables = spark, dict(tables or {})

    def run(self, query: Callable, name: str | None = None, path: str | None = None, **rename: str) -> Any:
        """Runs a declared query on the session's collections of its parameters' names, or of those that ``rename`` gives.
        name: binds the result, in place of one of that name; path: where it is written first (see Coll.keep)."""
        inputs = {p: rename.get(p, p) for p in query.inputs}
        if missing := [t for t in inputs.values() if t not in self.tables]:
            raise KeyError(f"no collections {missing}; there are {sorted(self.tables)}")
        out = query(**{p: self.tables[t] for p, t in inputs.items()})
        if path is not None:
            out = out.keep(path)
        if name is not None:
            self.tables[name] = out
        return out
