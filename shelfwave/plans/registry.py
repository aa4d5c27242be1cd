"""Runnable queries over the sample tables, each with an equivalent SQL text where one exists."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shelfwave.session import ensure_session

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Query
    sql: str | None


_ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` is the text the oracle runs on the same tables."""
    def wrap(fn: Query) -> Query:
        if name in _ENTRIES:
            raise ValueError(f"query {name!r} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ensure_session(spark), sf_dir)

        _ENTRIES[name] = Entry(name, run, sql)
        return fn
    return wrap


def sql_of(name: str) -> str:
    """The SQL of a query registered before: for a report's frame that shows the same content."""
    return _ENTRIES[name].sql


def entries() -> dict[str, Entry]:
    from shelfwave.plans import catalogue
    for module in pkgutil.iter_modules(catalogue.__path__):
        importlib.import_module(f"{catalogue.__name__}.{module.name}")
    return dict(_ENTRIES)
