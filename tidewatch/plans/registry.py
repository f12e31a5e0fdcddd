"""Where queries and their SQL twins are registered."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
GROUPS = ("tables", "projections", "lookups", "aggregates", "rankings", "expressions", "sampling", "modelling", "live")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> None:
    for group in GROUPS:
        importlib.import_module(f"{__package__}.{group}")
