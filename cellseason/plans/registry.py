"""Query registry: a key, a Spark callable over the domain views and, where SQL can say it, an oracle."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import Views, with_views

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        if key in _QUERIES:
            raise ValueError(f"duplicate query {key}")
        _QUERIES[key] = fn
        if sql is not None:
            _ORACLES[key] = sql
        return fn

    return register


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Views(spark, sf_dir))

    return {k: bind(fn) for k, fn in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {k: with_views(s) for k, s in _ORACLES.items()}
