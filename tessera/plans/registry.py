"""The named queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.fixtures import Fixtures, with_views
from tessera.session import ship_package

_QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
_FAMILIES = (
    "placement",
    "joins",
    "attributes",
    "scoring",
    "losses",
    "morphology",
    "rasters",
    "catalogue",
    "exports",
    "sampling",
    "increments",
)


def query(name: str, oracle: str | None = None):
    """Register a query; the function takes the fixtures of one data folder."""

    def add(fn: Callable[[Fixtures], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if oracle:
            _ORACLES[name] = oracle
        return fn

    return add


def load() -> None:
    for family in _FAMILIES:
        importlib.import_module(f"tessera.plans.{family}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()

    def bind(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(Fixtures(spark, sf_dir))

        return run

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return {name: with_views(sql) for name, sql in _ORACLES.items()}
