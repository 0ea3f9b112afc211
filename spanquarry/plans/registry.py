"""Names, Spark queries and oracle texts, side by side."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from spanquarry.plans.standins import Lake, oracle

_QUERIES: dict[str, Callable[[Lake], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over the stand-in tables, with its oracle where SQL has one."""

    def add(build: Callable[[Lake], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = build
        if sql is not None:
            _ORACLES[name] = oracle(sql)
        return build

    return add


def _load() -> None:
    from spanquarry.plans import (  # noqa: F401
        accounts, agents, datasets, monitoring, reviewing, running, scanning, scoring, streams, traces, wire,
    )


def queries() -> dict[str, Callable]:
    _load()
    return {
        name: (lambda spark, sf_dir, build=build: build(Lake(spark, sf_dir)))
        for name, build in _QUERIES.items()
    }


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
