"""Registered queries: a Spark plan, the SQL that must agree with it, what it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    sql: str | None
    covers: str


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its function name."""

    def register(plan: Plan) -> Plan:
        name = plan.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, plan, sql, covers)
        return plan

    return register


def load() -> dict[str, Query]:
    from . import cleaning, experiments, features, measures, modelling, files, splits, texts  # noqa: F401

    return QUERIES
