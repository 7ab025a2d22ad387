"""The query registry: name -> (Spark plan, optional SQL oracle)."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .views import with_views

Plan = Callable[[SparkSession, str], DataFrame]


class Query(NamedTuple):
    plan: Plan
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, views: str = "", sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(plan, with_views(views, sql) if sql else None)
        return plan

    return register
