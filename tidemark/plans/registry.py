"""The registry of queries: each has a name, a Spark plan and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.views import with_views

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLE: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if sql is not None:
            ORACLE[name] = with_views(*views, body=sql)
        return plan

    return register


def ts_text(column: str | Column) -> Column:
    """A timestamp as text with microseconds, the same in every engine and time zone."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def day_text(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")
