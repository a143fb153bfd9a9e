"""Registry of the checks over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.plans.driver_views import DriverViews, with_views
from newsloom.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, views: str = "", sql: str | None = None):
    """Register a query over ``DriverViews`` and, where SQL can state it, its oracle."""

    def register(build: Callable[[DriverViews], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(DriverViews(tune(spark), sf_dir))

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return build

    return register


def as_text(ts: str | Column) -> Column:
    """Timestamps leave a check as text, so the two engines cannot differ in zone handling."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def text_sql(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"
