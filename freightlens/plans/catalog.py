"""Registry of the queries the library answers, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# event operators look at the log as of this moment, record operators as of this day
EVENTS_AS_OF = "2024-01-31 00:00:00"
RECORDS_AS_OF = "2001-08-15"


class Source:
    """Views of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables carry times without a zone

    def __getattr__(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, views: str = "", **ctes: str):
    """Register ``fn(source)`` under a name; ``sql`` may use the listed views and extra named selects."""

    def register(fn: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Source(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = fixtures.with_views(sql, *views.split(), **ctes)
        return fn

    return register
