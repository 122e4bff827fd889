"""Registered queries and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_queries.sqltext import AS_OF
from catalog_queries.views import Inputs, for_duckdb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    """Register ``build(inputs) -> DataFrame`` under ``name`` with its SQL."""

    def register(build: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(Inputs(spark, sf_dir))

        QUERIES[name] = run
        ORACLES[name] = for_duckdb(sql)
        return build

    return register


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def text_time(column: str) -> Column:
    """Times are compared as text, so that no client converts their zone."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column.rsplit(".", 1)[-1])


def bits(*names: str) -> list[Column]:
    return [F.col(n).cast("int").alias(n) for n in names]
