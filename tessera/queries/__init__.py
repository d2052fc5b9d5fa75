"""Queries over the test tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import Context, Stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Streams of a folder's tables by attribute, and the context that read them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.ctx, self.sf_dir, self.spark = Context(spark), sf_dir, spark

    def __getattr__(self, name: str) -> Stream:
        return self.ctx.read_parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register f(tables) -> Stream under its name, with its SQL."""

    def add(f: Callable[[Tables], Stream]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir)).df
        if sql:
            SQL[key] = sql
        return f

    return add


def load() -> None:
    from tessera.queries import functions, ordered, relational, tpch, udfs  # noqa: F401
