"""Registered queries: name -> function of (spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from versehall.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its oracle SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def plain(name: str, sql: str) -> None:
    """Register a query that is the same SQL statement in Spark and in the oracle."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    marked = re.sub(rf"\b({'|'.join(used)})\b", r"{\1}", sql)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(marked, **{t: table(spark, sf_dir, t) for t in used})

    run.__name__, run.__doc__ = name, sql
    QUERIES[name], SQL[name] = run, sql
