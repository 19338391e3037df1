"""Intermediate tables in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A private one stands in for it only in local mode, where driver
    and executors are one machine (tests); a cluster without the setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="versehall-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/versehall/{spark.sparkContext.applicationId}"


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes to be no column of `df`."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear_stages(spark: SparkSession) -> None:
    """Delete this application's intermediate tables and archives, for callers who have written
    their results: results that are not written yet still read them."""
    _delete(spark, _own_dir(spark))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation, and the values of
    non-deterministic or expensive columns are fixed once."""
    spark = df.sparkSession
    path = own_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def forget(*staged: DataFrame) -> None:
    """Delete staged tables that only later stages, written by now, were made from."""
    for df in staged:
        _delete(df.sparkSession, df.stage_path)
