"""Ranks over a whole table, or within groups of any size, without one task that holds them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versehall.staging import stage, unused


def ranked(df: DataFrame, order: Sequence[Column], name: str, by: Sequence[str] = ()) -> DataFrame:
    """`df` with `name`, the row's place in its group (`by`; none: the whole table) in the given order,
    from 1. Orders are sort columns (`F.desc_nulls_last(...)`) of any type, compared as they are; rows equal in all of
    them stand in any order.

    Rows are dealt out by ranges of (group, order) and staged in order; a row's place is its place
    among its group's rows of its range, behind those of the ranges before. Only a group that began in
    an earlier range has rows before, so the broadcast table of offsets has at most a row a range."""
    at, part, own, before, n = unused(df, "at", "part", "own", "before", "n")
    keys = [F.col(b).asc() for b in by] + list(order)
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    rows = stage(rows.withColumn(part, F.shiftright(at, 33)), "ranges")
    sizes = rows.groupBy(*by, part).agg(F.count("*").alias(n))
    upto = F.sum(n).over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*[F.col(b).alias(f"__by_{b}") for b in by], F.col(part).alias("__part"), upto.alias(before)).where(F.col(before) > 0)
    on = [F.col(part) == F.col("__part"), *[F.col(b).eqNullSafe(F.col(f"__by_{b}")) for b in by]]
    placed = rows.withColumn(own, F.row_number().over(Window.partitionBy(*by, part).orderBy(at))).join(F.broadcast(offsets), on, "left")
    return placed.select(*df.columns, (F.col(own) + F.coalesce(F.col(before), F.lit(0))).cast("long").alias(name))


def global_rank(df: DataFrame, value: str, tie: str, name: str, descending: bool = False, cuts: int | None = None) -> DataFrame:
    """`df` with `name`, the row's place by `value` and then `tie` (nulls last), from 1. `cuts` is of no
    use any more: ranges are as many as the session's shuffle partitions."""
    first = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
    return ranked(df, [first, F.asc_nulls_last(tie)], name)
