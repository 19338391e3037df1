"""Operators over ordered rows and time: as-of and interval joins, gaps, islands, adjacency, range frames.

All are window or equi-join plans. Ties in the order key are broken by the columns given after it;
null times sort first and belong to no interval; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versehall.staging import unused


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def micros(ts: str | Column) -> Column:
    """A timestamp without zone as microseconds, for range frames over time."""
    return F.unix_micros(_c(ts).cast("timestamp"))


def asof_last(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, when: Column, name: str) -> DataFrame:
    """`df` with the last `value` of rows where `when` holds, at or before each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(F.when(when, value), ignorenulls=True).over(w))


def intervals(changes: DataFrame, by: Sequence[str], ts: str, order: Sequence[str], end: Column | None = None) -> DataFrame:
    """Change points as intervals [start, end) up to the next one, the last one up to `end`."""
    w = Window.partitionBy(*by).orderBy(ts, *order)
    following = F.lead(ts).over(w)
    return changes.withColumn("start", F.col(ts)).withColumn("end", following if end is None else F.coalesce(following, end))


def interval_join(points: DataFrame, spans: DataFrame, by: Sequence[str], ts: str, width_micros: int) -> DataFrame:
    """Points to the spans [start, end) of the same keys that hold them.

    Spans are dealt to time buckets of `width_micros`, so the join is an equi-join on keys and
    bucket with a residual test, whatever the number of spans of a key."""
    bucket = lambda c: F.floor(micros(c) / width_micros).cast("long")
    right = spans.where("start < end").withColumn("__b", F.explode(F.sequence(bucket("start"), bucket("end"))))
    right = right.select(*[F.col(k).alias(f"__{k}") for k in by], "__b", *[c for c in spans.columns if c not in by and c != ts])
    on = [F.col(k) == F.col(f"__{k}") for k in by] + [bucket(ts) == F.col("__b")]
    joined = points.join(right, on).where((F.col(ts) >= F.col("start")) & (F.col(ts) < F.col("end")))
    return joined.drop("__b", *[f"__{k}" for k in by])


def gaps(df: DataFrame, by: Sequence[str], seconds: Column, order: Sequence[str], most: float) -> DataFrame:
    """`df` with gap, the seconds since the row before, null where negative or not under `most`."""
    w = Window.partitionBy(*by).orderBy(seconds, *order)
    gap = seconds - F.lag(seconds).over(w)
    return df.withColumn("gap", F.when((gap >= 0) & (gap < most), gap))


def adjacent(df: DataFrame, by: Sequence[str], order: Sequence[str], same: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows whose next row agrees in `same`, with the next row's `keep` as next_*."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in {**dict.fromkeys(keep), **dict.fromkeys(same)}])
    for c in same:
        out = out.where(F.col(c) == F.col(f"next_{c}"))
    return out.drop(*[f"next_{c}" for c in same if c not in keep])


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], key: Column, gap: Column | None = None) -> DataFrame:
    """`df` with island, numbering runs of equal `key` (broken also where `gap` holds)."""
    w = Window.partitionBy(*by).orderBy(*order)
    fresh = ~key.eqNullSafe(F.lag(key).over(w))
    if gap is not None:
        fresh = fresh | F.coalesce(gap, F.lit(False))
    out = df.withColumn("__fresh", F.coalesce(fresh, F.lit(True)).cast("long"))
    return out.withColumn("island", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def breaks(df: DataFrame, by: Sequence[str], order: Sequence[str], paragraph: str, base: Column, least: int = 380) -> DataFrame:
    """`df` with break_ms: the base pause, at least `least` before a new paragraph, 0 at the end."""
    w = Window.partitionBy(*by).orderBy(*order)
    following = F.lead(paragraph).over(w)
    last = F.row_number().over(w) == F.count("*").over(Window.partitionBy(*by))
    out = F.when(last, 0).when(following != F.col(paragraph), F.greatest(base, F.lit(least))).otherwise(base)
    return df.withColumn("break_ms", out.cast("int"))


def range_mean(df: DataFrame, by: Sequence[str], at: Column, span: int, value: Column, weight: Column, name: str) -> DataFrame:
    """Weighted mean over rows of the preceding `span` units of `at`, the row's own included."""
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(-span, 0)
    return df.withColumn(name, F.sum(value * weight).over(w) / F.sum(weight).over(w))


def thin(df: DataFrame, by: Sequence[str], at: Column, order: Sequence[str], band: float) -> DataFrame:
    """Rows kept in order of time, each unless a kept one lies within `band` before it.

    Rows without a time are kept. Each partition is read once in order; all that is held of a unit is
    the time of the row kept last."""
    columns, (first, time) = df.columns, unused(df, "__first", "__time")
    w = Window.partitionBy(*by).orderBy(at, *order)
    rows = df.withColumn(time, at.cast("double")).withColumn(first, F.row_number().over(w) == 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        until = float("-inf")
        for batch in batches:
            keep = []
            for begins, now in zip(batch.column(first).to_pylist(), batch.column(time).to_pylist()):
                if begins:
                    until = float("-inf")
                keep.append(now is None or not now <= until)
                if keep[-1] and now is not None:
                    until = now + band
            yield batch.select(columns).filter(pa.array(keep, pa.bool_()))

    return rows.sortWithinPartitions(*by, at, *order).mapInArrow(run, df.schema)


def block_before(df: DataFrame, by: Sequence[str], order: Sequence[str], anchor: Column, inside: Column, most: int, name: str) -> DataFrame:
    """`df` with `name`, the order key of the anchor row that a row belongs to: rows for which
    `inside` holds that stand without a break right before an anchor, at most `most` of them, and the
    anchor itself. A row is claimed by the nearest anchor behind it."""
    w = Window.partitionBy(*by).orderBy(*order)
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    place = F.row_number().over(w)
    rows = df.withColumn("__place", place).withColumn("__stop", F.when(anchor | ~F.coalesce(inside, F.lit(False)), F.struct(F.col("__place"), anchor.alias("is"), F.struct(*order).alias("key"))))
    nearest = F.first("__stop", ignorenulls=True).over(ahead)
    rows = rows.withColumn("__next", nearest)
    near = F.col("__next.is") & (F.col("__next.__place") - F.col("__place") <= most)
    key = F.when(anchor, F.struct(*order)).when(F.coalesce(inside & near, F.lit(False)), F.col("__next.key"))
    return rows.withColumn(name, key[order[-1]]).drop("__place", "__stop", "__next")


def volume_starts(df: DataFrame, by: Sequence[str], order: Sequence[str], number: Column) -> DataFrame:
    """Rows whose number is above that of every row before; rows without one are passed over."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.where(number.isNotNull()).withColumn("__top", F.max(number).over(w))
    return out.where(F.col("__top").isNull() | (number > F.col("__top"))).drop("__top")


def transitions(df: DataFrame, by: Sequence[str], order: Sequence[str], state: Column, n_states: int) -> DataFrame:
    """(pattern, n, share) of whether a row returns to the state before or the one before that,
    with shares smoothed by one count a pattern."""
    w = Window.partitionBy(*by).orderBy(*order)
    one, two = F.lag(state, 1).over(w), F.lag(state, 2).over(w)
    pattern = F.when(state == one, "same").when(state == two, "back").otherwise("other")
    counts = df.select(pattern.alias("pattern"), two.alias("__two")).where("__two IS NOT NULL").groupBy("pattern").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # at most three rows
    return counts.withColumn("share", F.round((F.col("n") + 1) / (total + n_states), 6))


def throughput(df: DataFrame, ts: Column, now: Column, window_s: int = 1800, least: int = 12, span_s: int = 60) -> DataFrame:
    """Rows a second over the last `window_s` before `now`; null under `least` rows or `span_s`."""
    recent = df.where((ts > now - window_s) & (ts <= now))
    out = recent.agg(F.count("*").alias("n"), (F.first(now) - F.min(ts)).alias("span"))
    return out.select("n", F.when((F.col("n") >= least) & (F.col("span") >= span_s), F.round(F.col("n") / F.col("span"), 6)).alias("rate"))


def recent_rate(df: DataFrame, ts: Column, now: Column, window_s: int = 1800, least: int = 12, span_s: int = 60) -> DataFrame:
    """Rows a second since the first of the last `window_s` (its edge included) before `now`, over
    at least `span_s`; null under `least` rows."""
    out = df.where((ts >= now - window_s) & (ts <= now)).agg(F.count("*").alias("n"), (F.first(now) - F.min(ts)).alias("span"))
    return out.select("n", F.when(F.col("n") >= least, F.round(F.col("n") / F.greatest(F.col("span"), F.lit(span_s)), 6)).alias("rate"))
