"""Runs of one person and chains of labels: what a row means depends on the rows before it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versehall.operators.sequential import grouped

PATTERNS = ("same", "back", "other")


def trait_islands(df: DataFrame, by: Sequence[str], first: str, last: str, ident: str, traits: Sequence[str], most_gap: float) -> DataFrame:
    """W9 with traits: (by, ident, canonical), the ident of the first row of each row's island.

    Rows are appearances from `first` to `last`; `traits` are arrays of known values (null and empty:
    nothing known). In order of `first`, a row joins the island before it if it begins behind the island's end,
    at most `most_gap` later, and no trait contradicts: of each trait one side knows nothing or both
    share a value. The island then knows what the row knows. So whether two rows join depends on all
    that the island has gathered.

    Where a row begins more than `most_gap` behind everything before it an island must begin, whatever
    is known; such stretches are independent, are dealt out apart and folded as streams that hold one
    island's knowledge."""
    w = Window.partitionBy(*by).orderBy(first, ident)
    end = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col(first) - end > most_gap, F.lit(True)).cast("long")
    known = lambda t: F.array_distinct(F.filter(F.coalesce(t, F.array().cast(dict(df.dtypes)[t])), lambda x: x.isNotNull())).alias(t)
    rows = df.withColumn("__fresh", fresh).withColumn("__run", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.select(*by, "__run", F.col(first).alias("__first"), F.col(last).alias("__last"), ident, *[known(t) for t in traits])
    rows = rows.repartition(*by, "__run").sortWithinPartitions(*by, "__run", "__first", ident)
    n, names = len(by), [*by, ident, "canonical"]
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, until, held, canonical = None, None, [], None
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                key, start, stop, me, facts = row[: n + 1], row[n + 1], row[n + 2], row[n + 3], [set(x) for x in row[n + 4 :]]
                joins = key == stretch and 0 < start - until <= most_gap and all(not a or not b or a & b for a, b in zip(held, facts))
                if joins:
                    until, held = max(until, stop), [a | b for a, b in zip(held, facts)]
                else:
                    stretch, until, held, canonical = key, stop, facts, me
                out.append(canonical)
            kept = [batch.column(i) for i in [*range(n), n + 3]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, kept[-1].type)], names)

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*by, ident]) + f", canonical {kinds[ident]}")


def _patterns(by: Sequence[str], order: Sequence[str], label: Column) -> tuple[Column, Column]:
    w = Window.partitionBy(*by).orderBy(*order)
    one, two = F.lag(label, 1).over(w), F.lag(label, 2).over(w)
    pattern = F.when(label == one, PATTERNS[0]).when(label == two, PATTERNS[1]).otherwise(PATTERNS[2])
    return pattern, F.row_number().over(w)


def learn_transitions(df: DataFrame, by: Sequence[str], order: Sequence[str], label: Column, relation: Column) -> DataFrame:
    """(relation, pattern, n, share): how often a row's label is that of the row before (same), of
    the one before that (back) or another, by the row's relation to the row before; shares are
    smoothed by one count a pattern. A null label equals none; rows without a relation, and the first
    of each chain, are left out."""
    pattern, place = _patterns(by, order, label)
    rows = df.select(relation.alias("relation"), pattern.alias("pattern"), place.alias("place")).where("place > 1 AND relation IS NOT NULL")
    counts = rows.groupBy("relation", "pattern").agg(F.count("*").alias("n"))
    total = counts.groupBy("relation").agg(F.sum("n").alias("total"))
    grid = total.withColumn("pattern", F.explode(F.array(*[F.lit(p) for p in PATTERNS])))
    n = F.coalesce("n", F.lit(0))
    return grid.join(counts, ["relation", "pattern"], "left").select("relation", "pattern", n.alias("n"), ((n + 1) / (F.col("total") + len(PATTERNS))).alias("share"))


def best_chain(scores: np.ndarray, steps: np.ndarray) -> list[int]:
    """M7: the likeliest labels under log scores (n, k) and, for each row, the logs of the three
    patterns (n, 3). The state is the pair of the last two labels; of equal chains the one whose
    earlier labels are smaller."""
    n, k = scores.shape
    if n == 1:
        return [int(scores[0].argmax())]
    eye = np.eye(k, dtype=bool)
    best = scores[0][:, None] + scores[1][None] + np.where(eye, steps[1, 0], steps[1, 2])
    back = []
    for t in range(2, n):
        same, twice, other = steps[t]
        # axes: the label before last, the last, this one
        move = np.where(eye[None], same, np.where(eye[:, None, :], twice, other))
        step = best[:, :, None] + move
        back.append(step.argmax(0))
        best = step.max(0) + scores[t][None]
    a, b = divmod(int(best.argmax()), k)
    path = [b, a]
    for table in reversed(back):
        a, b = int(table[a, b]), a
        path.append(a)
    return path[::-1]


def decode_chains(df: DataFrame, by: Sequence[str], order: Sequence[str], ident: str, scores: Column, relation: Column, transitions: DataFrame, weight: float = 1.0) -> DataFrame:
    """M7: (by, ident, choice): the index of each row's label in its array of log scores, on the likeliest
    chain. `transitions` is a table as `learn_transitions` gives it: three rows a relation, joined to the
    rows by broadcast as the relations are kinds. A relation it does not have counts all patterns alike.

    A chain must fit a task: its decoding runs through all its rows."""
    logs = transitions.groupBy("relation").agg(*[F.max(F.when(F.col("pattern") == p, F.log("share"))).alias(p) for p in PATTERNS])
    even = F.lit(float(np.log(1 / len(PATTERNS))))
    rows = df.withColumn("relation", relation).withColumn("__scores", scores).join(F.broadcast(logs), "relation", "left")
    rows = rows.select(*by, *[c for c in order if c not in by and c != ident], ident, "__scores", F.array(*[weight * F.coalesce(p, even) for p in PATTERNS]).alias("__steps"))

    def decode(part: pd.DataFrame) -> pd.DataFrame:
        return part.assign(choice=best_chain(np.stack(part["__scores"]), np.stack(part["__steps"])))[[*by, ident, "choice"]]

    kinds = dict(df.dtypes)
    return grouped(rows, by, order, decode, ", ".join(f"`{c}` {kinds[c]}" for c in [*by, ident]) + ", choice int")


def pack_units(df: DataFrame, by: Sequence[str], order: Sequence[str], unit: str, most: int) -> DataFrame:
    """`df` with batch, from 0 in each group. Rows of a `unit` (a run of equal values in the order)
    stay in one batch, units fill batches in order up to `most` rows; a unit of more than `most` rows is cut
    into batches of its own.

    Where a unit is over the cap packing begins anew behind it, and at each group; the rows run through in order and
    all that is kept is how full the batch is."""
    if most < 1:
        raise ValueError("a batch must hold a row")
    w = Window.partitionBy(*by).orderBy(*order)
    fresh = F.coalesce(~F.col(unit).eqNullSafe(F.lag(unit).over(w)) | (F.row_number().over(w) == 1), F.lit(True))
    rows = df.withColumn("__run", F.sum(fresh.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__size", F.count("*").over(Window.partitionBy(*by, "__run")))
    rows = rows.select(*df.columns, "__run", "__size").repartition(*by).sortWithinPartitions(*by, *order)
    names, at = df.columns, [df.columns.index(b) for b in by]
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, unit_now, batch_no, held, inside = None, None, 0, 0, 0
        for batch in batches:
            out = []
            keys = zip(*[batch.column(i).to_pylist() for i in at]) if at else iter(lambda: (), None)
            for key, of, size in zip(keys, batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()):
                if key != group:
                    group, unit_now, batch_no, held = key, None, 0, 0
                if of != unit_now:
                    unit_now, inside = of, 0
                    if held and held + size > most:
                        batch_no, held = batch_no + 1, 0
                if held == most:  # only within a unit over the cap
                    batch_no, held = batch_no + 1, 0
                held, inside = held + 1, inside + 1
                out.append(batch_no)
                if inside == size > most:
                    batch_no, held = batch_no + 1, 0
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(width)], pa.array(out, pa.int64())], [*names, "batch"])

    kinds = dict(df.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in df.columns) + ", batch long")
