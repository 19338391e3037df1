"""Nearest items by feature space: grid cells, distances, top-k, sequential selection."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versehall.staging import stage


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows of each key, as rank."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pull(x: Column, y: Column, confidence: Column, weak: float = 0.2, calm: tuple[float, float] = (0.15, -0.55)) -> tuple[Column, Column]:
    """M3: the point to find music for: a weak mood is drawn to the calm one by what it lacks."""
    share = F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0)) / weak)
    return share * F.coalesce(x, F.lit(0.0)) + (1 - share) * calm[0], share * F.coalesce(y, F.lit(0.0)) + (1 - share) * calm[1]


def spread_of(sd: Column, confidence: Column, missing: float = 0.35, uncertain: float = 0.4) -> Column:
    """M4: a scene's uncertainty on an axis, its lines' spread and what its confidence (0 to 1) lacks."""
    lack = 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0))))
    return F.hypot(F.coalesce(sd, F.lit(missing)), uncertain * lack)


def log_sum_exp(logs: Column) -> Column:
    """M4: the logarithm of a sum of exponentials, without overflow; null for an empty array."""
    top = F.array_max(logs)
    return top + F.log(F.aggregate(logs, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


BLOCK = 256  # points of a cell that are compared at once


def _blocks(points: DataFrame, row: Column, name: str, tasks: int) -> DataFrame:
    """Points (x, y, cx, cy) by cells, those of a full cell in several rows: (cx, cy, `name`: sorted array of `row`)."""
    full = points.groupBy("cx", "cy").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64("x", "y"), F.col("parts")).alias("part")
    rows = points.join(full, ["cx", "cy"]).select("cx", "cy", part, row.alias("row")).repartition(tasks, "cx", "cy")
    return rows.groupBy("cx", "cy", "part").agg(F.sort_array(F.collect_list("row")).alias(name)).drop("part")


def _nearest_of_blocks(pairs: DataFrame, weights: tuple[float, float], most: float, k: int, kind: str) -> DataFrame:
    """(x, y, id, d): for each point of a row's block `own` the k nearest of its block `others`, closer than `most`,
    ties to the smaller id. A task holds the distances of one pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(*(batch.column(c) for c in ("own", "others"))):
                a, b = a.values, b.values
                (x, y), (x2, y2) = ([v.field(c).to_numpy() for c in "xy"] for v in (a, b))
                d = np.sqrt(weights[0] * (x[:, None] - x2) ** 2 + weights[1] * (y[:, None] - y2) ** 2)
                d[~(d < most)] = np.inf
                for _ in range(min(k, len(b))):
                    at = d.argmin(1)  # the first of equals: others stand in order of their ids
                    far = d[np.arange(len(a)), at]
                    d[np.arange(len(a)), at] = np.inf
                    if (near := np.isfinite(far)).any():
                        yield pa.RecordBatch.from_arrays([pa.array(x[near]), pa.array(y[near]), b.field("id").take(pa.array(at[near])), pa.array(far[near])], ["x", "y", "id", "d"])

    return pairs.select("own", "others").mapInArrow(run, f"x double, y double, id {kind}, d double")


def nearest_in_grid(points: DataFrame, key: str, xy: tuple[str, str], weights: tuple[float, float], most: float, k: int, n: int = 5, per_cell: int = 128) -> DataFrame:
    """For each point its k nearest others in its own and the eight neighbouring cells of the
    n x n grid, no further than `most`: (key, near, d, rank), ties to the smaller key.

    d = sqrt(sum of weight * difference squared). Points are compared block by block of a cell, and only the k + 1
    nearest of each block go on. Cells are cut so that one holds some `per_cell`
    points; a point is done once k others lie nearer than anything outside the cells around it can, the
    rest goes on with cells twice as wide, up to those of the grid itself. Of equal points only the
    k + 1 smallest keys can be anybody's nearest; they are searched for once."""
    x, y = xy
    own = points.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))
    near = stage(own.withColumn("r", first).where(F.col("r") <= k + 1).select("id", "x", "y"), "grid-points")
    open_ = near.select("x", "y").distinct()
    size = near.count()
    parts = 1 << max(0, round(math.log2(max(1.0, size / (n * n) / per_cell)) / 2))
    tasks = max(8, math.ceil(size / 8192))
    fast, out = math.sqrt(min(weights)) * 2 / n, None

    def cell(v: Column, m: int) -> Column:
        # the border cells of the grid hold all that lies beyond; finer cells go on outside
        return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((v + 1) / 2 * n))).cast("long") if m == 1 else F.floor((v + 1) / 2 * n * m).cast("long")

    while True:
        around = F.sequence(F.lit(-1), F.lit(1))
        cells = [cell(F.col("x"), parts).alias("cx"), cell(F.col("y"), parts).alias("cy")]
        a = _blocks(open_.select("x", "y", *cells), F.struct("x", "y"), "own", tasks).withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
        a = a.select((F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), "own").repartition(tasks, "cx", "cy")
        b = _blocks(near.select("id", "x", "y", *cells), F.struct("id", "x", "y"), "others", tasks)
        best = Window.partitionBy("x", "y").orderBy("d", "id")
        hits = _nearest_of_blocks(a.join(b.hint("merge"), ["cx", "cy"]), weights, most, k + 1, dict(near.dtypes)["id"])
        pairs = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
        lists = stage(pairs.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("hits")), "grid-hits")
        sure = F.lit(parts == 1) | ((F.size("hits") == k + 1) & (F.element_at("hits", -1)["d"] <= fast / parts))
        found = lists.where(sure)
        out = found if out is None else out.union(found)
        if parts == 1:
            break
        open_ = stage(open_.join(found.select("x", "y"), ["x", "y"], "left_anti"), "grid-open")
        parts //= 2
    rows = own.join(out, ["x", "y"]).select("id", F.slice(F.filter("hits", lambda h: h["id"] != F.col("id")), 1, k).alias("hits"))
    rows = rows.select("id", F.posexplode("hits").alias("p", "h"))
    return rows.select(F.col("id").alias(key), F.col("h.id").alias("near"), F.col("h.d").alias("d"), (F.col("p") + 1).cast("int").alias("rank"))


def pick_tracks(candidates: DataFrame, by: str, scene: str, track: str, cost: str, recent: int = 3, pins: DataFrame | None = None, kept: DataFrame | None = None, banned: DataFrame | None = None) -> DataFrame:
    """Scene after scene a pinned track (`pins`: by, scene, track), else the one kept from an
    earlier choice (`kept`, unless banned), else the cheapest track not used in the last `recent` tracks;
    where all were, the cheapest. A track that goes on into the next scene is used once. `banned` (by,
    track) are never chosen, but may be pinned. Scenes without a candidate get none.

    Only the recent + 1 cheapest tracks of a scene can be chosen, so that is all that is sent; scenes
    are sequential within one `by`, whose scenes must fit a task; books are independent."""
    name = lambda df, to: df.select(by, scene, F.col(track).alias(to))
    if banned is not None:
        candidates = candidates.join(banned.select(by, track).distinct(), [by, track], "left_anti")
        kept = kept and kept.join(banned.select(by, track).distinct(), [by, track], "left_anti")
    rank = F.row_number().over(Window.partitionBy(by, scene).orderBy(cost, track))
    rows = candidates.select(by, scene, track, cost).withColumn("r", rank).where(F.col("r") <= recent + 1)
    rows = rows.groupBy(by, scene).agg(F.sort_array(F.collect_list(F.struct(cost, track))).alias("own"))
    none = F.lit(None).cast(dict(candidates.dtypes)[track])
    for given, to in ((pins, "pin"), (kept, "keep")):
        rows = rows.withColumn(to, none) if given is None else rows.join(name(given, to), [by, scene], "full")
    kinds = dict(candidates.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        used: list = []
        out = []
        for row in part.sort_values(scene).itertuples():
            set_ = next((x for x in (row.pin, row.keep) if not pd.isna(x)), None)
            own = [(c[cost], c[track]) for c in (row.own if row.own is not None else ())]
            free = [c for c in own if c[1] not in used[-recent:]] or own
            price, pick = (None, set_) if set_ is not None else free[0] if free else (None, None)
            if pick is not None and used[-1:] != [pick]:
                used.append(pick)
            out.append((getattr(row, by), getattr(row, scene), pick, price, not pd.isna(row.pin)))
        return pd.DataFrame(out, columns=[by, scene, track, cost, "pinned"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in (by, scene, track, cost))
    return rows.groupBy(by).applyInPandas(run, f"{schema}, pinned boolean")
