"""Shared helpers of the training-data operators: staging, Arrow batches, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versehall.session import ship  # noqa: F401
from versehall.staging import clear_stages, forget, own_path, shared_dir, stage, unused  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach(rows: DataFrame, small: DataFrame, key: str, spread: Column, most: int = 100_000, salts: int = 16) -> DataFrame:
    """`rows` left joined with a table of one row a key. That table is broadcast while it has at most
    `most` rows; beyond, both are dealt out by key and a salt taken from `spread`, so that neither a
    hot key nor the rows without one land in one task. A null key meets nothing."""
    if small.count() <= most:
        return rows.join(F.broadcast(small), key, "left")
    dealt = small.where(F.col(key).isNotNull()).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    kept = small.columns
    dealt = dealt.select(*[F.col(c).alias(f"__{c}" if c == key else c) for c in kept], F.col("__salt").alias("__s"))
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    # a null key gets a hash of the row in its place, of no key's type and salt
    on = [F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\x00"), F.xxhash64(spread).cast("string"))) == F.col(f"__{key}").cast("string"), salt == F.col("__s")]
    return rows.join(dealt, on, "left").drop(f"__{key}", "__s")


def in_arrow(df: DataFrame, rows: Callable[[dict], dict], schema: str, max_rows: int = 512, max_bytes: int = 16 << 20) -> DataFrame:
    """Apply `rows` (dict of column lists -> dict of column lists) to slices of at most `max_rows`
    rows and some `max_bytes` (a longer row is a slice of its own), so that what is in the Python
    worker at once stays small however long the texts are."""
    ship(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, max_rows)
                while part.num_rows > 1 and part.nbytes > max_bytes:
                    part = part.slice(0, part.num_rows // 2)
                at += part.num_rows
                made = rows({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, max_rounds: int = 60, large: int = 1 << 20) -> DataFrame:
    """Connected components of `edges` (a, b): rows (node, component = smallest node).

    Alternating large-star and small-star steps; every step is a grouped minimum (partial
    aggregation) and an equi-join. From `large` edges on the minima are staged, so that both sides
    of the joins are plain shuffles and adaptive execution can split a hub with a third of all
    edges. Nothing but the edge count and a checksum reaches the driver; each round's edges replace
    those of the round before. An empty edge table gives an empty result."""

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    cur = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = mark(cur)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        held = []

        def minima(low: DataFrame, big: bool = seen[0] >= large, held: list = held) -> DataFrame:
            if big:
                held.append(stage(low, "minima"))
                return held[-1].hint("merge")
            return low

        e = both(cur)
        low = minima(e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        grown = e.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        grown = grown.where("a <> b").distinct()
        if seen[0] >= large:
            grown = stage(grown, "large-stars")
            held.append(grown)
        low = minima(grown.groupBy("a").agg(F.min("b").alias("m")))
        small = grown.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        fresh = stage(small.where("a <> b").distinct(), "edges")
        forget(cur, *held)
        cur, now = fresh, mark(fresh)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(cur.select("b", F.col("b").alias("c")).distinct())
