"""State of several devices merged as rows arrive.

A stream is folded, batch by batch, into state tables that keep one row a key: the greatest in a
given order. Such a fold does not depend on the order of arrival, on how rows fall into batches or on
repeats, so the state equals the batch operators' result over all rows seen so far.

A state table lies in buckets of its keys. A micro-batch rewrites only the buckets it touches, as a
new version beside the old one; the newest complete version of each bucket is the state. A batch that
is run again after a failure reads the versions below its own number and replaces what it wrote.
Nothing is forgotten at a watermark: deletions must outlive late rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from versehall.staging import forget, stage


@dataclass(frozen=True)
class Kept:
    """A state table: of the rows that `rows` makes of a batch, the greatest by `order` of each key."""

    rows: Callable[[DataFrame], DataFrame]
    keys: Sequence[str]
    order: Sequence[str] = ()


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the row that is greatest by `order`, with all columns."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    best = F.max_by(F.struct(*rest), F.struct(*order)) if order else F.first(F.struct(*rest))
    return rows.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*").select(*rows.columns)


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """bucket -> its versions that were written whole, ascending. Folder names only."""
    fs = spark._jvm.org.apache.hadoop.fs
    root = fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    number = lambda p: int(p.getName().split("=")[1])
    done = {number(f.getPath().getParent()) for f in system.globStatus(fs.Path(f"{path}/version=*/_SUCCESS")) or []}
    found: dict[int, list[int]] = {}
    for f in system.globStatus(fs.Path(f"{path}/version=*/bucket=*")) or []:
        version = number(f.getPath().getParent())
        if version in done:
            found.setdefault(number(f.getPath()), []).append(version)
    return {b: sorted(v) for b, v in found.items()}


def read_state(spark: SparkSession, path: str, name: str, below: int | None = None) -> DataFrame | None:
    """The state table as after the newest batch, or the newest one below a number; None before the first."""
    newest_of = {b: [v for v in vs if below is None or v < below] for b, vs in _versions(spark, f"{path}/{name}").items()}
    folders = [f"{path}/{name}/version={vs[-1]}/bucket={b}" for b, vs in sorted(newest_of.items()) if vs]
    if not folders:
        return None
    return spark.read.option("basePath", f"{path}/{name}").parquet(*folders).drop("version")


def _tidy(spark: SparkSession, path: str, upto: int) -> None:
    """Delete versions older than the newest one below `upto`, which a rerun of that batch would read."""
    fs = spark._jvm.org.apache.hadoop.fs
    system = fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for bucket, versions in _versions(spark, path).items():
        for old in [v for v in versions if v < upto][:-1]:
            system.delete(fs.Path(f"{path}/version={old}/bucket={bucket}"), True)


def fold_batch(batch: DataFrame, number: int, path: str, tables: dict[str, Kept], buckets: int = 16) -> None:
    """Merge one micro-batch into the state tables under `path`. May be repeated."""
    spark = batch.sparkSession
    for name, kept in tables.items():
        own = newest(kept.rows(batch), kept.keys, kept.order).withColumn("bucket", F.pmod(F.xxhash64(*kept.keys), F.lit(buckets)).cast("int"))
        fresh = stage(own, f"arrived-{name}")
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most `buckets` numbers
        if touched:
            held = read_state(spark, path, name, below=number)
            both = fresh if held is None else fresh.unionByName(held.where(F.col("bucket").isin(touched)))
            merged = newest(both, [*kept.keys, "bucket"], kept.order)
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}/version={number}")
            _tidy(spark, f"{path}/{name}", number)
        forget(fresh)


def merge_stream(stream: DataFrame, path: str, tables: dict[str, Kept], checkpoint: str, buckets: int = 16, **trigger) -> StreamingQuery:
    """Start folding `stream` into the state tables; `trigger` as for `DataStreamWriter.trigger`."""
    def step(batch: DataFrame, number: int) -> None:
        fold_batch(batch, number, path, tables, buckets)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
