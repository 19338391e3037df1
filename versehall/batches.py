"""Rows of Arrow batches for a Python function, and what it makes of them, a few thousand at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

TAKEN, MADE = 256, 4096  # rows that a task holds as Python objects: of a batch, and of what it makes


def explode(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: str, taken: int = TAKEN, most: int = MADE) -> DataFrame:
    """The rows that `fn` makes of the values of each row. However many they are, and however many rows
    come in a batch, a task holds no more than a slice of them."""
    spec = to_arrow_schema(StructType.fromDDL(schema))

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, taken):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, taken).columns)):
                    yield from fn(*row)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = made(batches)
        while part := list(islice(rows, most)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), spec)], schema=spec)

    return df.mapInArrow(run, schema)


def in_order(df: DataFrame, by: str, order: Sequence[Column], start: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """The rows that a function makes of each unit's rows in `order`, one at a time: `start` gives a new
    function for each value of `by`, which comes first in `df`. What the function keeps is all that a task
    holds of a unit."""
    step: list = [None, None]

    def fn(unit, *row) -> Iterable[tuple]:
        if step[1] is None or unit != step[0]:
            step[:] = unit, start()
        return ((unit, *x) for x in step[1](*row))

    return explode(df.repartition(by).sortWithinPartitions(by, *order), fn, schema)
