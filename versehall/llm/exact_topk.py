"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows, floor(scale * x). A block of rows is turned into postings, for
each dimension the rows with a weight there; a block of queries then walks the dimensions and
scatters its weights times the postings into a dense array of scores. The k best of every block are
picked by partition selection, and the blocks' picks merged.

The work is the number of queries times the number of rows, in blocks of fixed size, each a group of
its own; equal rows are taken once.

Defined cases: rows null or holding null or non-finite components take no part; shorter vectors
weigh nothing in the dimensions they lack; rows that repeat id and vector count once; a component whose product with the
scale is beyond a double counts as the largest double; scores beyond 64 bits are held
at their bound; fewer than k others give all of them; empty tables an empty result.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versehall.llm.common import ship
from versehall.llm.vectors import distinct, finite, spread, top

ROW_BLOCK, QUERY_BLOCK = 4096, 512
LONG = 1 << 63


def accumulate(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Scores (queries, rows) of integer-valued matrices, one dimension after the other."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1]
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
    if kind is object:  # exact whatever the size
        rows, queries = (np.vectorize(int, otypes=[object])(m) for m in (rows, queries))
    rows, queries = rows.astype(kind), queries.astype(kind)
    out = np.zeros((len(queries), len(rows)), kind)
    for q in range(0, len(queries), 64):  # so that the scores in work stay in the cache
        part = queries[q : q + 64]
        scores = np.zeros((len(rows), len(part)), kind)
        for d in range(rows.shape[1]):
            asks = np.flatnonzero(part[:, d])
            posting = np.flatnonzero(rows[:, d])
            if not len(asks) or not len(posting):
                continue
            weights = np.multiply.outer(rows[posting, d], part[:, d])
            if len(posting) == len(rows):
                scores += weights
            else:
                scores[posting] += weights
        out[q : q + 64] = scores.T
    return out


def floor_double(x: Column) -> Column:
    """floor() that stays a double: beyond 2**53 every double is whole already, and beyond the largest
    double it is held at that."""
    x = F.greatest(F.least(x, F.lit(sys.float_info.max)), F.lit(-sys.float_info.max))
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows (vec_id, embedding) that `is_query` picks."""
    ship(vectors.sparkSession)
    v = F.transform("embedding", lambda x: floor_double(x.cast("double") * scale))
    rows = vectors.where(finite(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    units, members, askers = distinct(rows, k)
    n, n_q = units.agg(F.count("*"), F.count_if("query")).first()
    row_blocks, query_blocks = max(1, math.ceil(n / ROW_BLOCK)), max(1, math.ceil(n_q / QUERY_BLOCK))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = units.select("u", "v", block("u", row_blocks).alias("rb"), every(query_blocks).alias("qb"))
    right = units.where("query").select(F.col("u").alias("q"), F.col("v").alias("w"), block("u", query_blocks).alias("b"), every(row_blocks).alias("a"))
    right = right.select("q", "w", F.col("a").alias("rb_q"), F.col("b").alias("qb_q"))

    def matrix(s: pd.Series, width: int) -> np.ndarray:
        out = np.zeros((len(s), width))
        for i, x in enumerate(s):
            out[i, : len(x)] = x
        return out

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"q": [], "u": [], "score": []}).astype("int64")
        rows = rows.sort_values("u", ignore_index=True)  # ties to the smaller id
        width = max(rows["v"].map(len).max(), queries["w"].map(len).max())
        scores = accumulate(matrix(rows["v"], width), matrix(queries["w"], width))
        q, u, s = [], [], []
        ids = rows["u"].to_numpy()
        for i, name in enumerate(queries["q"]):
            at = top(scores[i], k + 1)
            q += [name] * len(at)
            u.append(ids[at])
            s += [max(-LONG, min(LONG - 1, int(x))) for x in scores[i][at]]
        return pd.DataFrame({"q": q, "u": np.concatenate(u), "score": np.array(s, np.int64)})

    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb_q", "qb_q")).applyInPandas(run, "q long, u long, score long")
    return spread(found, members, askers, k)
