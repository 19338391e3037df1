"""What the vector searches share: one row per distinct vector, and results spread to all copies.

Equal vectors are searched once. Of each only the k + 1 smallest ids can appear in any result, so
a vector that a third of all rows share costs no more than another one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versehall.llm.common import stage


def finite(v: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def distinct(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From rows (id, v, query): vectors (u, v, query), u the smallest id of equal ones and query
    whether one of them asks; members (u, id), at most k + 1 a vector; askers (id, u).

    A vector is known by 128 bits of hash, so that only its one copy travels with its components. The
    vector of a third of all rows is a hot key of narrow rows, which adaptive execution splits."""
    named = rows.select("id", "query", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit("second"), "v").alias("g"))
    ids = named.groupBy("h", "g").agg(F.min("id").alias("u"), F.max("query").alias("query"), F.first("v").alias("v"))
    vectors = stage(ids.select("u", "v", "query", "h", "g"), "vectors")
    own = named.select("id", "query", "h", "g").join(vectors.select("h", "g", "u").hint("merge"), ["h", "g"])
    own = stage(own.select("id", "u", "query"), "owners")
    first = F.row_number().over(Window.partitionBy("u").orderBy("id"))
    members = own.select("u", "id").distinct().withColumn("r", first).where(f"r <= {k + 1}").select("u", "id")
    return vectors.select("u", "v", "query"), members, own.where("query").select("id", "u")


def spread(found: DataFrame, members: DataFrame, askers: DataFrame, k: int) -> DataFrame:
    """Results of distinct vectors (q, u, score) to rows (query_id, rank, vec_id, score): the k
    highest scores of each asking row without itself, ties to the smaller id.

    `found` holds for every q at least its k + 1 best u over any number of blocks."""
    best = Window.partitionBy("q").orderBy(F.desc("score"), "u")
    top = found.withColumn("r", F.row_number().over(best)).where(f"r <= {k + 1}").join(members, "u")
    top = top.select("q", "score", "id").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(f"r <= {k + 1}")
    lists = top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("hits"))
    rows = askers.join(lists, askers["u"] == lists["q"]).select("id", "hits")
    others = F.slice(F.filter("hits", lambda x: x["id"] != F.col("id")), 1, k)
    rows = rows.select(F.col("id").alias("query_id"), F.posexplode(others).alias("p", "hit"))
    return rows.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest of `scores`, ties to the earlier place, best first."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= floor)
    else:
        places = np.arange(len(scores))
    return places[np.argsort(-scores[places], kind="stable")][:k]
