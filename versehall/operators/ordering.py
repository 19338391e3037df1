"""Exact order statistics of groups of any size, without a task that holds or sorts a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versehall.staging import forget, stage

BINS = 1024
FEW = 4096  # rows of an interval that one task may sort


def order_statistics(df: DataFrame, by: Sequence[str], value: Column, targets: DataFrame) -> DataFrame:
    """(by, k, stat): the k-th smallest value (from 0) of each group, for rows (by, k) of `targets`.
    Values are doubles; nulls are left out; a k beyond the group has no row.

    Each round counts the values of a target's interval in BINS bins of equal width, by partial sums,
    and goes on in the bin that holds the target, cut to the values that are in it. An interval of one value
    is the answer; one of at most FEW rows is sorted. Doubles leave few rounds, whatever their
    distribution: each takes the interval to less than a thousandth."""
    rows = df.select(*[F.col(c).alias(f"g_{i}") for i, c in enumerate(by)], value.cast("double").alias("v")).where("v IS NOT NULL")
    names = [f"g_{i}" for i in range(len(by))]
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
    whole = rows.groupBy(*names).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("size"))
    asked = targets.select(*[F.col(c).alias(f"g_{i}") for i, c in enumerate(by)], F.col("k").cast("long").alias("k")).distinct()
    start = asked.alias("t").join(whole.alias("w"), same("t", "w") or F.lit(True)).select(*[f"t.{c}" for c in names], "k", "lo", "hi", "size", F.lit(0).cast("long").alias("before"))
    state = stage(start.where("k >= 0 AND k < size"), "order-state")
    wide = (F.col("lo") < F.col("hi")) & (F.col("size") > FEW)

    def inside(of: DataFrame) -> DataFrame:
        """Rows with the targets whose interval they lie in."""
        few = F.broadcast(of) if of.count() <= 100_000 else of
        met = rows.alias("r").join(few.alias("s"), [*same("r", "s"), F.col("v") >= F.col("lo"), F.col("v") <= F.col("hi")])
        return met.select(*[f"s.{c}" for c in names], "k", "lo", "hi", "before", "v")

    while state.where(wide).limit(1).count():
        open_ = stage(state.where(wide), "order-open")
        width = F.col("hi") / 2 - F.col("lo") / 2  # halves, so that no difference is beyond a double
        bin_ = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / width * BINS), F.lit(BINS - 1)).cast("int")
        bins = inside(open_).withColumn("bin", bin_).groupBy(*names, "k", "before", "bin").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("size"))
        upto = F.coalesce(F.sum("size").over(Window.partitionBy(*names, "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = bins.withColumn("before", F.col("before") + upto).where("before <= k AND k < before + size")
        fresh = stage(state.where(~wide).unionByName(bins.select(*state.columns)), "order-state")
        forget(state, open_)
        state = fresh
    one = state.where("lo = hi").select(*names, "k", F.col("lo").alias("stat"))
    rest = stage(state.where("lo < hi"), "order-rest")
    place = F.row_number().over(Window.partitionBy(*names, "k").orderBy("v")) - 1
    sorted_ = inside(rest).withColumn("place", place).where("place + before = k").select(*names, "k", F.col("v").alias("stat"))
    return one.union(sorted_).select(*[F.col(f"g_{i}").alias(c) for i, c in enumerate(by)], "k", "stat")


def quantiles(df: DataFrame, by: Sequence[str], value: Column, shares: Sequence[float]) -> DataFrame:
    """(by, share, quantile), exact, between two values by a straight line."""
    n = df.where(value.isNotNull()).groupBy(*by).agg(F.count("*").alias("__n"))
    wants = stage(n.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("__at", F.col("share") * (F.col("__n") - 1)), "quantiles")
    low, high = F.floor("__at").cast("long"), F.ceil("__at").cast("long")
    found = stage(order_statistics(df, by, value, wants.select(*by, low.alias("k")).union(wants.select(*by, high.alias("k")))), "order")
    side = lambda c: found.select(*[F.col(b).alias(f"{c}_{b}") for b in by], F.col("k").alias(f"{c}_k"), F.col("stat").alias(c))
    on = lambda c, k: [k == F.col(f"{c}_k"), *[F.col(b).eqNullSafe(F.col(f"{c}_{b}")) for b in by]]
    both = wants.join(side("low"), on("low", low)).join(side("high"), on("high", high))
    part = F.col("__at") - F.floor("__at")
    return both.select(*by, "share", (F.col("low") + part * (F.col("high") - F.col("low"))).alias("quantile"))


def keep_by_threshold(df: DataFrame, by: Sequence[str], score: Column, share: float) -> DataFrame:
    """Of each class every row whose score is at least that at place max(1, floor(n * share))
    from the top: ties at the cut stay, and a class of one row keeps it. Rows without a score go. The rows are
    staged, as each round of `order_statistics` reads them."""
    rows = stage(df.withColumn("__score", score.cast("double")).where("__score IS NOT NULL"), "scored")
    n = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    cut = n.select(*by, (F.col("__n") - F.greatest(F.lit(1), F.floor(F.col("__n") * share))).cast("long").alias("k"))
    cuts = stage(order_statistics(rows, by, F.col("__score"), cut), "cuts").select(*[F.col(b).alias(f"__c_{b}") for b in by], "stat")
    few = F.broadcast(cuts) if cuts.count() <= 100_000 else cuts
    on = [F.col(b).eqNullSafe(F.col(f"__c_{b}")) for b in by]
    return rows.join(few, [*on, F.col("__score") >= F.col("stat")]).select(*df.columns)


def margins(probs: DataFrame, keys: Sequence[str], label: str, p: str) -> DataFrame:
    """(keys, label, best, margin) of rows (keys, label, p): the likeliest label (a null one is the
    class of none; ties to the smaller label, none last) and how far its log probability lies above the next one's."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(p).desc(), F.col(label).asc_nulls_last()))
    two = probs.withColumn("__r", place).where("__r <= 2").groupBy(*keys).agg(
        F.max_by(F.struct(label), -F.col("__r")).alias("__l"), F.max(p).alias("best"), F.max(F.when(F.col("__r") == 2, F.col(p))).alias("__next"))
    tiny = F.lit(1e-12)
    margin = F.log(F.greatest("best", tiny)) - F.log(F.greatest(F.coalesce("__next", F.lit(0.0)), tiny))
    return two.select(*keys, F.col(f"__l.{label}").alias(label), "best", margin.alias("margin"))
