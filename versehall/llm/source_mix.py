"""Mixing sources to target weights by capped water-filling.

Every source asks for a share of the mix in proportion to its weight and may be repeated at most
`max_epochs` times. Shares above that cap are clamped to it, the excess goes to the others by
weight, and so on until none is above. A source's epochs (target / size) then give every document
its whole repetitions and, by a seeded draw, one more for the fraction.

The draw orders a source's documents by a keyed hash and takes them up to the fraction of the
source's size. The cut is found by a histogram of the hash and, inside its one boundary bin, by a
running sum, so that no source is ever ordered as a whole.

Defined cases: null text has size 0, a text of any length its whole number of words; the null source is a source of its own, last in order; rows
of the same doc_id share their draw unless `row_key` tells them apart; with no rows or no words
all targets are 0; columns besides those named are carried along untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versehall.llm.common import stage, unused

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096
HASH_BITS = 60


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str, *keys: Column) -> Column:
    """A keyed uniform draw as a long of 60 bits."""
    key = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, size); weights repeat along the
    sources in code point order, null last. Staged; only sums over sources reach the driver."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # ranks without ordering everything in one task: ranges of sources, numbered within and then range by range
    order = [F.col("source").isNull(), F.col("source")]
    ranged = stage(stage(totals, "source-totals").repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "source-ranges")
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    ranges = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1 + F.col("before")
    placed = ranged.join(F.broadcast(ranges), "range").select("source", "source_size", place.alias("place"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    cur = stage(placed.select("source", "source_size", weight.alias("w"), (F.col("source_size") * max_epochs).alias("cap")), "source-weights")
    every, free = cur.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    whole = every * share
    rest, n = whole, 0
    while True:  # the level rises from round to round, so what was clamped once stays so
        level = F.col("w") * F.lit(rest) / F.lit(free or 1.0)
        over = level > F.col("cap")
        clamped, capped, unclamped = cur.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~over, F.col("w")))).first()
        if clamped == n or not unclamped:
            break
        n, rest, free = clamped, whole - capped, unclamped
    target = F.when(over, F.col("cap")).otherwise(level).cast("double")
    return cur.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix-1", row_key: Sequence[str] = ("doc_id",), prefix: str = "") -> DataFrame:
    """All rows of `docs` with size, source_size, target (their source's) and repeats, the number
    of times the mix takes the row. The four names take `prefix`; columns of that name are replaced."""
    size_, u_, source_, whole_, target_, cut_ = unused(docs, "__size", "__u", "__source", "__source_size", "__target", "__cut")
    sized = docs.select("*", n_words(F.col("text")).alias(size_), draw(seed, *[F.col(k) for k in row_key]).alias(u_))
    slim = stage(sized.select("source", F.col(size_).alias("size"), F.col(u_).alias("u")), "sizes")
    targets = source_targets(slim, weights, share, max_epochs)
    slim = slim.withColumn("bin", F.shiftright("u", HASH_BITS - 12).cast("int"))
    part = (F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).alias("part")
    # words of the fraction still missing before each bin, at most BINS rows a source
    bins = slim.groupBy("source", "bin").agg(F.sum("size").alias("in_bin"))
    upto = F.sum("in_bin").over(Window.partitionBy("source").orderBy("bin"))
    wanted = targets.where("source_size > 0").select(F.col("source").alias("s"), part)
    edge = bins.withColumn("upto", upto).join(wanted, F.col("source").eqNullSafe(F.col("s"))).where("upto > part AND upto - in_bin <= part")
    edge = stage(edge.select(F.col("source").alias("s"), F.col("bin").alias("cut_bin"), (F.col("part") - (F.col("upto") - F.col("in_bin"))).alias("left")), "mix-edges")
    # inside the boundary bin: take rows while that brings the sum nearer to what is left
    inside = slim.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("cut_bin")))
    inside = inside.groupBy("s", "cut_bin", "left", "u").agg(F.sum("size").alias("size"))
    run = F.sum("size").over(Window.partitionBy("s").orderBy("u"))
    cuts = inside.withColumn("upto", run).where("upto - size / 2 <= left").groupBy(F.col("s").alias("c")).agg(F.max("u").alias("cut"))
    plan = targets.join(edge.join(cuts, F.col("s").eqNullSafe(F.col("c")), "left").select("s", "cut_bin", "cut"), F.col("source").eqNullSafe(F.col("s")), "left")
    bound = F.when(F.col("cut_bin").isNull(), F.lit(-1)).otherwise(F.coalesce("cut", F.shiftleft(F.col("cut_bin").cast("long"), HASH_BITS - 12) - 1))
    made = {source_: F.col("source"), whole_: F.col("source_size"), target_: F.col("target"), cut_: bound.cast("long")}
    plan = stage(plan.select(*[c.alias(k) for k, c in made.items()]), "mix-plan")
    whole = F.coalesce(F.floor(F.col(target_) / F.nullif(F.col(whole_).cast("double"), F.lit(0.0))), F.lit(0)).cast("long")
    new = {"size": F.col(size_), "source_size": F.col(whole_), "target": F.col(target_), "repeats": whole + (F.col(u_) <= F.col(cut_)).cast("long")}
    kept = [c for c in docs.columns if c.lower() not in {(prefix + k).lower() for k in new}]
    out = sized.join(plan, F.col("source").eqNullSafe(F.col(source_)))
    return out.select(*kept, *[c.alias(prefix + k) for k, c in new.items()])
