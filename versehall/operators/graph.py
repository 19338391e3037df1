"""Connected components by joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versehall.staging import forget, stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that can be reached, for every node of `edges` (of any type
    that can be ordered; both ends alike). An edge from a node to itself makes the node known; rows
    with a null end are left out.

    In each round every node and its present root take the least root found over their edges, then
    every node takes its root's root; so trees are joined and made shallow at once, and long paths
    need rounds in proportion to the logarithm of their length. The rounds' tables are staged, which
    leaves plain shuffles on both sides of every join: a hub with a third of all edges can be split."""
    one = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = stage(one.union(one.select("b", "a")).distinct(), "component-edges")
    roots = stage(both.groupBy("a").agg(F.min("b").alias("root")).select("a", F.least("a", "root").alias("root")), "roots")
    while True:
        old = roots
        far = roots.select(F.col("a").alias("b"), F.col("root").alias("over"))
        seen = both.join(roots.hint("merge"), "a").join(far.hint("merge"), "b")
        offers = seen.select("a", "over").union(seen.select(F.col("root").alias("a"), "over")).groupBy("a").agg(F.min("over").alias("over"))
        hooked = stage(roots.join(offers, "a", "left").select("a", F.least("root", F.coalesce("over", "root")).alias("root")), "hooked")
        up = hooked.select(F.col("a").alias("root"), F.col("root").alias("top"))
        roots = stage(hooked.join(up.hint("merge"), "root").select("a", F.col("top").alias("root"), (F.col("top") < F.col("root")).alias("moved")), "roots")
        changed = roots.where("moved").limit(1).count() or roots.join(old.select("a", F.col("root").alias("was")), "a").where("root < was").limit(1).count()
        forget(hooked, old)
        if not changed:
            forget(both)
            return roots.select(F.col("a").alias("node"), F.col("root").alias("component"))
        roots_path = roots.stage_path
        roots = roots.select("a", "root")
        roots.stage_path = roots_path
