"""Answers held against gold rows with several right ones, and annotators against each other.

A gold row has arrays of what counts as right: kinds, speakers (name, credit), emotions, paces and
volumes in order of preference, a range of intensity (low, high) and a gender (m, f, u). An answer
has one value an axis. A row is spoken unless narration is its only kind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each axis weighs in the score, in percent.
WEIGHTS = {"speaker": 45, "emotion": 15, "kind": 10, "intensity": 10, "pace": 5, "volume": 5, "gender": 10}
NARRATOR, CROWD, NARRATION = "NARRATOR", "NPC*", "narration"


def _spoken(kinds: Column) -> Column:
    return F.exists(kinds, lambda k: k != NARRATION)


def _has(options: Column, value: Column) -> Column:
    return F.coalesce(F.array_contains(options, value), F.lit(False))


def axis_credits(gold: DataFrame, answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, axis, credit) of all answers to gold rows, one row an axis that is asked.

    The speaker is asked of spoken rows, by credit, and of narration only where somebody else is named (no
    credit). The gender is asked where the gold row has one and the speaker has some credit and is not
    one of a crowd."""
    axes = ["kind", "speaker", "emotion", "intensity", "pace", "volume", "gender"]
    both = gold.join(answers.select(*keys, *[F.col(a).alias(f"__{a}") for a in axes]), list(keys))
    right = F.filter("speakers", lambda x: x["name"] == F.coalesce("__speaker", F.lit("")))
    credit = F.coalesce(F.array_max(F.transform(right, lambda x: x["credit"].cast("double"))), F.lit(0.0))
    spoken = _spoken(F.col("kinds"))
    sure = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    gender = F.when(F.col("gender") == "m", "male").when(F.col("gender") == "f", "female")
    asked = {
        "kind": sure(_has(F.col("kinds"), F.col("__kind"))),
        "speaker": F.when(spoken, credit).when(F.coalesce("__speaker", F.lit("")) != NARRATOR, 0.0),
        "emotion": sure(_has(F.col("emotions"), F.col("__emotion"))),
        "intensity": sure(F.coalesce("__intensity", F.lit(0)).between(F.col("low"), F.col("high"))),
        "pace": sure(_has(F.col("paces"), F.col("__pace"))),
        "volume": sure(_has(F.col("volumes"), F.col("__volume"))),
        "gender": F.when(gender.isNotNull() & (credit > 0) & (F.col("__speaker") != CROWD), sure(F.col("__gender") == gender)),
    }
    rows = F.array(*[F.struct(F.lit(a).alias("axis"), c.alias("credit")) for a, c in asked.items()])
    return both.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.axis", "x.credit").where("credit IS NOT NULL")


def weighted_score(credits: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(axis, earned, possible, rate, weighted): an axis that nothing asked counts nothing. The score is
    the sum of `weighted`."""
    sums = credits.groupBy("axis").agg(F.sum("credit").alias("earned"), F.count("*").alias("possible"))
    weight = F.create_map(*[F.lit(x) for a, w in weights.items() for x in (a, float(w))])
    rate = F.col("earned") / F.col("possible")
    return sums.select("axis", "earned", "possible", rate.alias("rate"), (F.element_at(weight, F.col("axis")) * rate).alias("weighted"))


def agreement(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of two annotators' gold rows of the same keys: how many rows, how many spoken to either; of
    the spoken ones the share with the same preferred speaker and with compatible ones (each one's
    preferred has full credit with the other), of all the share with the same kinds, the same preferred
    emotion and a common emotion. One row, zeros where there is nothing to compare."""
    own = ["kinds", "speakers", "emotions"]
    both = a.select(*keys, *own).join(b.select(*keys, *[F.col(c).alias(f"__{c}") for c in own]), list(keys))
    full = lambda s: F.transform(F.filter(s, lambda x: x["credit"] == 1.0), lambda x: x["name"])
    first = lambda s: F.get(s, F.lit(0))["name"]
    sets = lambda x: F.array_sort(F.array_distinct(x))
    spoken = _spoken(F.col("kinds")) | _spoken(F.col("__kinds"))
    rows = both.select(
        spoken.alias("spoken"), first(F.col("speakers")).eqNullSafe(first(F.col("__speakers"))).alias("preferred"),
        (_has(full(F.col("__speakers")), first(F.col("speakers"))) & _has(full(F.col("speakers")), first(F.col("__speakers")))).alias("compatible"),
        (sets("kinds") == sets("__kinds")).alias("kinds"), F.get("emotions", F.lit(0)).eqNullSafe(F.get("__emotions", F.lit(0))).alias("emotion"), F.arrays_overlap("emotions", "__emotions").alias("overlap"),
    )
    n, k = F.greatest(F.count("*"), F.lit(1)), F.greatest(F.count_if("spoken"), F.lit(1))
    share = lambda c, of, name: (F.count_if(c) / of).alias(name)
    s = F.col("spoken")
    return rows.agg(
        F.count("*").alias("rows"), F.count_if("spoken").alias("spoken"), share(s & F.col("preferred"), k, "speaker_preferred"), share(s & F.col("compatible"), k, "speaker_compatible"),
        share(F.col("kinds"), n, "kinds_same"), share(F.col("emotion"), n, "emotion_preferred"), share(F.col("overlap"), n, "emotion_overlap"),
    )
