"""Votes, scores and splits over labelled rows. Ties and empty inputs are resolved as each says."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versehall.operators.ranking import global_rank


def mode_vote(df: DataFrame, by: Sequence[str], value: str, default: str) -> DataFrame:
    """The most frequent value of each key, `default` where two lead; nulls do not vote."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    top = counts.groupBy(*by).agg(F.max("__n").alias("__top"))
    lead = counts.join(top, list(by)).where("__n = __top").groupBy(*by)
    return lead.agg(F.when(F.count("*") == 1, F.min(value)).otherwise(F.lit(default)).alias(value))


def evidence_vote(df: DataFrame, by: Sequence[str], yes: Column, no: Column, names: tuple[str, str], least: int = 5, ratio: float = 3.0) -> DataFrame:
    """A side wins with at least `least` hits and `ratio` times the other's; else null."""
    y, n = F.count_if(yes), F.count_if(no)
    win = F.when((y >= least) & (y >= ratio * n), names[0]).when((n >= least) & (n >= ratio * y), names[1])
    return df.groupBy(*by).agg(y.alias("yes"), n.alias("no"), win.alias("verdict"))


def layered(df: DataFrame, by: Sequence[str], locked: Column, value: str, evidence: Column) -> DataFrame:
    """Lock, else unanimous value, else evidence, else plurality, else 'unknown'."""
    plural = mode_vote(df, by, value, "unknown").withColumnRenamed(value, "__plural")
    facts = df.groupBy(*by).agg(F.max(locked).alias("__lock"), F.when(F.count_distinct(value) == 1, F.min(value)).alias("__one"), F.max(evidence).alias("__evidence"))
    out = F.coalesce("__lock", "__one", "__evidence", "__plural", F.lit("unknown"))
    return facts.join(plural, list(by), "left").select(*by, out.alias(value))


def mcnemar(df: DataFrame, a_right: Column, b_right: Column) -> DataFrame:
    """Discordant counts of two paired judges and the exact two-sided binomial tail."""
    n = df.agg(F.count_if(a_right & ~b_right).alias("only_a"), F.count_if(~a_right & b_right).alias("only_b"))
    m, least = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    # log binomial terms by a running sum: log C(m, k + 1) = log C(m, k) + log((m - k) / (k + 1))
    step = F.aggregate(
        F.sequence(F.lit(0).cast("long"), least),
        F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum")),
        lambda s, k: F.struct((s["log"] + F.when(k < m, F.log((m - k) / (k + 1.0))).otherwise(0.0)).alias("log"), (s["sum"] + F.exp(s["log"] - m * F.log(F.lit(2.0)))).alias("sum")),
        lambda s: s["sum"],
    )
    return n.select("only_a", "only_b", F.when(m == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * step)).alias("p"))


def bcubed(df: DataFrame, item: str, predicted: str, gold: str) -> DataFrame:
    """B-cubed precision, recall and F1 of a clustering; rows without a gold class are left out."""
    known = df.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull())
    cells = known.groupBy(predicted, gold).agg(F.count(item).alias("both"))
    p = cells.groupBy(predicted).agg(F.sum("both").alias("in_p"))
    g = cells.groupBy(gold).agg(F.sum("both").alias("in_g"))
    each = cells.join(p, predicted).join(g, gold)
    out = each.agg((F.sum(F.col("both") * F.col("both") / F.col("in_p")) / F.sum("both")).alias("precision"), (F.sum(F.col("both") * F.col("both") / F.col("in_g")) / F.sum("both")).alias("recall"))
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))


def _named(column: str):
    return lambda x: x["name"] == F.col(column)


def partial_credit(gold: DataFrame, guess: DataFrame, keys: Sequence[str], weights: dict[str, float]) -> DataFrame:
    """Weighted share of credit; `gold` holds for each axis an array of (name, credit), `guess`
    a value. An axis without gold answers is left out of both sums."""
    both = gold.join(guess.select(*keys, *[F.col(a).alias(f"__{a}") for a in weights]), list(keys))
    got, full = F.lit(0.0), F.lit(0.0)
    for axis, weight in weights.items():
        asked = F.size(axis) > 0
        right = F.filter(axis, _named(f"__{axis}"))
        credit = F.coalesce(F.array_max(F.transform(right, lambda x: x["credit"].cast("double"))), F.lit(0.0))
        got = got + F.when(asked, weight * credit).otherwise(0.0)
        full = full + F.when(asked, weight).otherwise(0.0)
    return both.select(*keys, F.when(full > 0, 100 * got / full).alias("score"))


def ensemble(probs: DataFrame, keys: Sequence[str], models: int) -> DataFrame:
    """Label of the highest mean probability over rows (keys, label, p), a label a model does not
    name counting as 0 there; ties to the smaller label. A null label is the null class."""
    mean = probs.groupBy(*keys, "label").agg((F.sum("p") / models).alias("p"))
    return mean.groupBy(*keys).agg(F.min_by(F.struct("label", "p"), F.struct((-F.col("p")).alias("p"), "label")).alias("x")).select(*keys, "x.label", "x.p")


def review_curve(df: DataFrame, doubt: str, wrong: Column, tie: str, cuts: Sequence[int]) -> DataFrame:
    """Share of right rows once the top p % by doubt (ties by `tie`) have been put right, for each p
    of `cuts`. `doubt` and `tie` are numbers."""
    rows = global_rank(df.select(doubt, tie, F.coalesce(wrong, F.lit(False)).cast("int").alias("bad")), doubt, tie, "r", descending=True)
    n = df.count()
    left = [F.sum(F.when(F.col("r") > n * c // 100, F.col("bad")).otherwise(0)).alias(str(c)) for c in cuts]
    parts = F.array(*[F.struct(F.lit(c).alias("cut"), (1 - F.col(str(c)) / n).alias("accuracy")) for c in cuts])
    return rows.agg(*left).select(F.explode(parts).alias("x")).select("x.cut", "x.accuracy").where(F.lit(n > 0))


def origins(names: DataFrame, by: str, times: str, least: int, few: int = 4, ja_share: float = 0.7, honorific: tuple[int, int, float] = (5, 2, 0.5), ko_share: float = 0.3, ko_only_share: float = 0.15) -> DataFrame:
    """Shares of a book's names by what languages can read them, and the origin they show. Rows
    (by, times, ja, ko, suffixed) are names; `suffixed` ones stand with an honorific somewhere. The
    origin is null under `least` occurrences or where no share is clear."""
    n = F.col(times)
    part = lambda c: F.sum(F.when(c, n).otherwise(0))
    ja, ko, hon = F.coalesce(F.col("ja"), F.lit(False)), F.coalesce(F.col("ko"), F.lit(False)), F.coalesce(F.col("suffixed"), F.lit(False))
    total = F.sum(n)
    sums = names.groupBy(by).agg(
        total.alias("total"), (part(ja) / total).alias("ja"), (part(ko) / total).alias("ko"), (part(ko & ~ja) / total).alias("ko_only"),
        F.count_if(ja).alias("ja_names"), F.count_if(ko).alias("ko_names"), part(ja & hon).alias("hon"), F.count_if(ja & hon).alias("hon_names"),
    )
    c = F.col
    clear = (c("ja") >= ja_share) | ((c("hon") >= honorific[0]) & (c("hon_names") >= honorific[1]) & (c("ja") >= honorific[2]))
    korean = (c("ko_names") >= few) & (c("ko") >= ko_share) & (c("ko_only") >= ko_only_share)
    origin = F.when(c("total") < least, None).when((c("ja_names") >= few) & clear, "ja").when(korean, "ko")
    return sums.withColumn("origin", origin)


def keep_top_share(df: DataFrame, by: Sequence[str], score: Column, order: Sequence[str], share: float) -> DataFrame:
    """The floor(n * share) best rows of each class."""
    w = Window.partitionBy(*by).orderBy(score.desc(), *order)
    out = df.withColumn("__r", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    return out.where(F.col("__r") <= F.floor(F.col("__n") * share)).drop("__r", "__n")


def leave_one_out_threshold(df: DataFrame, fold: str, score: Column, right: Column, grid: Sequence[float]) -> DataFrame:
    """For each fold the threshold that is right most often on the other folds, ties to the lower."""
    hits = df.select(fold, F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("threshold"), score.alias("s"), right.alias("y"))
    own = hits.groupBy(fold, "threshold").agg(F.count_if((F.col("s") >= F.col("threshold")) == F.col("y")).alias("n"))
    total = own.groupBy("threshold").agg(F.sum("n").alias("all"))
    rest = own.join(total, "threshold").withColumn("rest", F.col("all") - F.col("n"))
    return rest.groupBy(fold).agg(F.max_by(F.struct("threshold", "rest"), F.struct("rest", (-F.col("threshold")).alias("t"))).alias("x")).select(fold, "x.threshold", F.col("x.rest").alias("right_elsewhere"))


def split_without_straddling(df: DataFrame, group: str, split: Column, content: str) -> DataFrame:
    """Rows with their group's split, without rows whose content stands in more than one split."""
    own = df.withColumn("split", split)
    astride = own.groupBy(content).agg(F.min("split").alias("__a"), F.max("split").alias("__b")).where("__a <> __b").select(content)
    return own.join(astride, content, "left_anti")
