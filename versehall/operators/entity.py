"""Names to identities: merges of spellings by rules, each a join over the pass before.

Every pass reads (name, lines) and gives (name, target) for the names it redirects. Nothing is
closed transitively: passes are applied in order by `resolve`, a single one by `redirect`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versehall.functions.text import accents, fold_all, identity_key
from versehall.staging import stage


def by_identity(names: DataFrame) -> DataFrame:
    """Names of one identity key to the most frequent spelling, ties to the smaller without and then with case."""
    keyed = names.withColumn("k", identity_key(F.col("name")))
    best = keyed.groupBy("k").agg(F.min_by("name", F.struct((-F.col("lines")).alias("n"), F.lower("name").alias("low"), "name")).alias("target"))
    return keyed.join(best, "k").where("name <> target").select("name", "target")


def dropped_marks(names: DataFrame) -> DataFrame:
    """A name to one with the same letters that bears all of its marks in their places and more: of
    those the one with most marks, then lines, then the greater name. "Má" is no "Mà" without its mark.

    A self-join on the bare letters; a group holds the spellings of one name."""
    n = names.select("name", "lines", fold_all(F.col("name")).alias("base"), accents(F.col("name")).alias("marks"))
    fuller = n.select("base", F.col("name").alias("of"), F.col("lines").alias("m"), F.col("marks").alias("whole"))
    hit = n.join(fuller, "base").where("size(marks) < size(whole) AND size(array_except(marks, whole)) = 0")
    return hit.groupBy("name").agg(F.max_by("of", F.struct(F.size("whole"), "m", "of")).alias("target"))


def stray_surnames(names: DataFrame, most: int = 3, times: int = 10) -> DataFrame:
    """A long name of few lines to a name that is a word prefix of it with `times` as many."""
    words = F.split("name", " ")
    long_ = names.where((F.size(words) >= 2) & (F.col("lines") <= most)).withColumn("n", F.explode(F.sequence(F.lit(1), F.size(words) - 1)))
    long_ = long_.select("name", "lines", F.array_join(F.slice(F.split("name", " "), 1, F.col("n")), " ").alias("prefix"))
    short = names.select(F.col("name").alias("prefix"), F.col("lines").alias("m"), F.size(words).alias("w"))
    hit = long_.join(short, "prefix").where(F.col("m") >= times * F.greatest(F.lit(1), F.col("lines")))
    return hit.groupBy("name").agg(F.min(F.struct("w", (-F.col("m")).alias("m"), "prefix")).alias("b")).select("name", F.col("b.prefix").alias("target"))


def given_to_full(names: DataFrame, prefixes: Sequence[str] = (), suffixes: Sequence[str] = ()) -> DataFrame:
    """A single-word name to the only longer name that ends in it. A name without marks is compared
    without them, one with marks exactly. Names that begin with a word of address (`prefixes`) are no
    targets, a title that stands behind names (`suffixes`) is no name."""
    low = F.lower("name")
    words = F.split(low, " ")
    full = names.where((F.size(words) > 1) & ~words[0].isin(*prefixes, "")).select(F.col("name").alias("full"), F.element_at(words, -1).alias("last"))
    one = names.where((F.size(words) == 1) & ~low.isin(*suffixes, "")).select("name", low.alias("last"))

    def owners(rows: DataFrame) -> DataFrame:
        return rows.groupBy("last").agg(F.count_distinct("full").alias("n"), F.min("full").alias("target"))

    exact = one.join(owners(full), "last", "left")
    plain = F.when(fold_all(F.col("last")) == F.col("last"), F.col("last"))
    bare = owners(full.withColumn("last", fold_all(F.col("last")))).select(F.col("last").alias("b"), F.col("n").alias("bn"), F.col("target").alias("bt"))
    both = exact.join(bare, plain == F.col("b"), "left")
    target = F.when(F.col("n").isNotNull(), F.when(F.col("n") == 1, F.col("target"))).when(F.col("bn") == 1, F.col("bt"))
    return both.select("name", target.alias("target")).where("target IS NOT NULL")


def part_of_written(names: DataFrame, written: DataFrame) -> DataFrame:
    """A single-word name to the only full name of the text (`written`: name) that holds it as its
    first or last word; to that name as `names` spells it, if they do."""
    low = F.lower("name")
    words = F.split(low, " ")
    parts = written.where(F.size(words) > 1).select(F.col("name").alias("full"), F.explode(F.array_distinct(F.array(words[0], F.element_at(words, -1)))).alias("w"))
    owner = parts.groupBy("w").agg(F.count_distinct("full").alias("n"), F.min("full").alias("full")).where("n = 1")
    hit = names.where(F.size(words) == 1).select("name", low.alias("w")).join(owner, "w")
    own = names.select(F.col("name").alias("spelt"), identity_key(F.col("name")).alias("k"))
    return hit.withColumn("k", identity_key(F.col("full"))).join(own, "k", "left").select("name", F.coalesce("spelt", "full").alias("target"))


def resolve(names: DataFrame, passes: Sequence[Callable[[DataFrame], DataFrame]], confirmed: DataFrame | None = None) -> DataFrame:
    """(name, canonical) after ordered passes. A pass reads the names that stand when it begins,
    with their own lines, and gives (name, target); names redirected before follow along. Nothing is
    closed transitively within a pass. A confirmed alias (name, target) wins at the end."""
    state = names.select("name", F.col("name").alias("canonical"))
    lines = names.select(F.col("name").alias("canonical"), "lines")
    for one in passes:
        standing = state.select("canonical").distinct().join(lines, "canonical", "left").select(F.col("canonical").alias("name"), F.coalesce("lines", F.lit(0)).alias("lines"))
        moved = one(standing).select(F.col("name").alias("canonical"), "target")
        state = stage(state.join(moved, "canonical", "left").select("name", F.coalesce("target", "canonical").alias("canonical")), "names")
    if confirmed is not None:
        state = state.join(confirmed.select("name", "target"), "name", "left").select("name", F.coalesce("target", "canonical").alias("canonical"))
    return state


def redirect(names: DataFrame, targets: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """(name, canonical): a confirmed alias wins over the rule's target, else the name stays."""
    out = names.select("name").join(targets, "name", "left")
    if confirmed is not None:
        out = out.join(confirmed.select("name", F.col("target").alias("__c")), "name", "left").withColumn("target", F.coalesce("__c", "target"))
    return out.select("name", F.coalesce("target", "name").alias("canonical"))


def fuzzy_unique(left: DataFrame, right: DataFrame, on: str, edits: int = 1) -> DataFrame:
    """Names of `left` to the only name of `right` at exactly `edits` edits (ASCII).

    Candidates come from an equi-join on deletion neighbourhoods: two strings within d edits share a
    string made by at most d deletions of each."""

    def cut(df: DataFrame, name: str) -> DataFrame:
        out = df.select(F.col(on).alias(name)).distinct().withColumn("__v", F.array(name))
        for _ in range(edits):
            one = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
            out = out.withColumn("__v", F.array_distinct(F.concat("__v", F.flatten(F.transform("__v", one)))))
        return out.select(name, F.explode("__v").alias("__k"))

    pairs = cut(left, "name").join(cut(right, "target"), "__k").select("name", "target").distinct()
    hits = pairs.where(F.levenshtein("name", "target") == edits)
    return hits.groupBy("name").agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n = 1").select("name", "target")


def carry_over(claims: DataFrame, voice: str, holder: str, rank: Sequence[Column]) -> DataFrame:
    """The best-ranked holder of each voice; where two are equal best, none."""
    best = claims.withColumn("__r", F.struct(*rank))
    top = best.groupBy(voice).agg(F.max("__r").alias("__top"))
    lead = best.join(top, voice).where("__r = __top").groupBy(voice)
    return lead.agg(F.count("*").alias("n"), F.min(holder).alias(holder)).where("n = 1").select(voice, holder)


def violations(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that bear more than one value."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1")


def to_source_spelling(names: DataFrame, words: DataFrame, least: int = 3) -> DataFrame:
    """Names that the source never writes to the only written form at one edit, else at two
    for names of five letters or more. `words` holds (name, hits) of forms met mid-sentence; forms
    under `least` hits are no targets. Compared folded, so accents cost nothing."""
    folded = lambda df: df.withColumn("f", fold_all(F.col("name")))
    absent = folded(names.select("name").join(words.select("name"), "name", "left_anti"))
    known = folded(words.where(F.col("hits") >= least))
    out = None
    for edits in (0, 1, 2):
        left = absent if edits < 2 else absent.where(F.length("f") >= 5)
        if edits:
            near = fuzzy_unique(left.select(F.col("f").alias("name")), known.select(F.col("f").alias("name")), "name", edits).select(F.col("name").alias("f"), F.col("target").alias("g"))
        else:
            near = left.select("f").distinct().withColumn("g", F.col("f"))
        forms = known.groupBy(F.col("f").alias("g")).agg(F.count_distinct("name").alias("n"), F.min("name").alias("target")).where("n = 1")
        found = left.join(near, "f").join(forms, "g").select("name", "target", F.lit(edits).alias("edits"))
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("name").agg(F.min_by("target", F.struct("edits", "target")).alias("target"))
    return best.where("name <> target")
