"""Names that stand beside names."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versehall.functions import text as tx
from versehall.staging import stage

SPLIT = r"[\p{L}\p{M}\p{N}]+"
GAP = r"[^\p{L}\p{M}\p{N}]{2,}|[^\p{L}\p{M}\p{N} ]"


def name_forms(labels: DataFrame, label: str) -> DataFrame:
    """(label, folded, form): what a label may be written as: the whole, and of several words
    the first and the last one if they have three letters."""
    folded = F.array_join(F.regexp_extract_all(tx.fold_all(F.col(label)), F.lit(SPLIT), F.lit(0)), " ")
    rows = labels.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), folded.alias("folded")).where("folded <> ''").distinct()
    words = F.split("folded", " ")
    ends = F.filter(F.array(words[0], F.element_at(words, -1)), lambda x: F.length(x) >= 3)
    forms = F.array_distinct(F.concat(F.array("folded"), F.when(F.size(words) > 1, ends).otherwise(F.array().cast("array<string>"))))
    return rows.select("label", "folded", F.explode(forms).alias("form"))


def epithet_links(docs: DataFrame, text: str, labels: DataFrame, label: str, links: Sequence[str] = (), most: int = 500_000) -> DataFrame:
    """(epithet, name, n): how often the texts have a label whole with a form of another label right
    behind it, right before it, or before it with one of the `links` between ("called"). Neighbours
    are apart by one space: after a comma stands another person of a list. A name counts once a
    place. Labels of which one holds the other, or that share a word, are left out.

    Texts are read once: every word brings the few around it that two names and a link can take, meets
    the labels by their first word, and what may be a name beside the label found meets the index of forms
    (broadcast up to `most` forms, shuffled beyond). All forms beside a label are in its row, so a name that is there in
    several counts by the first of them, and only sums by label and name are shuffled."""
    forms = name_forms(labels, label)
    known = forms.groupBy("label", "folded").agg(F.sort_array(F.collect_set("form")).alias("forms"))
    known = stage(known.withColumn("id", F.monotonically_increasing_id()).withColumn("words", F.split("folded", " ")), "name-labels")
    more, n = known.agg(F.coalesce(F.max(F.size("words")) - 1, F.lit(0)), F.coalesce(F.sum(F.size("forms")), F.lit(0))).first()
    bounded = (lambda df: F.broadcast(df)) if n <= most else (lambda df: df)
    whole = known.select(F.col("id").alias("epithet"), "folded", "words", F.col("words")[0].alias("w"), F.expr("slice(words, 2, size(words))").alias("rest"))
    index = known.select(F.col("id").alias("name"), F.col("folded").alias("n_folded"), F.col("words").alias("n_words"), "forms", F.explode("forms").alias("form"))
    between = sorted({tuple(_folded_words(x)) for x in links} - {()})
    reach = more + 1 + max(map(len, between), default=0)

    # whatever is not one space between two words becomes a token of its own, so that neighbours are next tokens
    tokens = F.split(F.regexp_replace(tx.fold_all(F.col(text)), GAP, " | "), " ")
    rows = docs.where(F.col(text).isNotNull()).select(tokens.alias("t"))
    # word by word (null beyond the text): a slice within a lambda copies the whole text for each of its words
    around = lambda i, *places: F.array(*[F.get("t", i + k) for k in range(*places)])
    each = F.transform("t", lambda w, i: F.struct(w.alias("w"), around(i, 1, 2 * more + 2).alias("behind"), around(i, -reach, 0).alias("before")))
    rows = rows.select(F.explode(each).alias("x")).select("x.*").where("w <> '|' AND w <> ''")
    hits = rows.join(bounded(whole), "w").where(F.slice("behind", F.lit(1), F.size("rest")) == F.col("rest"))

    # nulls are left out of a span, which then is a shorter one
    last = lambda skip, k: F.slice("before", reach - skip - k + 1, k)
    spans = []
    for k in range(1, more + 2):
        spans += [F.array_join(F.slice("behind", F.size("rest") + 1, F.lit(k)), " "), F.array_join(last(0, k), " ")]
        spans += [F.when(last(0, len(words)) == F.array(*[F.lit(w) for w in words]), F.array_join(last(len(words), k), " ")) for words in between]
    hits = hits.select("epithet", "folded", "words", F.array_distinct(F.array(*spans)).alias("spans"))
    pairs = hits.select("*", F.explode("spans").alias("form")).where("form IS NOT NULL").join(bounded(index), "form")
    once = (F.size("forms") == 1) | (F.array_intersect("forms", "spans")[0] == F.col("form"))
    apart = ~F.col("folded").contains(F.col("n_folded")) & ~F.col("n_folded").contains(F.col("folded")) & ~F.arrays_overlap("words", "n_words")
    counts = pairs.where(once & apart).groupBy("epithet", "name").agg(F.count("*").alias("n"))
    named = lambda c: bounded(known.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")))
    counts = counts.join(named("epithet"), "epithet").join(named("name"), "name")
    return counts.select(F.col("epithet_label").alias("epithet"), F.col("name_label").alias("name"), "n")


def _folded_words(phrase: str) -> list[str]:
    """The words of a phrase, in small letters without marks."""
    plain = "".join(c for c in unicodedata.normalize("NFD", phrase.lower()) if unicodedata.category(c) != "Mn")
    return re.findall(r"\w+", plain.replace("đ", "d"))
