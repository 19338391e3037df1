"""Texts as ordered lines of pages and books: running heads, series of volumes, contained passages.

Defined cases: null texts have no lines and hold no passage; blank lines are never heads; repeated
rows are pages of their own only if their key differs.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versehall.functions.passages import series_of
from versehall.functions.text import is_heading

# Which lines of a page can be running heads, and how many pages must bear them.
ZONE, LEAST_PAGES, SHARE = 2, 3, 0.4
PAGE_NUMBER = r"(?i)^[\s·|–—-]*(?:trang|page|tr\.?|p\.?)?\s*[0-9]{1,5}(?:\s*(?:/|of|trên)\s*[0-9]{1,5})?[\s·|–—-]*$"
DICTIONARY_BYTES = 16 << 20  # passages up to this size are sent to every task


def drop_running_lines(pages: DataFrame, book: str, page: str, text: str) -> DataFrame:
    """(book, page, text, dropped) without running heads and page numbers.

    The first and last ZONE filled lines of a page count by their text with digits masked; those on at
    least LEAST_PAGES pages and SHARE of the book's go from every page, and so does a page number on the
    outermost line. Headings of chapters always stay."""
    lines = pages.select(book, page, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    filled = F.trim("line") != ""
    own = Window.partitionBy(book, page)
    rank = F.sum(filled.cast("int")).over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("r", F.when(filled, rank)).withColumn("n", F.sum(filled.cast("int")).over(own))
    zone = filled & ((F.col("r") <= ZONE) | (F.col("r") > F.col("n") - ZONE)) & ~is_heading(F.col("line"))
    key = F.when(zone, F.regexp_replace(F.lower(F.trim("line")), "[0-9]+", "#"))
    lines = lines.withColumn("key", key).withColumn("edge", F.col("key").isNotNull() & ((F.col("r") == 1) | (F.col("r") == F.col("n"))))
    every = pages.groupBy(book).agg(F.count_distinct(page).alias("pages"))
    seen = lines.where("key IS NOT NULL").groupBy(book, "key").agg(F.count_distinct(page).alias("seen"))
    heads = seen.join(every, book).where((F.col("seen") >= LEAST_PAGES) & (F.col("pages") >= LEAST_PAGES) & (F.col("seen") >= SHARE * F.col("pages"))).select(book, "key", F.lit(True).alias("head"))
    lines = lines.join(heads, [book, "key"], "left")
    drop = F.coalesce("head", F.lit(False)) | (F.col("edge") & F.col("line").rlike(PAGE_NUMBER))
    kept = F.sort_array(F.collect_list(F.when(~drop, F.struct("pos", "line"))))
    return lines.groupBy(book, page).agg(F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias(text), F.count_if(drop).alias("dropped"))


def series_index(books: DataFrame, key: str, title: str, root: str, part: str) -> DataFrame:
    """(key, series_key, series, volume, unit) of every book. A book that goes on another one
    (`root`, `part`) belongs to that one's chain, and so does the root itself as its first part. The
    others go by their titles; one without a number whose title is a numbered series is its volume 1."""
    b = books.select(F.col(key).alias("k"), series_of(F.col(title)).alias("t"), F.col(root).alias("root"), F.col(part).alias("part"))
    roots = b.where("root IS NOT NULL").select(F.col("root").alias("k")).distinct().withColumn("is_root", F.lit(True))
    first = b.select(F.col("k").alias("root"), F.col("t.series").alias("of"))
    b = b.join(roots, "k", "left").join(first, "root", "left")
    chained = F.col("root").isNotNull() | F.col("is_root")
    b = b.withColumn("series_key", F.when(chained, F.concat(F.lit("chain:"), F.coalesce("root", "k").cast("string"))).otherwise(F.concat(F.lit("title:"), F.col("t.series"))))
    numbered = b.where("root IS NULL AND is_root IS NULL AND t.volume IS NOT NULL").groupBy("series_key").agg(F.min_by("t.unit", "k").alias("u"))
    b = b.join(numbered, "series_key", "left")
    lone = F.col("t.volume").isNull() & F.col("u").isNotNull()
    return b.select(
        F.col("k").alias(key), "series_key", F.when(F.col("root").isNotNull(), F.coalesce("of", "t.series")).otherwise(F.col("t.series")).alias("series"),
        F.when(F.col("root").isNotNull(), F.col("part")).when(F.col("is_root") | lone, 1).otherwise(F.col("t.volume")).cast("int").alias("volume"),
        F.when(chained, F.lit("phần")).when(lone, F.col("u")).otherwise(F.col("t.unit")).alias("unit"),
    )


def containment(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, passage: str, most_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """(key, item, mentions) of passages that stand in texts, wherever they begin and end; mentions
    counts those that do not overlap, from the left. Empty passages stand nowhere; a row a row of each
    side.

    A dictionary of at most `most_bytes` goes to every task, which reads each text once with one
    automaton for all passages. A larger one is joined: an equi-join of hashes of up to eight inner words
    (the outer ones can be parts of words), or up to eight characters where there is none; then the
    texts of the hits are tested."""
    items = items.select(item, F.col(passage).alias("__p")).where("__p <> ''")
    size = items.agg(F.coalesce(F.sum(F.octet_length("__p") + 16), F.lit(0))).first()[0]
    find = _by_automaton if size <= most_bytes else _by_words
    return find(docs.select(key, text).where(F.col(text).isNotNull()), items, key, text, item)


def _by_automaton(docs: DataFrame, items: DataFrame, key: str, text: str, item: str) -> DataFrame:
    rows = items.collect()  # at most DICTIONARY_BYTES of passages
    named: dict[str, list] = {}
    for r in rows:
        named.setdefault(r["__p"], []).append(r[item])
    shared = docs.sparkSession.sparkContext.broadcast(named)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = ahocorasick.Automaton()
        for p in shared.value:
            tree.add_word(p, p)
        if len(tree):
            tree.make_automaton()
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch[text]):
                count: dict[str, list[int]] = {}
                for end, p in tree.iter(t) if len(tree) else ():
                    at = count.setdefault(p, [0, -1])
                    if end - len(p) >= at[1]:
                        count[p] = [at[0] + 1, end]
                out += [(k, i, n) for p, (n, _) in count.items() for i in shared.value[p]]
            yield pd.DataFrame(out, columns=[key, item, "mentions"])

    kinds = dict(docs.dtypes) | dict(items.dtypes)
    return docs.mapInPandas(run, f"{key} {kinds[key]}, {item} {kinds[item]}, mentions long")


def _by_words(docs: DataFrame, items: DataFrame, key: str, text: str, item: str) -> DataFrame:
    most = F.lit(8)
    words, chars = lambda c: F.split(c, r"\s+"), lambda c: F.split(c, "")
    inner = F.size(words("__p")) - 2
    cut = items.withColumn("by_word", inner > 0).withColumn("size", F.least(most, F.when(inner > 0, inner).otherwise(F.length("__p"))))
    first = F.when(F.col("by_word"), F.array_join(F.slice(words("__p"), F.lit(2), F.col("size")), " ")).otherwise(F.substring("__p", F.lit(1), F.col("size")))
    cut = cut.withColumn("g", F.xxhash64(first))
    sizes = F.broadcast(cut.select("by_word", "size").distinct())  # sixteen rows at most
    # the digest stands for the text: only hashes are dealt out
    own = docs.withColumn("__t", F.md5(text))

    def grams(parts: Column, joiner: str) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - F.col("size") + 1))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(parts, i, F.col("size")), joiner))))

    rows = own.join(sizes).withColumn("parts", F.when(F.col("by_word"), words(text)).otherwise(chars(text)))
    rows = rows.select("__t", "by_word", "size", F.explode(F.when(F.col("by_word"), grams(F.col("parts"), " ")).otherwise(grams(F.col("parts"), ""))).alias("g"))
    hits = rows.join(cut, ["by_word", "size", "g"]).select("__t", item, "__p")
    hits = hits.distinct()  # one for a text that several rows share
    given = items.groupBy(item, "__p").agg(F.count("*").alias("times"))
    found = own.join(hits, "__t").where(F.col(text).contains(F.col("__p")))
    mentions = ((F.length(text) - F.length(F.replace(F.col(text), F.col("__p"), F.lit("")))) / F.length("__p")).cast("long")
    found = found.join(given, [item, "__p"]).withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return found.select(key, item, mentions.alias("mentions"))
