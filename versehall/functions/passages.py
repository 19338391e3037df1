"""Lines, titles and mentions of texts, and how far what was heard agrees with what was written.

Defined cases: null texts give null (false for the checks); an empty text has no words and no lines.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from versehall.functions.text import fold_all, similarity

# Thresholds of the checks, ends of sentences, names of volumes.
SEVERE_SIMILARITY, SEVERE_RATIO, SEVERE_WORDS = 0.35, 3.0, 4
WORDS_A_SECOND, WORD_MARGIN, LEAST_WORDS = 5.0, 2, 4
WER_MARGIN = 0.12
SENTENCE_END = '.!?…”"»’)。'
SOFT_HYPHEN = "­"
VOLUME_WORDS = ["Tập", "Quyển", "Phần", "Vol.", "Vol", "Book"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def edits(a: Sequence, b: Sequence) -> int:
    """Fewest parts put in, left out or changed between two sequences. A column of the table is the bits of
    two numbers (Myers 1999, Hyyrö 2003), so a step takes all of `a` at once."""
    if not a or not b:
        return max(len(a), len(b))
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, out = every, 0, len(a)
    for y in b:
        same = at.get(y, 0)
        flat = (((same & up) + up) ^ up) | same
        more, less = down | every & ~(flat | up), up & flat
        out += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & every, less << 1 & every
        same |= down
        up, down = less | every & ~(same | more), more & same
    return out


def _letter_edits(a: str | None, b: str | None) -> int | None:
    return None if a is None or b is None else edits(a, b)


def _word_edits(a: str | None, b: str | None) -> int | None:
    return None if a is None or b is None else edits(_WORD.findall(a), _WORD.findall(b))


_WORD = re.compile(r"\S+", re.A)


def token_distance(a: Column, b: Column) -> Column:
    """edits of whole words between two texts."""
    return F.udf(_word_edits, "int", useArrow=True)(a, b)


def likeness(a: Column, b: Column) -> Column:
    """as `text.similarity`, for texts of a thousand characters and more."""
    return F.greatest(F.lit(0.0), 1 - F.udf(_letter_edits, "int", useArrow=True)(a, b) / F.greatest(F.lit(1), F.length(a)))


def word_error_rate(expected: Column, heard: Column) -> Column:
    """edits of words by the words expected."""
    return token_distance(expected, heard) / F.greatest(F.lit(1), n_words(expected))


def best_of_two(expected: Column, heard: Column) -> Column:
    """(similarity, wer): each the better one of the texts as they are and folded."""
    plain, folded = (expected, heard), (fold_all(expected), fold_all(heard))
    return F.struct(
        F.greatest(similarity(*plain), similarity(*folded)).alias("similarity"), F.least(word_error_rate(*plain), word_error_rate(*folded)).alias("wer"),
    )


def severe_mismatch(expected: Column, heard: Column, alike: Column) -> Column:
    """whether what was heard is another text: nothing at all, or hardly alike and either far
    longer or of about the same length. False where nothing was expected."""
    n, m = n_words(expected), n_words(heard)
    longer = m >= F.greatest(n + SEVERE_WORDS, F.ceil(n * SEVERE_RATIO))
    return F.when(n == 0, False).when(m == 0, True).otherwise((alike < SEVERE_SIMILARITY) & (longer | (F.abs(m - n) <= SEVERE_WORDS)))


def beyond_rate(heard: Column, seconds: Column) -> Column:
    """whether more words were heard than can be said in that time."""
    m = n_words(heard)
    return (m > 0) & (seconds > 0) & (m > F.greatest(F.lit(LEAST_WORDS), F.ceil(seconds * WORDS_A_SECOND) + WORD_MARGIN))


def beyond_timeline(ends: Column, seconds: Column) -> Column:
    """whether a heard piece ends well after the sound does (over a second and twice its length)."""
    return (seconds > 0) & F.coalesce(F.exists(ends, lambda e: e > F.greatest(seconds + 1, seconds * 2)), F.lit(False))


def accepted(present: Column, alike: Column, wer: Column, least: float, most: float) -> Column:
    """alike enough, and few wrong words unless it is well above the least likeness."""
    return present & (alike >= least) & ((wer <= most) | (alike >= least + WER_MARGIN))


def join_wrapped(text: Column) -> Column:
    """lines that were broken inside a sentence joined again: a line in a small letter goes on the
    one before unless that ends a sentence or clause. A soft hyphen at the break goes, any other break
    becomes a space."""
    stops = "".join("\\" + c for c in SENTENCE_END + ":;")
    soft = F.regexp_replace(text, rf"{SOFT_HYPHEN}[ \t]*\n[ \t]*(?=\p{{Ll}})", "")
    return F.regexp_replace(soft, rf"(?<=[^{stops}\s])[ \t]*\n[ \t]*(?=\p{{Ll}})", " ")


def series_of(title: Column) -> Column:
    """(series, volume, unit) of a title such as "Name · Vol. 3"; volume null without one."""
    words = "|".join(w.replace(".", r"\.") for w in VOLUME_WORDS)
    form = rf"(?iu)^(.*?)\s*[·|:—–-]\s*({words})\s*([0-9]{{1,9}})\b"
    got = lambda i: F.regexp_extract(title, form, i)
    found = title.rlike(form)
    return F.struct(
        F.when(found, F.trim(got(1))).otherwise(F.trim(title)).alias("series"),
        F.when(found, got(3).try_cast("int")).alias("volume"),
        F.when(found & F.lower(got(2)).isin("quyển", "phần"), F.lower(got(2))).otherwise(F.lit("tập")).alias("unit"),
    )


def mention_spans(text: Column, aliases: Column, case: bool = False) -> Column:
    """where a text names one of `aliases` as whole words, the longest first: array of (start, end,
    alias), counted in characters from 0. The aliases of a text are few enough for one pattern."""
    quoted = F.transform(F.array_sort(aliases, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)), _literal)
    pattern = F.concat(F.lit(r"(?su)(?<![\p{L}\p{N}_])(?:" if case else r"(?isu)(?<![\p{L}\p{N}_])(?:"), F.array_join(quoted, "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    # the text between mentions gives their places
    between = F.split(text, pattern)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,alias:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + F.length(x["gap"])
        b = a + F.length(x["hit"])
        return F.struct(b.alias("at"), F.concat(s["out"], F.array(F.struct(a.alias("start"), b.alias("end"), x["hit"].alias("alias")))).alias("out"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    spans = F.aggregate(pairs, start, step, lambda s: s["out"])
    return F.when(F.size(aliases) > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int,alias:string>>"))


def _literal(x: Column) -> Column:
    return F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
