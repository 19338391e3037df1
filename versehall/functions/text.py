"""Text functions as column expressions: they stay in whole-stage code, without Python workers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed, replaced and folded, from which the translate lists are built.
ZERO_WIDTH = "​‌‍⁠﻿"
_ACCENTED = {
    "a": "àáảãạăằắẳẵặâầấẩẫậäåāą", "e": "èéẻẽẹêềếểễệëēęě", "i": "ìíỉĩịîïī", "o": "òóỏõọôồốổỗộơờớởỡợöøō",
    "u": "ùúủũụưừứửữựûüūů", "y": "ỳýỷỹỵÿ", "c": "çćč", "n": "ñńň", "s": "śšş", "z": "źżž",
}
FOLD_FROM = "".join(v for v in _ACCENTED.values())
FOLD_TO = "".join(k * len(v) for k, v in _ACCENTED.items())

#: The marks of each accented letter, from Unicode's own decompositions; đ bears a stroke.
_MARKS = {c: unicodedata.normalize("NFD", c)[1:] for c in FOLD_FROM if len(unicodedata.normalize("NFD", c)) > 1} | {"đ": "\u0335"}


def normalize(text: Column) -> Column:
    """line ends, no-break and zero-width characters, corner quotes, note marks, runs of spaces
    and of blank lines, ends trimmed."""
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = F.translate(out, " 「」" + ZERO_WIDTH, " “”")
    out = F.regexp_replace(out, r"\[note[0-9]+\]", "")
    out = F.regexp_replace(out, "[ \t]+", " ")
    out = F.regexp_replace(out, " ?\n ?", "\n")
    return F.trim(F.regexp_replace(out, "\n{3,}", "\n\n"))


def fold(text: Column) -> Column:
    """lower case without accents; đ is kept. Length is preserved."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def fold_all(text: Column) -> Column:
    """As fold, with đ as d."""
    return F.translate(fold(text), "đ", "d")


def accents(name: Column) -> Column:
    """the marks of a name as an array of "place:mark"."""
    known = F.create_map(*[F.lit(x) for kv in _MARKS.items() for x in kv])
    marks = F.transform(F.split(F.lower(name), ""), lambda c: F.split(F.coalesce(F.element_at(known, c), F.lit("")), ""))
    each = F.transform(marks, lambda ms, i: F.transform(F.filter(ms, lambda m: m != ""), lambda m: F.concat(i.cast("string"), F.lit(":"), m)))
    return F.flatten(each)


def dropped_marks_of(name: Column, of: Column) -> Column:
    """whether `name` is `of` with some of its marks left out and none put in or moved."""
    own, whole = accents(name), accents(of)
    return (fold_all(name) == fold_all(of)) & (F.size(own) < F.size(whole)) & (F.size(F.array_except(own, whole)) == 0)


def identity_key(name: Column) -> Column:
    """case, underscores and white space levelled."""
    return F.trim(F.regexp_replace(F.lower(name), r"[\s_]+", " "))


def slug(name: Column) -> Column:
    """folded, everything else to single hyphens."""
    return F.regexp_replace(F.regexp_replace(fold_all(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def stable_int(text: Column, low: int, high: int) -> Column:
    """a number of [low, high) from the first 64 bits of the SHA-256."""
    head = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (F.lit(low) + head % F.lit(high - low)).cast("long")


def stable_id(chapter: Column, seq: Column, text: Column) -> Column:
    return F.format_string("c%05d_s%07d_%s", chapter, seq, F.substring(F.sha2(text, 256), 1, 12))


def cache_key(*parts: Column) -> Column:
    """F37."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def content_key(prints: Column) -> Column:
    """One key for a map of names to digests, whatever its order."""
    pairs = F.transform(F.array_sort(F.map_entries(prints)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.sha2(F.array_join(pairs, "\n"), 256)


def natural_key(name: Column) -> Column:
    """SRC4: digits padded to twelve places, the rest lower-cased."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 12, "0")).otherwise(p)), "")


def is_heading(line: Column) -> Column:
    """chapter headings in several languages, or a roman numeral alone."""
    return line.rlike(r"(?i)^\s*(?:(?:chương|chuong|chapter|hồi|quyển|phần|part|volume)\s+[0-9ivxlcdm]+\b.*|第[0-9一二三四五六七八九十百千]+[章话話回].*|[ivxlcdm]{1,7}\.?)\s*$")


def volume_of(title: Column) -> Column:
    """the volume number in a title, 1 where there is none."""
    n = F.regexp_extract(F.lower(title), r"(?:\bvol(?:ume)?\.?|\btập|\bquyển|#)\s*([0-9]{1,9})", 1)
    return F.when(n == "", 1).otherwise(n.try_cast("int"))


def similarity(a: Column, b: Column) -> Column:
    """1 - edits / length of the reference, not below 0. Spark counts code points."""
    return F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / F.greatest(F.lit(1), F.length(a)))


def best_similarity(a: Column, b: Column) -> Column:
    """the better of two normalisations."""
    return F.greatest(similarity(a, b), similarity(fold_all(a), fold_all(b)))


def spread_ms(total_ms: Column, before: Column, weight: Column, all_weight: Column) -> Column:
    """(start, end) of a part in integer milliseconds by its share of the weight."""
    at = lambda w: F.floor(total_ms * w / F.greatest(F.lit(1), all_weight)).cast("long")
    return F.struct(at(before).alias("start"), at(before + weight).alias("end"))


def grid_cell(x: Column, y: Column, n: int = 5) -> Column:
    """M9: cell of [-1, 1] x [-1, 1], border values in the outer cells."""
    one = lambda v: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((v + 1) / 2 * n).cast("int")))
    return F.struct(one(x).alias("cx"), one(y).alias("cy"))


def cosine(a: Column, b: Column) -> Column:
    """M2: null if either is empty or zero."""
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def scaled_distance(axes: list[tuple[Column, Column, Column, Column, float]], tau: float = 0.2, lam: float = 0.5) -> Column:
    """M1: sqrt of the weighted sum over axes (target, its sd, value, its sd, weight) of
    (difference squared + lam * value variance) / (both variances + tau squared); an axis with a
    missing side is left out."""
    total = F.lit(0.0)
    for t, ts, v, vs, weight in axes:
        term = weight * ((t - v) * (t - v) + lam * vs * vs) / (ts * ts + vs * vs + tau * tau)
        total = total + F.coalesce(term, F.lit(0.0))
    return F.sqrt(total)
