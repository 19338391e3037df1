"""Texts made ready for a voice: symbols as words and pauses, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols with a meaning, symbols that part, symbols without a sound, marks of a censored word,
# and the cues in brackets that stay as they are.
SPOKEN = {"↓": "giảm", "↑": "tăng", "+": "cộng", "=": "bằng", "≥": "lớn hơn hoặc bằng", "≤": "nhỏ hơn hoặc bằng", "^": "mũ", "×": "nhân", "÷": "chia"}
PARTING = "»«›‹→⇒▸▶►([{)]}|"
SILENT = "•▪◦*"
CENSOR = "#&@$%*!?"
SOUNDS = {"cười": "Ha ha...", "chuckle": "Ha ha...", "thở dài": "Hầy...", "sigh": "Hầy...", "hắng giọng": "Khụ khụ...", "clear throat": "Khụ khụ..."}
PAIN = "a+r*g+h*|u+r*g+h*|g+r+h*"
LAUGHS, VOWELS = ["ha", "he", "hi", "hu"], "aeiouyưăâêôơ"
MOST_LAUGHS, MOST_SAID = 8, 4  # syllables of a laugh on the page, and as it is said
CUES = ["cười", "chuckle", "thở dài", "sigh", "hắng giọng", "clear throat"]


def _class(characters: str, more: str = "") -> str:
    return "[" + "".join("\\" + c for c in characters) + more + "]"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once, however often it stands there."""
    return F.transform(F.array(value), then)[0]


def spoken_symbols(text: Column) -> Column:
    """`text` with its symbols as words or pauses: symbols of a meaning become words, those that part
    become commas, a censored word a pause. Cues in brackets stay; a slash between letters is a comma,
    between digits it stays. Parting symbols at both ends go without a trace, so that a piece of the
    result is its own result."""
    run, ends = _class(CENSOR) + "{3,}", _class(PARTING + SILENT, r" \t\r\n")
    text = F.replace(text, F.lit("=>"), F.lit("→"))
    hidden = rf"(?=(?:{_class(CENSOR)}*[#&@$]|(?:{_class(CENSOR)}*?\*){{3}})){run}"
    cue = r"(?iu)\[(?:" + "|".join(c.replace(" ", r"\s+") for c in CUES) + r")\]"

    def said(part: Column, i: Column, cues: Column) -> Column:
        part = F.when(i == 0, F.regexp_replace(part, f"^{ends}+", "")).otherwise(part)
        part = F.when(i == F.size(cues), F.regexp_replace(part, f"{ends}+$", "")).otherwise(part)
        part = reduce(lambda s, kv: F.replace(s, F.lit(kv[0]), F.lit(f" {kv[1]} ")), SPOKEN.items(), part)
        part = F.regexp_replace(F.regexp_replace(part, _class(PARTING), ", "), _class(SILENT), "")
        return F.concat(part, F.coalesce(F.get(cues, i), F.lit("")))

    def whole(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(cue), F.lit(0))
        return _let(found, lambda cues: F.array_join(F.transform(F.split(text, cue), lambda part, i: said(part, i, cues)), ""))

    out = _let(text, lambda t: _let(F.when(t.rlike(r"\p{L}"), F.regexp_replace(t, hidden, "…")).otherwise(t), whole))
    tidy = [(r"(?<=\p{L})\s*/\s*(?=\p{L})", ", "), (r"\s+([,.!?;:…])", "$1"), (r"(?:\s*,)+(?=\s*,)", ""), (r",(\s*[.!?…:;])", "$1"), (r"[ \t]{2,}", " ")]
    return F.trim(reduce(lambda s, p: F.regexp_replace(s, *p), tidy, out))


#: Vowels with a tone mark and without: every letter of VOWELS with each of the five tones.
_TONED = {unicodedata.normalize("NFC", v + t): v for v in VOWELS for t in "\u0300\u0301\u0303\u0309\u0323"}


def spoken_cries(text: Column) -> Column:
    """`text` with its cries and laughs as words that can be read aloud. A word is

    * a cry of pain (argh, ugh, grrh): Á; a sigh (haizz): Hầy; a hum (hmm): Hừm;
    * a laugh of two to eight equal syllables: the syllable up to four times, apart;
    * a vowel of three letters and more: "A... a"; behind a letter that is the same vowel with a tone mark
      this letter leads ("ÁAAA": "Á... a"), behind another one the word stays.

    Cues in brackets become sounds, a gasp alone ("Ha…") a laugh, runs of more than three points three.
    Each word is looked at once, so work and result are in proportion to the text."""
    return _let(text, _cries)


def _cries(text: Column) -> Column:
    gasp = r"(?iu)^(\s*[“\"'‘—–-]?\s*)ha(?:…|\.{2,})(\s*[”\"'’]?\s*)$"
    said = text
    for cue, sound in SOUNDS.items():
        said = F.regexp_replace(said, r"(?iu)\[" + cue.replace(" ", r"\s+") + r"\]", sound)
    low = lambda w: F.lower(w)
    laugh = "|".join(f"(?:{x}){{2,{MOST_LAUGHS}}}" for x in LAUGHS)
    vowel = "(?:" + "|".join(f"{v}{{3,}}" for v in VOWELS) + ")h*"
    base = lambda c: F.translate(low(c), "".join(_TONED), "".join(_TONED.values()))

    def word(w: Column) -> Column:
        l = low(w)
        first, second = F.substring(w, 1, 1), F.substring(l, 2, 1)
        times = F.least(F.lit(MOST_SAID), (F.length(w) / 2).cast("int"))
        ha = F.rtrim(F.repeat(F.concat(F.substring(l, 1, 2), F.lit(" ")), times))
        leads = l.rlike(f"^[À-ỹ]{vowel}$")
        led = F.when(base(first) == second, F.concat(first, F.lit("... "), second)).otherwise(w)
        return (
            F.when(l.rlike(f"^(?:{PAIN})$"), "Á").when(l.rlike("^ha+i+z+$"), "Hầy").when(l.rlike("^(?:hừ+m+|h+m+)$"), "Hừm")
            .when(l.rlike(f"^(?:{laugh})$"), F.concat(F.upper(F.substring(ha, 1, 1)), F.substring(ha, 2, 100)))
            .when(leads, led).when(l.rlike(f"^{vowel}$"), F.concat(F.upper(F.substring(l, 1, 1)), F.lit("... "), F.substring(l, 1, 1))).otherwise(w)
        )

    # words made of letters that these are made of, in any case; `word` decides, the text between stays
    inside = r"[\p{L}\p{M}\p{N}_]"
    maybe = rf"(?iu)(?<!{inside})(?:[aughr]{{2,}}|h[aeihmuzừ]+|\p{{L}}?([{VOWELS}])\1{{2,}}h*)(?!{inside})"

    def whole(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(maybe), F.lit(0))
        joined = lambda gap, w: F.concat(gap, F.coalesce(word(w), F.lit("")))
        return F.array_join(F.zip_with(F.split(text, maybe), found, joined), "")

    out = _let(said, whole)
    out = F.regexp_replace(out, r"\.{4,}", "...")
    return F.when(text.rlike(gasp), F.regexp_replace(text, gasp, "$1Ha ha.$2")).otherwise(out)
