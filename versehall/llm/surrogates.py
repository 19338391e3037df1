"""Personal data replaced by keyed surrogates of the same type and form.

Detection finds e-mail addresses, phone numbers, payment cards, national ids, IBANs, IP addresses,
secrets and titled or introduced personal names in whole texts. Every distinct entity (its
canonical form) gets one surrogate for the whole corpus, derived from a secret key: digits stay
digits, letters keep case and script, a card that passes the Luhn test still does, an address keeps
its top-level domain, a name keeps its gender and script. Names stand behind titles, also chains of
them ("Frau Prof. Dr."), or introductions, over any white space and over the line end of a wrapped line; their particles
("von der") stay, initials become other letters by a keyed order of the alphabet (distinct, but as there are only so many letters not
unlike all real ones). A given name behind a title without gender
or an introduction is the entity of the one gender its name has elsewhere, if there is one. Surrogates are then checked in Spark: one
that equals a real entity or another surrogate is drawn anew (the smallest entity keeps it), until
none is left, so distinct entities stay distinct and mentions of one entity stay together. Where the
real values fill the forms an entity can take, its surrogate grows.

The key comes from the caller: who has it can rebuild the mapping, so there is no default.
`session_key` reads it from the session (CONF) or draws one for the session.

An entity of every text and a text that many rows share are hot keys: what they are joined with is
staged, and the merge joins are split by adaptive execution.

Defined cases: null and empty texts pass unchanged; texts of any length are searched whole; rows
whose text can hold no entity are not shuffled; repeated rows get equal results; doc_id is not used
as a key, so nulls and repeats in it are fine; all columns of the input are carried along, whatever
their names (`count` replaces a column of its name); of entities that want one surrogate the smallest
gets it; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versehall.llm.common import in_arrow, stage, unused

CONF = "spark.versehall.surrogates.key"
MAX_ATTEMPTS = 64
GROW_AFTER = 8  # attempts of the same length

# Titles by gender, given names and family names by gender and script.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Г-н"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Doña", "Г-жа"],
    "n": ["Dr", "Prof", "Professor"],
}
ABBREVIATED = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Mme", "Mlle", "Sr", "Sra"]  # titles also in small letters, before a point
DIALLED = ["tel", "phone", "telephone", "mobile", "cell", "fax", "call", "Telefon", "Handy", "téléphone", "portable", "teléfono", "móvil"]
INTRODUCTIONS = ["my name is", "je m'appelle", "ich heiße", "ich heisse", "mein Name ist", "me llamo", "mi nombre es"]
DEGREES = ["med", "dent", "rer", "nat", "jur", "phil", "pol", "oec", "habil", "h.c", "Ing", "Dipl"]  # between titles, before a point
CHAINED = ["Don", "Doña", "Miss"]  # also given names: not titles behind another title
PARTICLES = ["von", "van", "vom", "zu", "zum", "zur", "de", "del", "della", "di", "da", "do", "dos", "das", "du", "ten", "ter", "af", "av", "bin", "ibn", "y"]
ARTICLES = ["la", "las", "los", "le", "el", "al", "der", "den", "dem", "het"]
GIVEN = {
    ("m", "latin"): ["Adrian", "Bruno", "Casper", "Dario", "Emil", "Felix", "Gustav", "Hugo", "Ivo", "Julian", "Konrad", "Leon"],
    ("f", "latin"): ["Alma", "Bianca", "Clara", "Delia", "Elena", "Flora", "Greta", "Helena", "Ines", "Julia", "Katja", "Lena"],
    ("n", "latin"): ["Alex", "Charlie", "Dominique", "Jo", "Kim", "Lee", "Robin", "Sam", "Sascha", "Toni"],
    ("m", "cyrillic"): ["Антон", "Борис", "Вадим", "Глеб", "Егор", "Иван", "Кирилл", "Лев"],
    ("f", "cyrillic"): ["Алла", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Лидия", "Майя"],
    ("n", "cyrillic"): ["Саша", "Женя", "Валя", "Слава"],
    ("n", "greek"): ["Άρης", "Δανάη", "Ηλίας", "Ιάσων", "Λυδία", "Νίκη"],
}
FAMILY = {
    "latin": ["Albers", "Brandt", "Castel", "Duval", "Ferrer", "Garrick", "Holm", "Iversen", "Keller", "Lindqvist", "Marlow", "Novak", "Olden", "Prado", "Quinn", "Roth", "Salas", "Thorne", "Ullman", "Varga"],
    "cyrillic": ["Белов", "Громов", "Жданов", "Зорин", "Котов", "Ларин", "Носов", "Рыбин"],
    "greek": ["Βλάχος", "Δήμου", "Λάμπρου", "Μαύρος", "Νικολάου", "Ρήγας"],
}
SYLLABLES = {"latin": ["ba", "do", "ke", "li", "mar", "nor", "ra", "sen", "ti", "vo"], "cyrillic": ["ба", "до", "ке", "ли", "мар", "нор", "ра", "ти"], "greek": ["βα", "δο", "κε", "λι", "μαρ", "νορ", "ρα", "τι"]}

_WORD = r"[^\W\d_][^\W\d_'’-]*(?:['’-][^\W\d_]+)*"
_NAME = rf"(?-i:(?=[^\W\d_a-zß-öø-ÿа-яα-ω])){_WORD}"
#: White space between the parts of a name: any run with at most one line end.
_GAP = r"(?:[^\S\n]+\n?[^\S\n]*|\n[^\S\n]*)"
_INITIAL = r"(?-i:(?=[^\W\d_a-zß-öø-ÿа-яα-ω]))[^\W\d_]\."
_BEFORE = rf"(?:{'|'.join(PARTICLES)})\b(?:{_GAP}(?:{'|'.join(ARTICLES)})\b)?"
_LEAD = rf"(?:{_INITIAL}{_GAP}?-?)*(?:(?-i:{_BEFORE}){_GAP})?"
_FULL = rf"(?:(?-i:(?:{'|'.join(ARTICLES)}))\b{_GAP})?{_LEAD}{_NAME}(?:{_GAP}{_LEAD}{_NAME}){{0,2}}|{_INITIAL}(?:{_GAP}?-?{_INITIAL})*"
_INTRO = "(?i:" + "|".join(x.replace(" ", _GAP).replace("'", "['’]") for x in INTRODUCTIONS) + ")"
#: National groupings: pairs (fr), three or two digits and pairs (es), an area code and a slash (de), unbroken behind a 0.
_NATIONAL = r"""(?:(?:\+|00)[0-9]{1,3}[ .-]?(?:\(0\)[ .-]?)?|0)[1-9](?:[ .-]?[0-9]{2}){4}
    |(?:(?:\+|00)[0-9]{1,3}[ .-]?)?(?:[6-9][0-9]{2}(?:[ .-][0-9]{2}){3}|[89][0-9][ .-][0-9]{3}(?:[ .-][0-9]{2}){2})
    |(?:(?:\+|00)[0-9]{1,3}[ .-]?\(0\)[ .-]?[0-9]{2,4}|(?:\+|00)[0-9]{1,3}[ .-][0-9]{2,4}|0[0-9]{2,4})[ ./-][0-9]{5,8}|0[1-9][0-9]{8,10}"""
_HEX = "[0-9A-Fa-f]{1,4}"
_TITLES = sorted({x for ts in TITLES.values() for t in ts for x in (t, t.upper())}, key=lambda t: (-len(t), t))
_TITLE = "|".join(map(re.escape, _TITLES)) + "|(?:" + "|".join(t.lower() for t in ABBREVIATED) + r")(?=\.)"
_MORE = "|".join(re.escape(t) for t in _TITLES if t.capitalize() not in CHAINED)
_MORE = rf"(?:(?:{_MORE})\b\.?|(?:{'|'.join(map(re.escape, DEGREES))})\.)"
_FIRST = "".join(sorted({t[0] for t in _TITLES} | {t[0].lower() for t in ABBREVIATED} | {c for x in INTRODUCTIONS for c in (x[0].lower(), x[0].upper())}))
#: One alternative per type; the group named after the type is what gets replaced.
PATTERN = re.compile(
    rf"""(?<!\w)(?P<email>\w[\w.%+-]*@(?:[^\W_]|-)+(?:\.(?:[^\W_]|-)+)*\.[^\W\d_]{{2,}})
    |(?<![\w.])(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)["']?\s*[=:]\s*["']?(?P<secret>(?=[+/_.~-]*[A-Za-z0-9])[A-Za-z0-9+/_.~-]{{6,}}=*)
    |(?<![A-Za-z0-9])(?P<awskey>(?:AKIA|ASIA)[A-Z0-9]{{16}}|(?:sk|pk|ghp|gho|xox[bap])[-_][A-Za-z0-9_-]{{16,}})(?![A-Za-z0-9])
    |(?<![A-Za-z0-9])(?P<iban>[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])
    |(?<![\w.])(?P<ip>(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){{3}}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]))(?![\w]|\.[0-9])
    |(?<![\w:])(?P<ipv6>(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f:]*[0-9])(?![0-9A-Fa-f:]*::[0-9A-Fa-f:]*::)(?!(?:[0-9A-Fa-f]*:+){{8}})(?:(?:{_HEX}:)+(?::{_HEX})+|(?:{_HEX}:){{2,}}:|::{_HEX}(?::{_HEX})+))(?![\w:])
    |(?<![\w-])(?P<ssn>[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}})(?![\w-])
    |(?<![\w.+-])(?P<card>[0-9](?:[ -]?[0-9]){{12,18}})(?![\w-])
    |(?<![\w+])(?P<phone>{_NATIONAL}|(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{2,4}}\)[ .-]?|[0-9]{{2,4}}[ .-])[0-9]{{3,4}}[ .-]?[0-9]{{3,4}}|\+[0-9]{{8,15}})(?![\w-])
    |(?<!\w)(?i:{"|".join(DIALLED)})[.:]{{0,2}}[ ]{{0,2}}(?P<dialled>[0-9]{{7,15}})(?![\w-])
    |(?<!\w)(?=[{_FIRST}])(?:(?P<title>(?:{_TITLE})\b\.?(?:{_GAP}{_MORE})*)|{_INTRO}){_GAP}(?P<name>{_FULL})""",
    re.X,
)
#: What entities begin with or contain; texts without any of it pass by the detector (Java syntax). The class of first
#: letters comes first, so that most characters are tried once only.
def _begins(words: list[str], tail: str = "") -> str:
    return f"(?=[{''.join(sorted({w[0] for w in words}))}])(?<![A-Za-z])(?:{'|'.join(map(re.escape, words))}){tail}"


TRIGGERS = [
    "[0-9@=:]",
    _begins(_TITLES, "(?![A-Za-z])"),
    _begins([t.lower() + "." for t in ABBREVIATED] + ["AKIA", "ASIA", "sk-", "sk_", "pk-", "pk_", "gho", "ghp", "xoxa", "xoxb", "xoxp"]),
    "(?iu)(?=[" + "".join(sorted({x[0] for x in INTRODUCTIONS})) + "])(?:" + "|".join(x.replace("'", "['’]").replace(" ", r"\s+") for x in INTRODUCTIONS) + ")",
]
WRAPPED = 40  # characters of a line that may have been wrapped within a name
_PIECE = re.compile(rf"(?P<initial>{_INITIAL})|(?P<particle>(?:{'|'.join(PARTICLES + ARTICLES)})\b(?!['’]))|(?P<word>{_WORD})")
#: Letters that initials, and letters beyond ASCII in addresses, are redrawn within.
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
_GENDER = {t.casefold(): g for g, ts in TITLES.items() for t in ts}


def may_hold(text: Column) -> Column:
    """Whether a text can hold an entity; false for null."""
    hit = text.rlike(TRIGGERS[0])
    for more in TRIGGERS[1:]:
        hit = hit | text.rlike(more)
    return F.coalesce(hit, F.lit(False))


def session_key(spark: SparkSession) -> bytes:
    """The session's secret (CONF), drawn once where it is not set."""
    if not spark.conf.get(CONF, None):
        spark.conf.set(CONF, secrets.token_hex(32))
    return spark.conf.get(CONF).encode()


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _whole(address: str) -> str:
    """An IPv6 address with its eight groups, none of them padded."""
    head, _, tail = address.partition("::")
    ends = [[g.lstrip("0") or "0" for g in x.split(":")] if x else [] for x in (head, tail)]
    return ":".join(ends[0] + ["0"] * (8 - len(ends[0]) - len(ends[1])) + ends[1])


def _script(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin"


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Entities of a text as (start, end, type, canonical form), in order, not overlapping.

    The type of a name part holds its role, gender and script; a family name has no gender, so
    that "Mr. Ann Holm" and "Mrs. Holm" share theirs."""
    out = []
    for m in PATTERN.finditer(text):
        kind = m.lastgroup
        start, end = m.span(kind)
        value = m.group(kind)
        if kind == "name":
            out += _name_parts(text, m)
        elif kind in ("card", "phone", "ssn", "dialled"):
            out.append((start, end, "phone" if kind == "dialled" else kind, re.sub(r"[^0-9]", "", value)))
        elif kind == "iban":
            out.append((start, end, kind, value.replace(" ", "")))
        else:
            if kind == "ipv6":
                value = _whole(value)
            out.append((start, end, kind, value.lower() if kind in ("email", "ipv6") else value))
    return out


def _name_parts(text: str, m: re.Match) -> list[tuple[int, int, str, str]]:
    """The parts of a name found: given names, initials and the family name, its particles left out.

    Behind a line end a name goes on only in wrapped text, where the line is a long one: else the next
    line begins something else."""
    start, end = m.span("name")
    titles = re.sub(r"[.]", " ", m["title"] or "").split()
    gender = next((g for g in (_GENDER.get(t.casefold(), "n") for t in titles) if g != "n"), "n")
    parts = list(_PIECE.finditer(text, start, end))
    for i, p in enumerate(parts):
        line = text.rfind("\n", 0, p.start()) if i else -1
        if line > parts[i - 1].end() - 1 and parts[i - 1]["word"] and line - text.rfind("\n", 0, line) < WRAPPED:
            parts = parts[:i]
            while len(parts) > 1 and parts[-1]["particle"]:
                parts.pop()
            break
    out, words = [], [p for p in parts if p["word"]]
    for p in parts:
        a, b, word = p.start(), p.end(), p.group()
        if p["initial"]:
            out.append((a, a + 1, f"initial:{_script(word)}", word[0].casefold()))
        elif p["word"]:
            if len(word) > 2 and word[-2] in "'’" and word[-1] in "sS":  # a genitive is no part of the name
                b, word = b - 2, word[:-2]
            family = p is words[-1] and (len(parts) > 1 or m["title"])
            out.append((a, b, f"family:{_script(word)}" if family else f"given:{gender}:{_script(word)}", word.casefold()))
    return out


class _Stream:
    """Keyed pseudo-random numbers of one entity and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.key, self.text, self.n, self.left = key, f"{kind}\0{value}\0{attempt}".encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.digest(self.key, self.text + self.n.to_bytes(4, "big"), hashlib.sha256)
            self.n += 1
        got, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return got % n


def _like(text: str, s: _Stream, hexed: bool = False) -> str:
    """Letters and digits redrawn within their class, all else kept."""
    out = []
    for c in text:
        if c.isascii() and c.isdigit():
            out.append("0123456789"[s.below(10)])
        elif c.isascii() and c.isalpha():
            if hexed:
                out.append("abcdef"[s.below(6)].upper() if c.isupper() else "abcdef"[s.below(6)])
            else:
                out.append(chr((65 if c.isupper() else 97) + s.below(26)))
        elif c.isalpha():
            letters = next((x for x in ALPHABETS if c.lower() in x), ALPHABETS[0])
            new = letters[s.below(len(letters))]
            out.append(new.upper() if c.isupper() and len(new.upper()) == 1 else new)
        else:
            out.append(c)
    return "".join(out)


def _initial(letter: str, key: bytes) -> str:
    """The letter that stands for an initial: the next one in a keyed order of its alphabet, so that
    different letters stay different and none stays itself."""
    letters = next((x for x in ALPHABETS if letter in x), None)
    if letters is None:
        return letter
    order = sorted(letters, key=lambda c: hmac.digest(key, f"initial\0{c}".encode(), hashlib.sha256))
    return order[(order.index(letter) + 1) % len(order)]


def _group(group: str, s: _Stream) -> str:
    """A group of an IPv6 address redrawn, not to zero."""
    got = _like(group, s, hexed=True)
    return got if got.strip("0") else got[:-1] + "123456789"[s.below(9)]


def _tail(value: str, s: _Stream, n: int) -> str:
    """`n` more characters for a value, of the class of its own."""
    if value.isdigit():
        return "".join("0123456789"[s.below(10)] for _ in range(n))
    letters = "abcdef0123456789" if re.fullmatch(r"[0-9a-fA-F]+", value) else "abcdefghijklmnopqrstuvwxyz"
    out = "".join(letters[s.below(len(letters))] for _ in range(n))
    return out.upper() if value.isupper() else out


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical entity."""
    if kind.startswith("initial"):
        return _initial(value, key)
    s = _Stream(key, kind, value, attempt)
    if kind.startswith(("given", "family")):
        script = kind.split(":")[-1]
        names = FAMILY[script] if kind.startswith("family") else GIVEN.get((kind.split(":")[1], script)) or GIVEN["n", script]
        out = names[s.below(len(names))]
        for _ in range((attempt > 2) + attempt // 8):  # short lists: longer names once they run out
            out += SYLLABLES[script][s.below(len(SYLLABLES[script]))]
        return out.casefold()
    more = 0 if attempt < GROW_AFTER else 1 + (attempt - GROW_AFTER) // 4
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        return _like(local, s) + _tail(local, s, more) + "@" + ".".join([_like(x, s) for x in labels[:-1]] + labels[-1:])
    if kind == "ip":
        if more > 4:  # an address has no room to grow: the other version's documentation range has
            return "2001:db8:" + ":".join(f"{s.below(65536):x}" for _ in range(6))
        first = value.split(".")[0]  # private ranges stay private, as long as they have room
        return ".".join([first if first in ("10", "127", "172", "192") and not more else str(1 + s.below(223))] + [str(s.below(256)) for _ in range(3)])
    if kind == "ipv6":
        # groups of zeros stay, so that a shortened address can stay short
        return ":".join(g if not g.strip("0") else _group(g, s) for g in value.split(":")) if not more else ":".join(f"{s.below(65536):x}" for _ in range(8))
    if kind == "card":
        out = value[0] + "".join(str(s.below(10)) for _ in value[1:-1]) + _tail("0", s, more)
        ok = [d for d in "0123456789" if _luhn(out + d) == _luhn(value)]
        return out + ok[s.below(len(ok))]
    if kind == "phone":
        first = "0" if value.startswith("0") else str(1 + s.below(9))  # a national prefix stays
        return first + "".join(str(s.below(10)) for _ in range(len(value) + more - 1))
    if kind == "iban":
        return value[:2] + _like(value[2:], s) + _tail("0", s, more)
    if kind == "awskey":
        return value[:4] + _like(value[4:], s) + _tail(value, s, more)
    return _like(value, s, hexed=bool(re.fullmatch(r"[0-9a-f:]+|[0-9A-F:]+", value))) + _tail(value, s, more)


def render(mention: str, kind: str, canonical: str) -> str:
    """A canonical surrogate in the form of a mention: its separators, and the case of its letters."""
    if kind in ("card", "phone", "ssn", "iban"):
        left = iter(canonical)
        return "".join(next(left) if c.isalnum() else c for c in mention) + "".join(left)
    if kind.startswith("initial"):
        return canonical.upper()
    if kind.startswith(("given", "family")):
        return canonical.upper() if mention.isupper() and len(mention) > 1 else canonical.title()
    if kind == "ipv6":
        if "::" in mention:
            canonical = str(ipaddress.IPv6Address(canonical))
        elif all(len(g) == 4 for g in mention.split(":")):
            canonical = ":".join(g.zfill(4) for g in canonical.split(":"))
        return canonical.upper() if mention.isupper() else canonical
    if kind == "email" and len(mention) == len(canonical):
        return "".join(c.upper() if m.isupper() else c for m, c in zip(mention, canonical))
    return canonical


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate) of distinct (kind, value): never a real value, and distinct per kind,
    given names of a script and addresses of both versions over all their kinds. A given name without
    gender shares the surrogate of its name with one.

    Rounds of drawing and checking; a round only handles what the one before had to refuse."""
    given = entities.where("kind LIKE 'given:%'").select("value", F.split("kind", ":").alias("p"))
    given = given.groupBy("value", F.col("p")[2].alias("script")).agg(F.array_remove(F.collect_set(F.col("p")[1]), "n").alias("g"))
    one = given.where("size(g) = 1").select("value", F.concat(F.lit("given:n:"), "script").alias("kind"), F.concat(F.lit("given:"), F.col("g")[0], F.lit(":"), "script").alias("as"))
    named = stage(entities.select("kind", "value").join(one, ["kind", "value"], "left").select("kind", "value", F.coalesce("as", "kind").alias("as")), "genders")
    space = F.when(F.col("kind").startswith("ip"), "ip").otherwise(F.regexp_replace("kind", "^given:[mfn]:", "given:"))

    def drawn(df: DataFrame, attempt: int) -> DataFrame:
        def rows(part: dict) -> dict:
            return part | {"surrogate": [surrogate(k, v, key, attempt) for k, v in zip(part["kind"], part["value"])]}

        return in_arrow(df, rows, "kind string, value string, surrogate string").withColumn("space", space)

    real = entities.select(space.alias("k"), F.col("value").alias("s"))
    done, pending = None, named.where("kind = as").select("kind", "value")
    for attempt in range(MAX_ATTEMPTS):
        tried = stage(drawn(pending, attempt), "surrogates")
        same = [F.col("space") == F.col("k"), F.col("surrogate") == F.col("s")]
        free = tried.join(real, same, "left_anti")
        if done is not None:
            free = free.join(done.select(F.col("space").alias("k"), F.col("surrogate").alias("s")), same, "left_anti")
        least = F.min(F.struct("value", "kind")).alias("e")
        good = stage(free.groupBy("space", "surrogate").agg(least).select("e.kind", "e.value", "surrogate", "space"), "surrogates")
        done = good if done is None else done.union(good)
        pending = stage(tried.join(good, ["kind", "value"], "left_anti").select("kind", "value"), "pending")
        if pending.isEmpty():
            found = done.select(F.col("kind").alias("as"), "value", "surrogate")
            return named.join(found, ["as", "value"]).select("kind", "value", "surrogate")
    raise RuntimeError(f"no free surrogates after {MAX_ATTEMPTS} attempts")


def pseudonymise(docs: DataFrame, key: bytes, count: str = "n_entities") -> DataFrame:
    """`docs` with text replaced, and `count` (mentions replaced) in place of a column of that name."""
    docs = docs.drop(count)
    hit, id_, key_, map_ = unused(docs, "hit", "id", "key", "map")
    own = docs.withColumn(hit, may_hold(F.col("text")))

    def mentions(part: dict) -> dict:
        found = [sorted({(k, v) for _, _, k, v in find(t)}) for t in part["text"]]
        return {"id": part["id"], "e": [[{"kind": k, "value": v} for k, v in x] for x in found]}

    texts = own.where(F.col(hit)).select(F.xxhash64("text").alias("id"), "text")
    seen = in_arrow(texts, mentions, "id long, e array<struct<kind:string,value:string>>")
    # the id stands for the text: equal texts share their mentions, and a clash would only add unused entries
    seen = stage(seen.select("id", F.explode("e").alias("e")).select("id", "e.kind", "e.value").distinct(), "mentions")
    entities = stage(seen.select("kind", "value").distinct(), "entities")
    initial = F.col("kind").startswith("initial:")  # there are no more of them than letters, and they need no checks

    def letters(part: dict) -> dict:
        return part | {"surrogate": [surrogate(k, v, key) for k, v in zip(part["kind"], part["value"])]}

    table = assign(entities.where(~initial), key).union(in_arrow(entities.where(initial), letters, "kind string, value string, surrogate string"))
    table = stage(table, "surrogates")
    pairs = seen.join(table.hint("merge"), ["kind", "value"])
    own_map = stage(pairs.groupBy(F.col("id").alias(key_)).agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias(map_)), "maps")
    rest = docs.columns
    schema = docs.select("text").schema
    assert schema[0].dataType.simpleString() == "string"

    def replaced(part: dict) -> dict:
        texts, counts = [], []
        for text, found in zip(part["text"], part[map_]):
            named = {(e["kind"], e["value"]): e["surrogate"] for e in found or ()}
            out, at, n = [], 0, 0
            for a, b, kind, value in find(text) if named else ():
                out += [text[at:a], render(text[a:b], kind, named[kind, value])]
                at, n = b, n + 1
            texts.append("".join(out) + text[at:])
            counts.append(n)
        return part | {"text": texts, count: counts}

    both = own.where(F.col(hit)).withColumn(id_, F.xxhash64("text")).join(own_map.hint("merge"), F.col(id_) == F.col(key_), "left")
    kinds = dict(docs.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in rest)
    changed = in_arrow(both.select(*rest, map_), replaced, f"{fields}, `{count}` long")
    return changed.unionByName(own.where(~F.col(hit)).select(*rest, F.lit(0).cast("long").alias(count)))
