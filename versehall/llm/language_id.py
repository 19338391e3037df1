"""Language by Bayesian fusion of the text with what is known about its address.

Four kinds of evidence are multiplied: the text (character trigrams, counted per language over the
labelled documents), the language the markup declares, the suffix of the address and a language code
in it, and a prior of the host. How far a declaration or a suffix is to be trusted is learnt from the
data: P(value | language) by grouped sums of the text posteriors. Host priors are smoothed down the
hierarchy all -> domain -> host, each level with the weight of KAPPA rows of the one above.

Nothing is judged by itself: labelled texts are dealt to FOLDS by a hash of the text, and rows that are
among them (`held`) are scored by the trigrams of the other folds, so neither a document's own label
nor that of its copies is evidence for it; and every row is left out of the sums of its host, domain,
suffix, code and declaration.

There may be any number of languages: trigrams are hashed to so many buckets that the model holds at
most MODEL numbers, which is what reaches the driver and every task. Sums of evidence are sparse.

Defined cases: null or letterless texts say nothing about the language, the other evidence decides;
texts of any length count whole; missing url, host or declaration say nothing either; without
labelled documents the language is null; equally likely languages go to the first in code point
order; repeated rows give repeated results and count as often; id columns may have any names; an
empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versehall.llm.common import attach, in_arrow, ship, stage

BUCKETS = 1 << 16
MODEL = 1 << 22
FOLDS = 3
TEMPER = 1 / 3  # each character is in three trigrams
MOST = 60.0  # nats that a text may add against the likeliest language: models are never that sure
LEAST = 1e-9  # probability of a language below which a text is no evidence for it
KAPPA = 4.0
KEYS = ["host", "domain", "declared", "suffix", "code"]
_MARKUP = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>?", re.S | re.I)
_LETTER = np.array([chr(i).isalpha() for i in range(0x3000)] + [True])


def visible(html: str | None) -> str:
    return entities.unescape(_MARKUP.sub(" ", html or ""))


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter trigrams of all texts, and how many each text has."""
    lower = [f" {(t or '').lower()} " for t in texts]
    size = np.fromiter(map(len, lower), np.int64, len(lower))
    code = np.frombuffer("".join(lower).encode("utf-32-le", "replace"), np.uint32)
    letter = _LETTER[np.minimum(code, len(_LETTER) - 1)]
    code = np.where(letter, code, np.uint32(32))
    h = (code[:-2] * np.uint32(0x9E3779B1) + code[1:-1]) * np.uint32(0x85EBCA77) + code[2:]
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
    # the middle is a letter, and the trigram lies within its text
    ok = letter[1:-1].copy()
    at = np.cumsum(np.append(0, ok))
    ends = np.cumsum(size)
    first = np.concatenate([[0], ends[:-1]])
    n = at[np.minimum(ends - 2, len(ok))] - at[np.minimum(first, len(ok))]
    return h[ok].astype(np.int64), np.maximum(n, 0)


def fold_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def text_model(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (FOLDS + 1, buckets, languages) from all rows (text, lang): those
    of a fold come from the texts of the others, the last ones from all."""
    ship(labelled.sparkSession)
    known = labelled.where("lang IS NOT NULL")
    langs = sorted(r["lang"] for r in known.select("lang").distinct().collect())  # languages
    if not langs:
        return [], np.empty((FOLDS + 1, 1, 0), np.float32)
    buckets = BUCKETS
    while buckets > 1 and (FOLDS + 1) * buckets * len(langs) > MODEL:
        buckets //= 2
    schema = pa.schema([("lang", pa.string()), ("fold", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                names, folds, texts = (batch.slice(i, 256).column(k).to_pylist() for k in ("lang", "fold", "text"))
                for key in set(zip(names, folds)):
                    own = [t for *k, t in zip(names, folds, texts) if tuple(k) == key]
                    sums[key] = sums.get(key, 0) + np.bincount(trigrams(own)[0] % buckets, minlength=buckets)
        for (lang, fold), n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array([fold] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at])], schema=schema)

    rows = known.select("lang", fold_of(F.col("text")).alias("fold"), "text").mapInArrow(count, "lang string, fold int, bucket int, n long")
    rows = rows.groupBy("lang", "fold", "bucket").agg(F.sum("n").alias("n")).groupBy("lang", "fold").agg(F.collect_list(F.struct("bucket", "n")).alias("x"))
    counts, place = np.zeros((FOLDS, buckets, len(langs))), {x: i for i, x in enumerate(langs)}
    for r in rows.collect():  # at most MODEL pairs of numbers
        at = np.array([tuple(x) for x in r["x"]], np.int64)
        counts[r["fold"], at[:, 0], place[r["lang"]]] = at[:, 1]
    rest = np.concatenate([counts.sum(0) - counts, counts.sum(0)[None]]) + 0.5
    return langs, np.log(rest / rest.sum(1, keepdims=True)).astype(np.float32)


def address(url: Column) -> dict[str, Column]:
    """host, domain (last two labels), suffix and the language code of a url."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    code = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:([a-z]{2})\.[^/?#]*|[^/?#]*/([a-z]{2})(?:-[a-z]{2})?(?:/|$|[?#]).*)", 1)
    path = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:-[a-z]{2})?(?:/|$|[?#])", 1)
    blank = lambda c: F.when(c != "", c)
    return {"host": blank(host), "domain": blank(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)), "suffix": blank(F.regexp_extract(host, r"\.([^.]+)$", 1)), "code": F.coalesce(blank(path), blank(code))}


def declared(html: Column) -> Column:
    """The primary language that the markup declares."""
    tag = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", 1)
    meta = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<meta\b[^>]*http-equiv\s*=\s*[\"']?content-language[\"']?[^>]*content\s*=\s*[\"']?([A-Za-z]{2,3})\b", 1)
    return F.when(tag != "", F.lower(tag)).when(meta != "", F.lower(meta))


def fuse(ll: np.ndarray, sums: dict[str, list], total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (rows, languages) and host priors from text log likelihoods, sparse sums of evidence by
    kind (per row a list of (language, sum), or None without a value) and the sums of all rows."""
    n = ll.shape[1]
    post = np.exp(ll - ll.max(1, keepdims=True))
    post /= post.sum(1, keepdims=True)

    def others(kind: str) -> tuple[np.ndarray, np.ndarray]:
        """The kind's sums without the row itself, and which rows have a value."""
        out = np.zeros(ll.shape)
        for row, pairs in zip(out, sums[kind]):
            for x in pairs or ():
                row[x["i"]] = x["n"]
        has = np.array([x is not None for x in sums[kind]])
        return np.maximum(out - np.where(has[:, None], post, 0.0), 0.0), has

    prior = np.tile((total + 1) / (total.sum() + n), (len(ll), 1))
    for kind in ("domain", "host"):
        own, _ = others(kind)
        prior = (own + KAPPA * prior) / (own.sum(1, keepdims=True) + KAPPA)
    logs = np.log(prior) + ll
    for kind in ("declared", "suffix", "code"):  # log P(value | language), nothing where there is no value
        own, has = others(kind)
        share = (own.sum(1, keepdims=True) + 1) / (total.sum() + 1)
        logs += np.where(has[:, None], np.log((own + KAPPA * share) / (total + KAPPA)), 0.0)
    out = np.exp(logs - logs.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True), prior


def identify(rows: DataFrame, labelled: DataFrame, is_html: bool | Column = False, held: bool | Column = False) -> DataFrame:
    """Rows (id columns, text, host, domain, suffix, code, declared) with lang, probability,
    text_lang and host_prior (of lang). `is_html` says which texts are markup, `held` which rows are
    among the labelled ones."""
    langs, log_p = text_model(labelled)
    ids = [c for c in rows.columns if c not in ("text", *KEYS)]
    if not langs:
        none = F.lit(None)
        return rows.select(*ids, none.cast("string").alias("lang"), none.cast("double").alias("probability"), none.cast("string").alias("text_lang"), none.cast("double").alias("host_prior"))
    shared = rows.sparkSession.sparkContext.broadcast(log_p)
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    named = F.struct(*[F.col(c) for c in ids]) if ids else F.struct(F.lit(0).alias("none"))
    given = rows.select(named.alias("ids"), "text", F.when(column(held), fold_of(F.col("text"))).otherwise(FOLDS).alias("fold"), column(is_html).alias("html"), *KEYS)
    kind = dict(given.dtypes)["ids"]

    def likelihood(part: dict) -> dict:
        table = shared.value
        texts = [visible(t) if h else t for t, h in zip(part.pop("text"), part.pop("html"))]
        grams, n = trigrams(texts)
        at = grams % table.shape[1] + np.repeat(np.array(part.pop("fold")), n) * table.shape[1]
        flat = table.reshape(-1, table.shape[2])
        sums = np.zeros((len(n), table.shape[2]))
        some = np.flatnonzero(n)
        if len(some):
            first = (np.cumsum(n) - n)[some]
            for i in range(table.shape[2]):
                sums[some, i] = np.add.reduceat(flat[:, i][at].astype(np.float64), first)
        sums = np.maximum((sums - sums.max(1, keepdims=True)) * TEMPER, -MOST)
        post = np.exp(sums)
        post /= post.sum(1, keepdims=True)
        sparse = [[{"i": int(i), "p": float(row[i])} for i in np.flatnonzero(row > LEAST)] for row in post]
        return part | {"ll": list(sums), "post": sparse}

    fields = ", ".join(f"{k} string" for k in KEYS)
    scored = stage(in_arrow(given, likelihood, f"ids {kind}, {fields}, ll array<double>, post array<struct<i:int,p:double>>", 256), "likelihoods")
    known = F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("key")), *[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in KEYS])
    sums = scored.select("post", F.explode(known).alias("k")).where("k.key IS NOT NULL").select("k.kind", "k.key", F.explode("post").alias("x"))
    sums = stage(sums.groupBy("kind", "key", "x.i").agg(F.sum("x.p").alias("n")), "evidence")
    total = np.zeros(len(langs))
    for r in sums.where("kind = 'all'").collect():  # languages
        total[r["i"]] = r["n"]
    out = scored.drop("post")
    for k in KEYS:
        table = sums.where(F.col("kind") == k).groupBy(F.col("key").alias(k)).agg(F.collect_list(F.struct("i", "n")).alias(f"s_{k}"))
        out = attach(out, stage(table, k), k, F.struct("ids", "ll"))

    def decide(part: dict) -> dict:
        ll = np.array(part["ll"]).reshape(-1, len(langs))
        post, prior = fuse(ll, {k: part[f"s_{k}"] for k in KEYS}, total)
        best = post.argmax(1)
        at = np.arange(len(best))
        return {"ids": part["ids"], "lang": [langs[i] for i in best], "probability": post[at, best].round(6), "text_lang": [langs[i] for i in ll.argmax(1)], "host_prior": prior[at, best].round(6)}

    done = in_arrow(out.select("ids", "ll", *[f"s_{k}" for k in KEYS]), decide, f"ids {kind}, lang string, probability double, text_lang string, host_prior double", 4096)
    return done.select(*[F.col("ids")[c].alias(c) for c in ids], "lang", "probability", "text_lang", "host_prior")
