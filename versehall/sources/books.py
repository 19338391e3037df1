"""Text sources: files of several formats to chapters, decoded in the tasks that read them.

Files are listed and read by Spark (`binaryFile`), so any store that Spark reads will do. Formats:
.txt (with encoding detection), .html/.htm/.xhtml, .docx, .epub. A file that cannot be read gives
one row with an error and no text.
"""

from __future__ import annotations

import io
import posixpath
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versehall.batches import explode
from versehall.functions.text import is_heading, natural_key
from versehall.operators.merge import content_keys
from versehall.operators.sequential import explode_text
from versehall.session import ship
from versehall.sources.epub import Epub

CODECS = ("utf-8-sig", "cp1258", "cp1252")
SCHEMA = "path string, title string, chapter int, text string, error string"
_BLOCK = set("p div h1 h2 h3 h4 h5 h6 li br tr blockquote section article pre hr title".split())
UNREADABLE = (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError)
_HIDDEN = {"script", "style", "head", "template", "rt", "rp"}


def decode(data: bytes) -> str:
    """SRC5: byte-order marks, UTF-16 by its share of NULs, UTF-8, then Windows code pages; NFC."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        text = data.decode("utf-16", "replace")
    elif data and data.count(0) / len(data) >= 0.2:
        even = data[0::2].count(0) > data[1::2].count(0)
        text = data.decode("utf-16-be" if even else "utf-16-le", "replace")
    else:
        text = next((t for t in (_strict(data, name) for name in CODECS) if t is not None), None)
    if text is None or data and text.count("\ufffd") > max(0, data.count(b"\xef\xbf\xbd")):
        # what was taken for UTF-16 does not hold as such: the other codecs again, then one that takes all
        text = next((t for t in (_strict(data, name) for name in CODECS) if t is not None), data.decode("latin-1"))
    return unicodedata.normalize("NFC", text)


def _strict(data: bytes, codec: str) -> str | None:
    try:
        return data.decode(codec)
    except UnicodeDecodeError:
        return None


class _Blocks(HTMLParser):
    """SRC8: text of a page block by block; parts begin at the elements of `marks`."""

    def __init__(self, marks: set[str] | None = None):
        super().__init__(convert_charrefs=True)
        self.marks, self.hidden = marks or set(), 0
        self.parts: list[tuple[str, list[list[str]]]] = [("", [[]])]

    @property
    def out(self) -> list[list[str]]:
        return self.parts[-1][1]

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        here = next((v for k, v in attrs if k in ("id", "name") and v in self.marks), None)
        if here is not None:
            self.marks = self.marks - {here}
            self.parts.append((here, [[]]))
        elif tag in _BLOCK:
            self.out.append([])

    def handle_endtag(self, tag):
        if tag in _HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in _BLOCK:
            self.out.append([])

    def handle_data(self, data):
        if not self.hidden:
            self.out[-1].append(data)


def html_parts(html: str, marks: set[str] | None = None) -> list[tuple[str, str]]:
    """The text of a page, cut before the elements whose id is in `marks`: (id, text)."""
    p = _Blocks(marks)
    p.feed(html)
    p.close()
    return [(i, "\n".join(x for x in (" ".join("".join(b).split()) for b in out) if x)) for i, out in p.parts]


def html_text(html: str) -> str:
    return html_parts(html)[0][1]


def docx_text(data: bytes) -> str:
    """SRC9: paragraphs of a word-processor file."""
    return "\n".join(t for _, t in _docx_paragraphs(data))


def _docx_paragraphs(data: bytes) -> list[tuple[bool, str]]:
    """(whether it bears a heading or title style, text) of each paragraph."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    style = lambda p: next((s.get(f"{w}val") or "" for s in p.iter(f"{w}pStyle")), "")
    return [(bool(re.match(r"(?i)heading\s*[12]\b|heading[12]\b|title", style(p))), "".join(t.text or "" for t in p.iter(f"{w}t"))) for p in root.iter(f"{w}p")]


def docx_chapters(data: bytes, name: str) -> list[tuple[str, str]]:
    """SRC9: a chapter begins at each paragraph of a heading style; what stands before the first is one
    of the file's name."""
    out: list[tuple[str, list[str]]] = []
    for heading, text in _docx_paragraphs(data):
        if heading and text.strip():
            out.append((text.strip(), [text]))
        elif text.strip() or out:
            if not out:
                out.append((name, []))
            out[-1][1].append(text)
    return [(title, "\n".join(lines)) for title, lines in out]


def epub_chapters(data: bytes) -> list[tuple[str, str]]:
    """SRC7: (title, text) of each chapter in reading order."""
    return Epub(data).chapters(lambda page, marks: html_parts(decode(page), marks))


def chapters_of(path: str, data: bytes) -> list[tuple[str, str]]:
    """SRC6: chapters of one file by its ending."""
    name = posixpath.basename(path)
    ending = name.rpartition(".")[2].lower()
    if ending == "epub":
        return epub_chapters(data)
    if ending == "docx":
        return docx_chapters(data, name) or [(name, "")]
    if ending in ("html", "htm", "xhtml"):
        return [(name, html_text(decode(data)))]
    return [(name, decode(data))]


class _Paragraphs(HTMLParser):
    """SRC12: the visible <p> of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[list[str]] = []
        self.open, self.hidden = False, 0

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "p":
            named = dict(attrs)
            style = (named.get("style") or "").replace(" ", "").lower()
            self.open = "hidden" not in named and "display:none" not in style and "visibility:hidden" not in style
            if self.open:
                self.out.append([])
        elif tag in _BLOCK and tag != "br":
            self.open = False
        elif self.open and tag == "br":
            self.out[-1].append("\n")

    def handle_endtag(self, tag):
        if tag in _HIDDEN and self.hidden:
            self.hidden -= 1
        elif tag == "p":
            self.open = False

    def handle_data(self, data):
        if self.open and not self.hidden:
            self.out[-1].append(data)


def web_paragraphs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """SRC12: (key, pos, text) of the paragraphs of web chapters, those hidden by an attribute or style
    left out."""

    def cut(source: str | None) -> list[str]:
        p = _Paragraphs()
        p.feed(source or "")
        p.close()
        return [" ".join("".join(x).split()) for x in p.out]

    return explode_text(pages, key, html, cut, "text string")


def read_books(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SRC3, SRC6: chapters of all files under `path`, with `order_key` in natural order of names."""
    ship(spark)

    def chapters(p: str, data: bytes) -> list[tuple]:
        try:
            return [(p, title, i, text, None) for i, (title, text) in enumerate(chapters_of(p, data))]
        except UNREADABLE as e:
            return [(p, None, 0, None, f"{type(e).__name__}: {e}")]

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    out = explode(files, chapters, SCHEMA, taken=1, most=1)  # one file and one chapter at a time
    return out.withColumn("order_key", natural_key(F.element_at(F.split("path", "/"), -1)))


BOOK = "path string, title string, author string, language string, cover binary, cover_type string, error string"


def read_titles(spark: SparkSession, path: str, pattern: str = "*.epub") -> DataFrame:
    """SRC7: title, author, language and cover of e-books; a file that cannot be read gives an error."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, data in zip(batch["path"], batch["content"]):
                try:
                    book = Epub(data)
                    rows.append((p, book.title, book.author, book.language, *(book.cover or (None, None)), None))
                except UNREADABLE as e:
                    rows.append((p, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in BOOK.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content").mapInPandas(run, BOOK)


def split_on_headings(chapters: DataFrame, text: str = "text") -> DataFrame:
    """chapters cut before their heading lines; what stands before the first is part 0."""
    lines = F.split(text, "\n")
    part = F.aggregate(
        lines,
        F.array().cast("array<string>"),
        lambda acc, line: F.when((F.size(acc) == 0) | F.coalesce(is_heading(line), F.lit(False)), F.concat(acc, F.array(line))).otherwise(
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws("\n", F.element_at(acc, -1), line)))
        ),
    )
    return chapters.select("*", F.posexplode(part).alias("part", "part_text"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC13: JSON lines; blank ones are skipped, broken ones give nulls."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def parse_gold(line: Column) -> Column:
    """SRC14: `seq kinds speakers emotions lo-hi paces volumes gender`; names may hold spaces, `~`
    marks half credit, `seq N` and `seq H` are narration and headings; comments give null."""
    clean = F.trim(F.regexp_replace(line, r"\s+", " "))
    full = r"^(\d+) (\S+) (.+) (\S+) (\d+)(?:-(\d+))? (\S+) (\S+) (\S+)$"
    g = lambda i: F.regexp_extract(clean, full, i)
    many = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    speakers = F.transform(many(g(3)), lambda x: F.struct(F.regexp_replace(x, "~$", "").alias("name"), F.when(x.endswith("~"), 0.5).otherwise(1.0).alias("credit")))
    none = F.array().cast("array<string>")
    whole = F.struct(
        g(1).try_cast("long").alias("seq"), many(g(2)).alias("kinds"), speakers.alias("speakers"), many(g(4)).alias("emotions"),
        g(5).try_cast("int").alias("low"), F.coalesce(g(6).try_cast("int"), g(5).try_cast("int")).alias("high"), g(9).alias("gender"),
    )
    short = F.struct(
        F.regexp_extract(clean, r"^(\d+) [NH]$", 1).try_cast("long").alias("seq"),
        F.array(F.when(clean.endswith("H"), "heading").otherwise("narration")).alias("kinds"),
        F.array().cast("array<struct<name:string,credit:double>>").alias("speakers"), none.alias("emotions"),
        F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"), F.lit("").alias("gender"),
    )
    return F.when(clean.rlike(full), whole).when(clean.rlike(r"^\d+ [NH]$"), short)


def write_shards(df: DataFrame, key: str, path: str) -> None:
    """SRC15: a catalogue partitioned by the first two hex digits of the key's SHA-1."""
    df.withColumn("shard", F.substring(F.sha1(F.col(key).cast("string")), 1, 2)).repartition("shard").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, key: str, wanted: list[str]) -> DataFrame:
    """Only the shards of the wanted keys are listed and read."""
    import hashlib

    shards = sorted({hashlib.sha1(k.encode()).hexdigest()[:2] for k in wanted})
    return spark.read.parquet(path).where(F.col("shard").isin(shards) & F.col(key).cast("string").isin(wanted))


def write_splits(df: DataFrame, path: str) -> None:
    """SNK2: JSON lines, a folder a split."""
    df.write.partitionBy("split").json(path)


def blinded_report(scores: DataFrame, model: str, seed: str) -> tuple[DataFrame, DataFrame]:
    """SNK3: scores with models named A, B, ... in the order of a keyed hash, and the key table."""
    from pyspark.sql import Window

    names = scores.select(model).distinct()
    place = F.row_number().over(Window.orderBy(F.sha1(F.concat(F.lit(seed), F.col(model)))))  # a row a model
    key = names.withColumn("label", F.concat(F.lit("model "), F.char(F.lit(64) + place)))
    return scores.join(key, model).drop(model), key


def manifest(chapters: DataFrame, by: str, name: Column | None = None) -> DataFrame:
    """SNK4: files, words, characters and one digest of each group, whatever the order of its files:
    files are dealt to 4096 parts by their name (without one, by their text), whose sorted digests are
    digested in turn."""
    name = F.sha2(F.coalesce("text", F.lit("")), 256) if name is None else name
    words = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0))
    sums = chapters.groupBy(by).agg(F.count("*").alias("files"), F.sum(words).cast("long").alias("words"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("chars"))
    keys = content_keys(chapters, by, name, F.sha2(F.coalesce("text", F.lit("")), 256)).withColumnRenamed("key", "digest")
    return sums.join(keys, sums[by].eqNullSafe(keys[by])).drop(keys[by])


def drift(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """SNK4 --check: groups that are new, gone or changed."""
    a = old.select(by, F.col("digest").alias("was"))
    b = new.select(by, F.col("digest").alias("now"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").otherwise("changed")
    return a.join(b, by, "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select(by, state.alias("state"))
