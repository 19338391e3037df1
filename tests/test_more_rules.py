"""Rules of merging, spelling and casting on hand data."""

import io
import math
import zipfile

from pyspark.sql import functions as F

from versehall.operators import dialogue, entity, merge, sequential
from versehall.sources import books


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_source_spelling(spark):
    names = spark.createDataFrame([("Karlo", 3), ("Duc", 2), ("Mareia", 1), ("Josefine", 1), ("Lan", 9)], "name string, lines int")
    words = spark.createDataFrame([("Karla", 9), ("Đức", 8), ("Maria", 7), ("Marta", 5), ("Josephine", 4), ("Lan", 9), ("Rare", 1)], "name string, hits int")
    got = dict(rows(entity.to_source_spelling(names, words)))
    assert got == {"Karlo": "Karla", "Duc": "Đức", "Mareia": "Maria", "Josefine": "Josephine"}


def test_record_merge(spark):
    r = spark.createDataFrame([("a", 5, "me", "l", False), ("a", 5, "me", "i", True), ("b", 7, "me", "l", False), ("c", 9, "you", "i", True)], "k string, at int, who string, v string, inc boolean")
    t = spark.createDataFrame([("b", 7), ("c", 8)], "k string, at int")
    got = merge.merge_records(r, t, "k", "at", "who", F.col("inc")).select("k", "v", "active")
    assert rows(got) == [("a", "l", True), ("c", "i", True)]
    a = spark.createDataFrame([("x", "open"), ("y", "done")], "k string, s string")
    b = spark.createDataFrame([("x", "done"), ("y", "open"), ("z", "open")], "k string, s string")
    assert rows(merge.merge_wishes(a, b, "k", "s", ["open", "done"])) == [("x", "done"), ("y", "done"), ("z", "open")]


def test_point_of_view(spark):
    c = spark.createDataFrame([("Anna", "I went. I saw it. They left."), ("Ben", "Ben went. Ben saw. Ben ran. I left."), (None, "I."), ("Kim", "")], "h string, t string")
    assert [r["h"] for r in dialogue.point_of_view(c, "h", "t", r"\bI\b").collect()] == ["Anna"]


def test_split_labels(spark):
    t = spark.createDataFrame([("x", 1, "bro"), ("x", 2, "bro"), ("x", 3, "sir"), ("y", 1, "sir"), ("y", 2, "sir")], "label string, line int, term string")
    assert rows(dialogue.split_labels(t, "label", "line", "term")) == [("x", 2, 2)]


def test_allocate():
    got = sequential.allocate([("a", 9, [1, 2]), ("b", 5, [2]), ("c", 4, [3]), ("d", 1, [2])], ["v", "w"])
    assert got["a"] != got["b"] and got["c"] == got["b"] and got["d"] in "vw"


def test_split_doubts(spark):
    """A label that says ta and cậu elsewhere says anh and bà in some lines of one chapter."""
    usual = [("L", c, c * 100 + i, t) for c in (1, 2) for i in range(6) for t in ("ta", "cậu")]
    odd = [("L", 2, 250 + i, t) for i in range(3) for t in ("tôi", "bà")]
    same = [("M", c, 900 + c * 10 + i, t) for c in (1, 2) for i in range(4) for t in ("ta", "cậu")]
    df = spark.createDataFrame(usual + odd + same, "who string, ch int, line int, t string")
    got = dialogue.split_doubts(df, "who", "ch", "line", "t", ["ta", "tôi"], 40).collect()
    assert [(r["who"], r["ch"], sorted(r["lines"]), r["odd"], r["usual"]) for r in got] == [("L", 2, [250, 251, 252], ["bà", "tôi"], ["cậu", "ta"])]
    want = sum(math.log(0.5 / (12 + 20)) for _ in range(2)) / 2
    assert abs(got[0]["margin"] - (math.log(6.5 / 32) - want)) < 1e-9
    assert dialogue.split_doubts(df.where("ch = 2"), "who", "ch", "line", "t", ["ta", "tôi"], 40).count() == 0  # nothing known elsewhere
    assert dialogue.split_doubts(df.limit(0), "who", "ch", "line", "t", [], 40).count() == 0


def epub(nav: str, page: str, more: str = "") -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("META-INF/container.xml", '<c><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></c>')
        z.writestr("o/c.opf", f'<package xmlns:dc="d"><metadata><dc:title> A  Book </dc:title><dc:creator>Ann</dc:creator><dc:language>en</dc:language><meta name="cover" content="pic"/></metadata><manifest><item id="n" href="nav.xhtml" properties="nav"/><item id="a" href="a%20b.xhtml"/><item id="pic" href="p.png" media-type="image/png"/>{more}</manifest><spine><itemref idref="n"/><itemref idref="a"/></spine></package>')
        z.writestr("o/nav.xhtml", nav)
        z.writestr("o/a b.xhtml", page)
        z.writestr("o/p.png", b"PNG")
    return buf.getvalue()


def test_epub_contents_title_and_cover(spark, tmp_path):
    page = "<html><body><p>Before</p><h1 id='x'>First</h1><p>one</p><div><p id='y'>Second</p>two</div></body></html>"
    cut = '<html><body><a href="a%20b.xhtml#x">Ch 1</a><a href="a%20b.xhtml#y">Ch 2</a><a href="a%20b.xhtml#gone">Ch 3</a></body></html>'
    whole = '<html><body><a href="a%20b.xhtml">All of it</a></body></html>'
    (tmp_path / "a.epub").write_bytes(epub(cut, page))
    (tmp_path / "b.epub").write_bytes(epub(whole, page))
    (tmp_path / "c.epub").write_bytes(b"no zip")
    got = [(r["path"][-6], r["title"], r["text"]) for r in books.read_books(spark, str(tmp_path)).orderBy("order_key", "chapter").collect()]
    assert got == [("a", "Before", "Before"), ("a", "Ch 1", "First\none"), ("a", "Ch 2", "Second\ntwo"), ("b", "All of it", "Before\nFirst\none\nSecond\ntwo"), ("c", None, None)]
    rows_ = books.read_titles(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r["title"], r["author"], r["language"], r["cover_type"]) for r in rows_] == [("A Book", "Ann", "en", "image/png")] * 2 + [(None, None, None, None)]
    assert bytes(rows_[0]["cover"]) == b"PNG" and rows_[2]["error"]


def test_decoding_and_styles(spark, tmp_path):
    assert books.decode("Tiếng".encode("cp1258", "ignore")) and books.decode("é\ufffd".encode()) == "é\ufffd"
    assert books.decode(b"\xff\xfe\x41\xd8") == books.decode(b"\xff\xfe\x41\xd8") and "\ufffd" not in books.decode(b"\xff\xfe\x00\xd8\x41")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    par = lambda t, st="": f'<w:p><w:pPr><w:pStyle w:val="{st}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{par('intro')}{par('One', 'Heading1')}{par('text')}{par('Two', 'heading 2')}{par('more')}</w:body></w:document>")
    (tmp_path / "d.docx").write_bytes(buf.getvalue())
    got = [(r["title"], r["text"]) for r in books.read_books(spark, str(tmp_path)).orderBy("chapter").collect()]
    assert got == [("d.docx", "intro"), ("One", "One\ntext"), ("Two", "Two\nmore")]
