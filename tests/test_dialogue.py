"""Dialogue operators and readings on hand data."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from versehall.functions import readings
from versehall.functions import text as tx
from versehall.operators import dialogue


def test_number_words(spark):
    known = {0: "không", 5: "năm", 15: "mười lăm", 21: "hai mươi mốt", 24: "hai mươi tư", 105: "một trăm lẻ năm", 1005: "một nghìn không trăm lẻ năm", 2000000: "hai triệu", 10: "mười", -3: None, 10**12: None}
    df = spark.createDataFrame([(n,) for n in known], "n long")
    assert {r[0]: r[1] for r in df.select("n", readings.number_words(F.col("n"))).collect()} == known


def test_dropped_marks(spark):
    df = spark.createDataFrame([("Duc Trí", "Đức Trí"), ("Đức Trí", "Đức Trí"), ("Đúc", "Đức Trí"), ("Đúc", "Đức")], "a string, b string")
    assert [r[0] for r in df.select(tx.dropped_marks_of(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]  # the last lacks the horn only


def test_map_words():
    spans = readings.map_words("Hello big wide world", 2000, [("Hello", 0, 400), ("world", 1500, 1900)])
    assert spans[0] == (0, 400) and spans[3] == (1500, 1900)
    assert spans[1][0] == 400 and spans[2][1] == 1500 and spans[1][1] == spans[2][0]
    assert all(a <= b for a, b in spans) and readings.map_words("", 10, []) == []


def test_align_against_all_paths():
    lp = np.log(np.random.default_rng(1).dirichlet([1, 1, 1], 6))
    best, labels = None, [1, 2]
    for path in itertools.product(range(3), repeat=6):
        if [k for k, _ in itertools.groupby(path) if k] == labels:
            score = sum(lp[t, x] for t, x in enumerate(path))
            best = max(best or (score, path), (score, path))
    frames = [[t for t, x in enumerate(best[1]) if x == y] for y in labels]
    assert readings.align(lp, labels) == [(min(f), max(f)) for f in frames]


def test_wikitext(spark):
    """A misprint keeps the book's word, frames their content; notes stand where their list does, else at the end."""
    one = "== T ==\n'''Bold''' [[a|link]] {{SIC|wrng|wrong}}<ref>see x</ref> {{t|{{u}}}}<br/>end<!-- c -->"
    two = "a<ref>n</ref>\n{{chú thích}}\nb [[Hình:x.png|y]]"
    df = spark.createDataFrame([(one,), (two,), ("",), (None,)], "s string")
    got = [tuple(r) for r in df.select(*readings.plain_wikitext(F.col("s"))).collect()]
    assert got == [("T\n\nBold link wrng[1] uend\n\n▲ see x", ["see x"]), ("a[1]\n\n▲ n\n\nb", ["n"]), ("", []), (None, None)]


def test_work_items_and_blockers(spark):
    a = spark.createDataFrame([(1, "speaker", 10.0, 0.5)], "line int, kind string, affected double, doubt double")
    b = spark.createDataFrame([(1, "audio", 99.0, 0.5), (2, "audio", 4.0, 0.5)], a.schema)
    got = dialogue.work_items([a, b], {"speaker": 1.0, "audio": 0.9}, "line").orderBy("line").collect()
    assert [(r["line"], r["kind"], r["score"]) for r in got] == [(1, "speaker", 5.0), (2, "audio", 1.8)]
    rows = spark.createDataFrame([(1, "a|b"), (2, "a"), (3, "c"), (4, None)], "k int, codes string")
    assert [r["k"] for r in dialogue.blockers(rows, "k", "codes", ["a"], rows.where("k = 3")).collect()] == [1]


def test_context_budget(spark):
    df = spark.createDataFrame([("x", i, 10) for i in range(6)], "k string, s int, w int")
    got = {r["s"]: (r["first"], r["last"]) for r in dialogue.context_budget(df, "k", "s", F.col("w"), 40).collect()}
    assert got[2] == (0, 4) and got[0] == (0, 2)
