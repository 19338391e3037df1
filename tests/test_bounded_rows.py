"""Work in proportion to the input, and tasks that hold little of it."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from versehall import batches
from versehall.functions import passages, readings
from versehall.operators import intervals, sequential


class Frame:
    """Stands in for a DataFrame whose function is called by the test itself."""

    dtypes = [("k", "bigint"), ("t", "string")]

    def select(self, *_):
        return self

    def mapInArrow(self, fn, schema):
        return fn


def test_times_of_a_long_line():
    n = 6000
    words = [f"w{i}" for i in range(n)]
    pieces = [(w, 300 * i, 300 * i + 250) for i, w in enumerate(words) if i % 2 == 0]
    began = time.process_time()
    got = readings.map_words(" ".join(words), 300 * n, pieces)
    assert time.process_time() - began < 2  # a table looked through for every piece took over ten seconds
    assert got[::2] == [(a, b) for _, a, b in pieces] and got[1::2] == [(300 * i + 250, 300 * i + 600) for i in range(0, n, 2)]


@pytest.mark.parametrize("cut, fields", [(sequential.segment, "paragraph int, kind string, piece string, break_ms int"), (sequential.split_clauses, "piece string")])
def test_pieces_are_handed_on(spark, cut, fields):
    """A batch of 10,000 rows of many pieces: the first pieces come before the last rows are cut."""
    text, seen = "Eins, zwei. " * 40 + "\n\nDrei.\n\n" * 10, []
    run = sequential.explode_text(Frame(), "k", "t", lambda t: seen.append(1) or cut(t), fields)
    batch = pa.RecordBatch.from_pydict({"k": pa.array(range(10_000), pa.int64()), "t": [text] * 10_000})
    first = next(run(iter([batch])))
    assert first.num_rows == batches.MADE and len(seen) <= batches.MADE
    rows = [piece if isinstance(piece, tuple) else (piece,) for piece in cut(text)]
    assert [tuple(r.values())[2:] for r in first.to_pylist()[: len(rows)]] == rows


def test_voices_stay_with_their_book(spark):
    from versehall.plans.catalogue import QUERIES

    plan = QUERIES["e8_voices"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "collect_list" not in plan  # a book's voices went with each of its people
    people = [(b, f"p{i:03}", (i * 7) % 23, sorted({i % 5, i % 7, i % 11})) for b in (1, 2, 3) for i in range(120)]
    voices = [(b, f"v{i:02}") for b in (1, 2, 2, 4) for i in range(40)]
    got = sequential.allocate_voices(spark.createDataFrame(people, "b long, who string, n long, heard array<long>"), spark.createDataFrame(voices, "b long, v string"), "b", "who", "n", "heard", "v")
    want = {(b, *x) for b in (1, 2) for x in sequential.allocate([p[1:] for p in people if p[0] == b], [v for c, v in voices if c == b]).items()}
    assert {tuple(r) for r in got.collect()} == want and len(want) == 240


def plan_of(spark, name):
    from versehall.plans.catalogue import QUERIES

    return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_thin_reads_no_groups(spark):
    assert "FlatMapGroupsInPandas" not in plan_of(spark, "j20_band_dedup")  # a call for every run of every user
    df = spark.range(30_000).select((F.col("id") % 2).alias("k"), F.col("id").alias("s"))
    got = sorted(tuple(r) for r in intervals.thin(df, ["k"], F.col("s"), [], 6).collect())
    assert got == [(k, s) for k in (0, 1) for s in range(k, 30_000, 8)]


def test_edits_of_long_texts(spark):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    draw = np.random.default_rng(5)
    for _ in range(300):
        a, b = ("".join(draw.choice(list("abcđ𝄞"), n)) for n in draw.integers(0, 40, 2))
        assert passages.edits(a, b) == plain(a, b)
    long = [" ".join(f"{p}{i}" for i in range(4000)) for p in "ab"]  # more words than there were private-use characters
    df = spark.createDataFrame([(long[0], long[1]), (long[0], None), ("a b c", "c"), ("", "x y")], "a string, b string")
    assert [r[0] for r in df.select(passages.token_distance(F.col("a"), F.col("b"))).collect()] == [4000, None, 1, 2]


def test_symbols_are_looked_for_once(spark):
    """The text before its cues was worked out again for every use of its parts."""
    from versehall.functions import speech

    text = F.concat(F.col("t"), F.lit(" once"))
    for said in (speech.spoken_symbols, speech.spoken_cries):
        plan = spark.createDataFrame([("a",)], "t string").select(said(text).alias("s"))._jdf.queryExecution().analyzed().toString()
        assert plan.count(" once") == 1


def test_books_one_by_one(spark, monkeypatch):
    """A file is read when the chapters of the one before have gone on."""
    from versehall.sources import books

    seen, real = [], books.explode
    monkeypatch.setattr(books, "explode", lambda df, *a, **k: seen.append(real(Frame(), *a, **k)) or real(df, *a, **k))
    books.read_books(spark, "/root/testdata/sf0.001", "*.txt")
    read = []
    monkeypatch.setattr(books, "chapters_of", lambda p, data: read.append(p) or [("a", "x"), ("b", "y")])
    batch = pa.RecordBatch.from_pydict({"path": ["1.txt", "2.txt"], "content": [b"x", b"y"]})
    got = [(len(read), b.num_rows) for b in seen[0](iter([batch]))]
    assert got == [(1, 1), (1, 1), (2, 1), (2, 1)]


def test_links_are_summed_where_they_stand(spark):
    """Places were made distinct by a shuffle of all of them, and each word took a copy of its whole text."""
    from versehall.operators import names

    labels = spark.createDataFrame([("Krai",), ("Tino Shade",), ("Sir",)], "l string")
    text = "Krai Tino Shade called Sir of Krai of Tino Tino Krai " + "word " * 40_000 + "Krai Tino"
    found = names.epithet_links(spark.createDataFrame([(text,)], "t string"), "t", labels, "l", ["of"])
    assert "Distinct" not in found._jdf.queryExecution().analyzed().toString()
    began = time.perf_counter()
    got = {(r.epithet, r.name): r.n for r in found.collect()}
    assert time.perf_counter() - began < 10
    # Tino and Tino Shade behind Krai are one name of the place
    assert got == {("Krai", "Tino Shade"): 3, ("Tino Shade", "Krai"): 1, ("Krai", "Sir"): 1}


def test_points_are_compared_in_blocks(spark, monkeypatch):
    """All pairs of neighbouring cells went through a sort; now a block hands on the nearest of each point."""
    from versehall.operators import select

    xs = [i % 25 / 100 for i in range(400)]
    one = spark.createDataFrame([([(x, 0.0) for x in xs[:25]], [(i, x, 0.0) for i, x in enumerate(xs)])], "own array<struct<x double, y double>>, others array<struct<id long, x double, y double>>")
    got = sorted(tuple(r) for r in select._nearest_of_blocks(one, (1.0, 1.0), 0.005, 4, "long").collect())
    assert got == sorted((xs[i], 0.0, i + 25 * n, 0.0) for i in range(25) for n in range(4))
    monkeypatch.setattr(select, "BLOCK", 16)
    rng = np.random.default_rng(1)
    pts = [(i, *map(float, rng.normal(0, 0.02, 2))) for i in range(300)]  # all in one cell
    found = select.nearest_in_grid(spark.createDataFrame(pts, "k long, x double, y double"), "k", ("x", "y"), (25.0, 50.0), 6.0, 3)
    want = {k: [j for _, j in sorted((25 * (x - a) ** 2 + 50 * (y - b) ** 2, j) for j, a, b in pts if j != k)[:3]] for k, x, y in pts}
    assert {(r.k, r.rank): r.near for r in found.collect()} == {(k, n + 1): j for k, js in want.items() for n, j in enumerate(js)}


def test_threshold_rows_are_worked_out_once(spark):
    """Each round on the way to a cut worked all scores out again."""
    from versehall.operators import ordering

    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda v: seen.add(1) or v, "double").asNondeterministic()
    df = spark.range(10_000).select("id", (F.col("id") % 3).alias("c"), (F.col("id") * 1.0).alias("v")).withColumn("s", count("v"))
    assert ordering.keep_by_threshold(df, ["c"], F.col("s"), 0.3).count() == 1000 + 999 + 999
    assert seen.value == 10_000


def test_rounds_read_what_is_left(spark, monkeypatch):
    """Each round of the colouring read all nodes again, those long done too."""
    from collections import Counter

    sizes = Counter()
    write = sequential.stage
    monkeypatch.setattr(sequential, "stage", lambda df, name: sizes.update({name: (out := write(df, name)).count()}) or out)
    edges = [(i, i + 1) for i in range(6)] + [(1000 + i, 2000 + i) for i in range(300)]
    got = dict(map(tuple, sequential.colours(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert len(got) == 607 and all(got[a] != got[b] for a, b in edges)
    assert sizes["colours"] == 607  # each node is written in one round


def test_voices_of_a_chapter_in_one_go(spark):
    """Components went through rounds of joins over all chapters."""
    from versehall.operators import dialogue

    said = [("b", "a"), ("c", "c"), ("d", "c"), ("e", "d"), ("f", "b"), ("g", "g")]
    assert sorted(dialogue._voices("x", 1, [dict(zip(("t", "first"), p)) for p in said])) == [("x", 1, t, v) for t, v in zip("abcdefg", "aacccag")]
