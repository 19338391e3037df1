"""Operators on hand tables: ties, nulls, empty inputs, and brute-force loops."""

import io
import itertools
import random
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from versehall.functions import text as tx
from versehall.operators import entity, evaluation, intervals, merge, select, sequential
from versehall.sources import books
from versehall.streaming import state


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_mode_vote_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, None), (3, "c")], "k int, v string")
    assert rows(evaluation.mode_vote(df, ["k"], "v", "unknown")) == [(1, "a"), (2, "unknown"), (3, "c")]
    assert evaluation.mode_vote(df.limit(0), ["k"], "v", "unknown").count() == 0


def test_last_writer_ties(spark):
    df = spark.createDataFrame([("a", 5, "mine", False), ("a", 5, "theirs", True), ("b", 1, "mine", False), ("b", 2, "theirs", True)], "k string, at int, v string, inc boolean")
    assert rows(merge.last_writer(df, ["k"], "at", "v", F.col("inc"), False)) == [("a", "mine", 5), ("b", "theirs", 2)]
    assert rows(merge.last_writer(df, ["k"], "at", "v", F.col("inc"), True)) == [("a", "theirs", 5), ("b", "theirs", 2)]


def test_night_log_and_stale(spark):
    df = spark.createDataFrame([("n", 5, [1], False, False), ("n", 5, [1, 2], True, True), ("m", 1, [1], False, False)], "k string, at int, events array<int>, dismissed boolean, inc boolean")
    assert rows(merge.night_log(df, ["k"], "at", F.col("inc"))) == [("m", [1], 1, False), ("n", [1, 2], 5, True)]
    assert rows(merge.stale(df, ["k"], F.col("at"), F.lit(8), 4)) == [("m", 7, True), ("n", 3, False)]


def test_carry_over_drops_ties(spark):
    df = spark.createDataFrame([("v", "a", 2), ("v", "b", 2), ("w", "a", 3), ("w", "b", 1)], "voice string, holder string, r int")
    assert rows(entity.carry_over(df, "voice", "holder", [F.col("r")])) == [("w", "a")]


def test_entity_passes(spark):
    df = spark.createDataFrame([("Duc Tri", 2), ("Đức Trí", 9), ("Lan", 50), ("Lan Anh", 2), ("Minh", 4), ("Tran Minh", 3), ("le  van", 1), ("Le Van", 7)], "name string, lines int")
    assert rows(entity.dropped_marks(df)) == [("Duc Tri", "Đức Trí")]
    assert rows(entity.stray_surnames(df)) == [("Lan Anh", "Lan")]
    assert rows(entity.given_to_full(df)) == [("Minh", "Tran Minh")]
    assert rows(entity.by_identity(df)) == [("le  van", "Le Van")]
    confirmed = spark.createDataFrame([("Minh", "Other")], "name string, target string")
    assert ("Minh", "Other") in rows(entity.redirect(df, entity.given_to_full(df), confirmed))


def test_fuzzy_unique(spark):
    words = ["karl", "kart", "card", "maria", "mario", "josef"]
    a = spark.createDataFrame([(w,) for w in words], "name string")
    b = spark.createDataFrame([("karla",), ("marie",), ("joseph",)], "name string")
    assert rows(entity.fuzzy_unique(a, b, "name", 1)) == [("karl", "karla"), ("maria", "marie"), ("mario", "marie")]


def test_interval_join_against_loop(spark):
    random.seed(4)
    stamp = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    pts = [(i % 3, stamp(random.randrange(9000)), i) for i in range(80)]
    spans = [(i % 3, stamp(a), stamp(a + random.randrange(4000)), i) for i, a in enumerate(random.sample(range(9000), 20))]
    p = spark.createDataFrame(pts, "k int, ts timestamp_ntz, id int")
    s = spark.createDataFrame(spans, "k int, start timestamp_ntz, end timestamp_ntz, span int")
    got = rows(intervals.interval_join(p, s, ["k"], "ts", 1_000_000_000).select("id", "span"))
    assert got == sorted([(i, n) for k, t, i in pts for q, a, b, n in spans if k == q and a <= t < b], key=str)


def test_pick_tracks_against_loop(spark):
    random.seed(1)
    data = [("b", s, t, random.random()) for s in range(12) for t in range(5)]
    got = {r["scene"]: r["track"] for r in select.pick_tracks(spark.createDataFrame(data, "book string, scene int, track int, cost double"), "book", "scene", "track", "cost").collect()}
    used = []
    for s in range(12):
        free = [x for x in data if x[1] == s and x[2] not in used[-3:]]
        used.append(min(free, key=lambda x: (x[3], x[2]))[2])
    assert [got[s] for s in range(12)] == used


def test_thin_islands_breaks(spark):
    df = spark.createDataFrame([(1, 0.0, "a", 1), (1, 3.0, "a", 1), (1, 20.0, "b", 2), (2, 0.0, "a", 1)], "k int, s double, v string, p int")
    assert rows(intervals.thin(df, ["k"], F.col("s"), ["v"], 5).select("k", "s")) == [(1, 0.0), (1, 20.0), (2, 0.0)]
    assert [r["island"] for r in intervals.islands(df, ["k"], ["s"], F.col("v")).orderBy("k", "s").collect()] == [1, 1, 2, 1]
    assert [r["break_ms"] for r in intervals.breaks(df, ["k"], ["s"], "p", F.lit(170)).orderBy("k", "s").collect()] == [170, 380, 0, 0]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab ,.!?…\n“”\"-()é", max_size=160), st.integers(5, 60))
def test_sequential_invariants(text, most):
    assert "".join(sequential.split_clauses(text, most)) == text
    assert all(len(p) <= most for p in sequential.pack_sentences(text, most))
    strip = lambda s: [w for w in "".join(c if c.isalnum() else " " for c in s).split()]
    assert strip(" ".join(p[2] for p in sequential.segment(text))) == strip(text)


def test_segment_kinds():
    got = sequential.segment("He said “Go now!” and left.\n\n- Yes\n(Hm, why)\n“Open quote\ngoes on” end")
    assert [(n, k) for n, k, _, _ in got] == [(0, "narration"), (0, "dialogue"), (0, "narration"), (1, "dialogue"), (1, "thought"), (1, "dialogue"), (1, "dialogue"), (1, "narration")]
    assert got[2][3] == 380 and got[-1][3] == 0
    assert sequential.segment(None) == []
    over = sequential.segment("He began. “First part\n\nsecond part” he said.\n\n“Never closed\n\nNarration goes on.\n\nThe so-called “guild,” grew.")
    assert [(n, k) for n, k, _, _ in over] == [(0, "narration"), (0, "dialogue"), (1, "dialogue"), (1, "narration"), (2, "dialogue"), (3, "narration"), (4, "narration"), (4, "narration"), (4, "narration")]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    e, t = np.log(rng.dirichlet([1, 1, 1], 6)), np.log(rng.dirichlet([1, 1, 1], (3, 3)))
    score = lambda p: sum(e[i, x] for i, x in enumerate(p)) + sum(t[p[i - 2], p[i - 1], p[i]] for i in range(2, len(p)))
    assert tuple(sequential.viterbi(e, t)) == max(itertools.product(range(3), repeat=6), key=score)


def test_colour_lpt_pins(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (5, 5), (2, 1)], "a int, b int")
    c = dict(rows(sequential.colours(edges, "a", "b")))
    assert len({c[1], c[2], c[3]}) == 3 and c[4] != c[3] and c[3] == 0 and 5 not in c
    assert sequential.colours(edges.limit(0), "a", "b").count() == 0
    assert sequential.lpt({"a": 5, "b": 4, "c": 3, "d": 3}, 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    pins = pd.DataFrame({"voice": "v", "name": ["a", "b", "c"], "exposure": [9, 8, 7], "lines": 1, "chapters": [[1], [1, 2], [2]]})
    assert list(sequential.keep_pins(pins)["name"]) == ["a", "c"]  # b goes and so does not block c


def test_text_functions(spark):
    df = spark.createDataFrame([("Đức_Trí  x", "Book 12 of 3", "Vol. 7")], "a string, b string, c string")
    got = df.select(tx.fold(F.col("a")), tx.fold_all(F.col("a")), tx.identity_key(F.col("a")), tx.natural_key(F.col("b")), tx.volume_of(F.col("c")), tx.slug(F.col("a"))).first()
    assert tuple(got) == ("đuc_tri  x", "duc_tri  x", "đức trí x", "book 000000000012 of 000000000003", 7, "duc-tri-x")


def test_sources(spark, tmp_path):
    (tmp_path / "ch10.txt").write_bytes("Mười".encode("utf-16"))
    (tmp_path / "ch2.txt").write_bytes("hai".encode())
    (tmp_path / "p.html").write_text("<html><head><title>t</title></head><body><p>A &amp; B<p>C<script>x</script></body></html>")
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("META-INF/container.xml", '<c><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></c>')
        z.writestr("o/c.opf", '<package><manifest><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("o/a.xhtml", "<html><body><h1>One</h1><p>Text</p></body></html>")
    (tmp_path / "z.epub").write_bytes(buf.getvalue())
    got = books.read_books(spark, str(tmp_path)).orderBy("order_key").collect()
    texts = [(r["path"].rsplit("/")[-1], r["text"]) for r in got]
    assert texts == [("bad.epub", None), ("ch2.txt", "hai"), ("ch10.txt", "Mười"), ("p.html", "A & B\nC"), ("z.epub", "One\nText")]
    assert got[0]["error"]


def test_gold_lines(spark):
    df = spark.createDataFrame([("7 D,T An Lan,Minh~ joy,calm 1-3 slow loud f",), ("8 N",), ("# note",)], "line string")
    a, b, c = [r[0] for r in df.select(books.parse_gold(F.col("line"))).collect()]
    assert (a["seq"], a["kinds"], a["low"], a["high"], a["gender"]) == (7, ["D", "T"], 1, 3, "f")
    assert [tuple(s) for s in a["speakers"]] == [("An Lan", 1.0), ("Minh", 0.5)]
    assert b["kinds"] == ["narration"] and c is None


def test_shards_splits_manifest(spark, tmp_path):
    df = spark.createDataFrame([(str(i), f"w{i} x", "g%d" % (i % 2)) for i in range(40)], "k string, text string, g string")
    books.write_shards(df, "k", str(tmp_path / "s"))
    assert sorted(r["k"] for r in books.read_shards(spark, str(tmp_path / "s"), "k", ["3", "17"]).collect()) == ["17", "3"]
    m = books.manifest(df, "g")
    assert rows(m.select("g", "files", "words")) == [("g0", 20, 40), ("g1", 20, 40)]
    assert books.drift(m, m, "g").count() == 0
    assert rows(books.drift(m.where("g = 'g0'"), m, "g")) == [("g1", "new")]


def test_heading_split(spark):
    df = spark.createDataFrame([("intro\nChapter 1\na\nChương 2: x\nb",)], "text string")
    assert [r["part_text"] for r in books.split_on_headings(df).orderBy("part").collect()] == ["intro", "Chapter 1\na", "Chương 2: x\nb"]


def test_streaming_sessions_as_batch(spark, tmp_path):
    data = [(i, datetime(2024, 1, 1) + timedelta(minutes=m)) for i, m in [(1, 0), (1, 10), (1, 100), (2, 5), (2, 500)]]
    df = spark.createDataFrame(data, "user int, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = state.listening_sessions(stream, "ts", "user").writeStream.format("memory").queryName("sess").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert rows(spark.sql("select user, n from sess")) == [(1, 1), (1, 2), (2, 1), (2, 1)]
    assert rows(state.listening_sessions(df, "ts", "user").select("user", "n")) == rows(spark.sql("select user, n from sess"))
