"""Cries, numerals, order statistics, thresholds, axes and agreement on hand cases and by brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from versehall.functions import passages, readings, speech, text
from versehall.operators import chains, intervals, merge, ordering, ranking, scoring


def test_cries(spark):
    cases = {
        "Argh! Ugghh, grr... GRRH gr r": "Á! Á, Á... Á Á r",
        "haizz HAAAIZ haiz": "Hầy Hầy Hầy",
        "hm hmm hừmm Hừừm h": "Hừm Hừm Hừm Hừm h",
        "haha HAHAHA hihihihihihi ha": "Ha ha Ha ha ha Hi hi hi hi ha",
        "ha" * 8 + " " + "ha" * 9: "Ha ha ha ha " + "ha" * 9,
        "hahe hahah Ahaha": "hahe hahah Ahaha",
        "aaa AAAAAH ooo êêê aa": "A... a A... a O... o Ê... ê aa",
        "ÁAAAA áaaa Ôaaa Ồôôô ưưưư": "Á... a á... a Ôaaa Ồ... ô ư... ư",
        "xaaa aaa1 _aaa aaax": "xaaa aaa1 _aaa aaax",
        "[Sigh] he left [thở   dài] [CƯỜI] [other]": "Hầy... he left Hầy... Ha ha... [other]",
        "wait..... what....": "wait... what...",
        " “Ha…” ": " “Ha ha.” ",
        "ha...": "Ha ha.",
        "ha": "ha",
        "plain words, none of these": "plain words, none of these",
        "": "",
    }
    df = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string")
    got = dict(map(tuple, df.select("t", speech.spoken_cries(F.col("t")).alias("s")).collect()))
    assert got == cases | {None: None}


def test_numerals_in_text(spark):
    words = {"XIV": 14, "I": 1, "C": None, "mi": None, "Mi": None, "MIX": 1009, "IIII": None, "": None, "IX ": None, None: None}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert dict(map(tuple, df.select("w", readings.roman_numeral(F.col("w"))).collect())) == words


def test_order_statistics_of_uneven_values(spark, monkeypatch):
    """Values of all sizes, many ties and one far out, with intervals narrowed to a few rows."""
    monkeypatch.setattr(ordering, "FEW", 10)
    monkeypatch.setattr(ordering, "BINS", 16)
    rng = random.Random(1)
    groups = {
        "a": [rng.lognormvariate(0, 20) * rng.choice([1, -1]) for _ in range(700)],
        "b": [7.0] * 400 + [float(rng.randint(0, 5)) for _ in range(300)] + [1e308, -1e308],
        "c": [0.5], "d": [1e-300 * i for i in range(50)], None: [3.0, 1.0, 2.0],
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    targets = [(g, k) for g, vs in groups.items() for k in {0, 1, len(vs) // 3, len(vs) // 2, len(vs) - 1, len(vs), -1}]
    got = {(r.g, r.k): r.stat for r in ordering.order_statistics(df, ["g"], F.col("v"), spark.createDataFrame(targets, "g string, k long")).collect()}
    assert got == {(g, k): sorted(groups[g])[k] for g, k in targets if 0 <= k < len(groups[g])}
    shares = [0.0, 0.05, 0.5, 0.77, 1.0]
    for r in ordering.quantiles(df, ["g"], F.col("v"), shares).collect():
        assert r.quantile == pytest.approx(np.quantile(groups[r.g], r.share), rel=1e-9)
    assert ordering.quantiles(df.limit(0), [], F.col("v"), shares).count() == 0


def test_thresholds_keep_ties_and_small_classes(spark):
    rows = [("x", i, s) for i, s in enumerate([3.0, 2.0, 2.0, 1.0])] + [("y", 9, 1.0), (None, 10, 5.0), (None, 11, 4.0), ("x", 12, None)]
    df = spark.createDataFrame(rows, "c string, id long, s double")
    assert sorted(r.id for r in ordering.keep_by_threshold(df, ["c"], F.col("s"), 0.5).collect()) == [0, 1, 2, 9, 10]
    assert sorted(r.id for r in ordering.keep_by_threshold(df, ["c"], F.col("s"), 0.0).collect()) == [0, 9, 10]


def test_margins(spark):
    rows = [(1, "a", 0.5), (1, "b", 0.25), (1, None, 0.25), (2, None, 0.5), (2, "z", 0.5), (3, None, 1.0)]
    got = {r.k: (r.l, r.best, round(r.margin, 6)) for r in ordering.margins(spark.createDataFrame(rows, "k int, l string, p double"), ["k"], "l", "p").collect()}
    assert got == {1: ("a", 0.5, round(math.log(2), 6)), 2: ("z", 0.5, 0.0), 3: (None, 1.0, round(-math.log(1e-12), 6))}


GOLD = "id int, kinds array<string>, speakers array<struct<name:string,credit:double>>, emotions array<string>, paces array<string>, volumes array<string>, low int, high int, gender string"
ANSWER = "id int, kind string, speaker string, emotion string, intensity int, pace string, volume string, gender string"


def test_axes(spark):
    gold = [
        (1, ["dialogue"], [("ANN", 1.0), ("BO", 0.5)], ["sad"], ["slow"], ["loud"], 1, 2, "f"),
        (2, ["narration"], [("NARRATOR", 1.0)], ["neutral"], ["normal"], ["normal"], 0, 1, "u"),
        (3, ["narration"], [("NARRATOR", 1.0)], ["neutral"], ["normal"], ["normal"], 0, 1, "u"),
        (4, ["dialogue", "thought"], [("NPC*", 1.0)], ["glad", "calm"], ["normal"], ["normal"], 0, 3, "m"),
        (5, ["dialogue"], [("ANN", 1.0)], ["sad"], ["slow"], ["loud"], 1, 2, "f"),
    ]
    answers = [
        (1, "dialogue", "BO", "sad", 3, "slow", "soft", "female"), (2, "narration", "NARRATOR", "neutral", None, "normal", "normal", None),
        (3, "dialogue", "ANN", None, 1, "normal", "normal", "female"), (4, "thought", "NPC*", "calm", 0, "normal", None, "female"), (9, "dialogue", "X", "x", 0, "x", "x", "x"),
    ]
    s = scoring.weighted_score(scoring.axis_credits(spark.createDataFrame(gold, GOLD), spark.createDataFrame(answers, ANSWER), ["id"]))
    got = {r.axis: (r.earned, r.possible) for r in s.collect()}
    # the narration given to nobody is not asked, that given to ANN is wrong; the crowd's gender is not asked
    assert got == {"kind": (3.0, 4), "speaker": (1.5, 3), "emotion": (3.0, 4), "intensity": (3.0, 4), "pace": (4.0, 4), "volume": (2.0, 4), "gender": (1.0, 1)}
    assert s.agg(F.sum("weighted")).first()[0] == pytest.approx(10 * 0.75 + 45 * 0.5 + 15 * 0.75 + 10 * 0.75 + 5 + 5 * 0.5 + 10)


def test_agreement(spark):
    base = ["n", ["slow"], ["loud"], 0, 1, "u"]
    a = [(1, ["dialogue"], [("A", 1.0), ("B", 1.0)], ["sad", "calm"], *base[1:]), (2, ["narration"], [("N", 1.0)], ["calm"], *base[1:]), (3, ["dialogue", "thought"], [("A", 1.0), ("C", 0.5)], ["sad"], *base[1:])]
    b = [(1, ["dialogue"], [("B", 1.0), ("A", 1.0)], ["calm"], *base[1:]), (2, ["narration"], [("N", 1.0)], ["calm"], *base[1:]), (3, ["thought", "dialogue"], [("C", 1.0)], ["glad"], *base[1:]), (4, ["dialogue"], [("Z", 1.0)], ["sad"], *base[1:])]
    got = scoring.agreement(spark.createDataFrame(a, GOLD), spark.createDataFrame(b, GOLD), ["id"]).first().asDict()
    assert got == {"rows": 3, "spoken": 2, "speaker_preferred": 0.0, "speaker_compatible": 0.5, "kinds_same": 1.0, "emotion_preferred": 1 / 3, "emotion_overlap": 2 / 3}
    none = spark.createDataFrame([], GOLD)
    assert set(scoring.agreement(none, none, ["id"]).first()) == {0}


def test_recent_rate_and_age(spark):
    df = spark.createDataFrame([(float(t),) for t in [0, 100, *range(988, 1000)]], "t double").withColumn("now", F.lit(1000.0))
    assert tuple(intervals.recent_rate(df, F.col("t"), F.col("now"), 12, 12).first()) == (12, 0.2)  # twelve rows of twelve seconds count as a minute
    assert tuple(intervals.recent_rate(df, F.col("t"), F.col("now"), 900, 12).first()) == (13, round(13 / 900, 6))  # the edge is in
    assert tuple(intervals.recent_rate(df, F.col("t"), F.col("now"), 11, 12).first()) == (11, None)
    ahead = spark.createDataFrame([("k", 10)], "k string, at int")
    assert tuple(merge.stale(ahead, ["k"], F.col("at"), F.lit(8), 4).first()) == ("k", 0, False)


def test_ranks_of_any_type_and_group(spark):
    """Keys above 2**53, values beyond any packing, texts and nulls; groups that run over many ranges."""
    big = 1 << 53
    rows = [("g", big + 1, "b"), ("g", big, "a"), (None, None, None), ("g", None, "z"), (None, 5, "x"), ("h", -5_000_000, "q"), ("h", 2_000_000, "p")] + [("g", big + 2 + i, "c") for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v long, at string")
    got = ranking.ranked(df.repartition(7), [F.desc_nulls_last("v"), F.asc("at")], "place", ["g"])
    want = {}
    for g in {r[0] for r in rows}:
        for k, (_, v, at) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2])), 1):
            want[g, v, at] = k
    assert {(r.g, r.v, r["at"]): r.place for r in got.collect()} == want
    whole = ranking.ranked(df, [F.asc_nulls_last("v"), F.asc("g")], "place").orderBy("place").collect()
    assert [r.place for r in whole] == list(range(1, len(rows) + 1)) and [r.v for r in whole[3:5]] == [big, big + 1]
    assert ranking.ranked(df.limit(0), [F.asc("v")], "place", ["g"]).count() == 0


def packed(spark, rows, most):
    df = spark.createDataFrame(rows, "g string, i int, unit string, x binary")
    return {(r.g, r.i): r.batch for r in chains.pack_units(df.repartition(3), ["g"], ["i"], "unit", most).collect()}


def test_units_fill_batches_and_long_ones_are_cut(spark):
    runs = ["a", "a", "b", "b", "b", "c", "c", "c", "c", "c", "c", "c", "d", "a", None, None]
    got = packed(spark, [("g", i, u, b"x") for i, u in enumerate(runs)] + [(None, 0, "a", None)], 3)
    # aa | bbb | ccc ccc c | d a would fill 2, the nulls do not fit in
    assert [got["g", i] for i in range(16)] == [0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 5, 5, 6, 6] and got[None, 0] == 0
    rng = random.Random(4)
    rows = [(g, i, rng.choice("ab"), None) for g in "xyz" for i in range(200)]
    for most in (1, 2, 5):
        got, want = packed(spark, rows, most), {}
        for g in "xyz":
            units = [[k for k, *_ in list(run)] for _, run in itertools.groupby([(i, u) for h, i, u, _ in rows if h == g], key=lambda r: r[1])]
            batches, cur = [], []
            for unit in units:
                if len(unit) > most:
                    batches += [cur] * bool(cur) + [unit[k : k + most] for k in range(0, len(unit), most)]
                    cur = []
                    continue
                if cur and len(cur) + len(unit) > most:
                    batches.append(cur)
                    cur = []
                cur = cur + unit
            want |= {(g, i): n for n, b in enumerate(batches + [cur] * bool(cur)) for i in b}
        assert got == want


def test_nights(spark):
    schema = "k string, id string, started long, ended long, events array<int>, dismissed boolean, inc boolean"
    rows = [
        ("a", "n1", 5, None, [1], False, False), ("a", "n1", 6, 9, [1, 2], True, True), ("b", "n1", 7, 8, [1, 2], False, False), ("b", "n2", 7, None, [3], True, True),
        ("c", "n1", 1, None, None, None, False), ("c", "n2", 2, None, [], False, True), ("d", "n", 1, 3, [7], False, False), ("d", "n", 1, 4, [8], False, True),
    ]
    got = {r.k: (r.id, r.started, r.ended, r.events, r.dismissed) for r in merge.merge_nights(spark.createDataFrame(rows, schema), "k", F.col("inc")).collect()}
    assert got == {"a": ("n1", 6, 9, [1, 2], True), "b": ("n1", 7, 8, [1, 2], False), "c": ("n2", 2, None, [], False), "d": ("n", 1, 3, [7], False)}


def test_wish_sections(spark):
    df = lambda rows: spark.createDataFrame(rows, "book int, section string, item string, value string")
    ours = df([(1, "lines", "x", "mine"), (1, "lines", "y", "same"), (2, "lines", "x", "mine"), (2, "lines", "y", "mine")])
    theirs = df([(1, "lines", "x", "other"), (1, "lines", "y", "same"), (1, "voices", "z", "new"), (2, "lines", "x", "other"), (2, "lines", "z", "new"), (2, "voices", "v", "new"), (3, "free", "q", "new")])
    wishes, conflicts = merge.merge_wish_sections(ours, theirs, ["book"], {"lines": 2, "voices": 1})
    assert sorted(map(tuple, wishes.collect())) == [(1, "lines", "x", "mine"), (1, "lines", "y", "same"), (1, "voices", "z", "new"), (2, "lines", "x", "mine"), (2, "lines", "y", "mine"), (3, "free", "q", "new")]
    assert dict(map(tuple, conflicts.collect())) == {1: 1, 2: 0, 3: 0}  # the second book would hold three lines


def test_best_of_two(spark):
    df = spark.createDataFrame([("Đức Trí đi", "duc tri di"), ("one two", "one three"), ("", ""), (None, "x")], "a string, b string")
    got = [None if r[0] is None else (r[0]["similarity"], r[0]["wer"]) for r in df.select(passages.best_of_two(F.col("a"), F.col("b"))).collect()]
    assert got[0] == (1.0, 0.0) and got[1][1] == 0.5 and got[2] == (1.0, 0.0)
    names = spark.createDataFrame([("a10",), ("a9",), ("A2b",)], "n string").select("n", text.natural_key(F.col("n")).alias("k"))
    assert [r.n for r in names.orderBy("k").collect()] == ["A2b", "a9", "a10"]


def test_romanised_names(spark):
    names = {
        "Nippon": "Nip-pon", "Shimbun": "Shim-bun", "Shin'ichi": "Shin-i-chi", "Kin’yu": "Kin-yu", "Ryōta": "Ryo-ta", "Kyoto": "Kyo-to", "Matcha": "Mat-cha", "Zasshi": "Zas-shi", "Onna": "On-na",
        "Haruto-kun": "Ha-ru-to-kun", "Kimi-San": "Ki-mi-san", "san": "san", "Tanaka Ichiro": "Ta-na-ka I-chi-ro", "Aki-hito": "A-ki hi-to", "jun": "jun", "Tsunami": "Tsu-na-mi",
        "Smith": None, "Tokyoo!": None, "KEN": None, "keN": None, "Nn": None, "nka": None, "kka": None, "ti": None, "fa": None, "": None, "  ": None, "Ken-": None, None: None,
    }
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert dict(map(tuple, df.select("n", readings.romaji_syllables(F.col("n"))).collect())) == names
