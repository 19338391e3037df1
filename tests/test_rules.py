"""Contents of the queries without SQL against plain loops, and rules of texts on hand-made cases."""

import itertools
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from versehall.functions import passages, readings, speech
from versehall.functions import text as tx
from versehall.operators import entity, intervals, pages, ranking, select, sequential
from versehall.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()


def found(spark, name):
    return QUERIES[name](spark, SF).collect()


def by_user(tables):
    out = defaultdict(list)
    for r in sorted(tables("events"), key=lambda r: (r["ts"], r["event_id"])):
        out[r["user_id"]].append(r)
    return out


def pieces_of(spark, name):
    out = defaultdict(list)
    for r in sorted(found(spark, name), key=lambda r: r["pos"]):
        out[r["doc_id"]].append(r)
    return out


def test_packed_sentences(spark, tables):
    got = pieces_of(spark, "f14_pack_sentences")
    for d in tables("documents"):
        texts = [r["piece"] for r in got[d["doc_id"]]]
        assert " ".join(texts).split() == d["text"].split() and all(0 < len(t) <= 200 for t in texts)
        for a, b in zip(texts, texts[1:]):  # the next sentence would not have fitted
            first = re.split(r"(?<=[.!?…;:])\s+", b)[0]
            assert len(a) + 1 + len(first) > 200 or a[-1] not in ".!?…;:"


def test_split_clauses(spark, tables):
    got = pieces_of(spark, "f15_split_clauses")
    for d in tables("documents"):
        texts = [r["piece"] for r in got[d["doc_id"]]]
        assert "".join(texts) == d["text"] and all(len(t.strip()) <= 120 for t in texts)
    assert [len(x) for x in sequential.split_clauses("x" * 500)] == [120] * 4 + [20]
    assert sequential.split_clauses("aaaa bbbb, cccc dddd, e", 12) == ["aaaa bbbb, ", "cccc dddd, e"]
    assert sequential.split_clauses("one two three, " * 8 + "a tail", 120)[-1].strip().count("one") >= 1  # the tail was too short alone
    assert sequential.split_clauses(None) == [] and sequential.split_clauses("  ") == ["  "]


def test_cohesive_batches(spark):
    parts = defaultdict(list)
    for r in sorted(found(spark, "f16_segments"), key=lambda r: (r["doc_id"], r["pos"])):
        parts[r["doc_id"]].append(r)
    batch = {(r["doc_id"], r["pos"]): r["batch"] for r in found(spark, "e12_first_fit")}
    assert len(batch) == sum(map(len, parts.values()))
    for doc, rows in parts.items():
        open_, units = 0, []
        for i, r in enumerate(rows):
            if not i or (open_ <= 0 and r["paragraph"] != rows[i - 1]["paragraph"]):
                units.append([])
            units[-1].append(r)
            open_ += sum(r["piece"].count(c) for c in "“「«") - sum(r["piece"].count(c) for c in "”」»")
        size, last = 0, 0
        for u in units:
            n = sum(len(r["piece"]) for r in u)
            here = {batch[doc, r["pos"]] for r in u}
            assert len(here) == 1
            want = last if not size or size + n <= 1500 else last + 1
            size, last = (size + n if want == last else n), want
            assert here == {want}


def test_balanced_batches(spark, tables):
    got = {r["event_id"]: r["batch"] for r in found(spark, "e13_balanced")}
    for rows in by_user(tables).values():
        sums = defaultdict(list)
        for r in rows:
            sums[got[r["event_id"]]].append(r["value"])
        batches = [sums[i] for i in range(len(sums))]
        for a, b in zip(batches, batches[1:]):
            assert abs(sum(a) + b[0] - 250) > abs(sum(a) - 250)  # one more would have been further off
            for i in range(1, len(a)):
                assert sum(a[:i]) + a[i] - 250 <= 250 - sum(a[:i])


def test_largest_first_folds(spark, tables):
    size = defaultdict(int)
    for d in tables("documents"):
        size[d["lang"], d["source"]] += d["n_chars"]
    fold = {(r["lang"], r["source"]): r["fold"] for r in found(spark, "e14_lpt")}
    assert fold.keys() == size.keys()
    for lang in {x for x, _ in size}:
        load = [0] * 4
        for key in sorted((k for k in size if k[0] == lang), key=lambda k: (-size[k], k)):
            assert load[fold[key]] == min(load)
            load[fold[key]] += size[key]


def calm(n, s=6.3):
    return [(s, 0.3, -0.5, False)] * n


def battle(n, s=6.3):
    return [(s, -0.6, 0.8, False)] * n


def cut(lines):
    s = np.array([x[0] for x in lines])
    return sequential.scenes(np.cumsum(s) - s, s, np.array([x[1:3] for x in lines]), np.array([x[3] for x in lines]))


def test_scenes():
    two = cut(calm(22) + battle(26))  # some 150 seconds each
    assert max(two) == 1 and 20 <= two.index(1) <= 27  # where the mood begins to change, not where that is found out
    assert max(cut(calm(12) + [(2.0, -0.9, 0.9, False)] + calm(12))) == 0  # one outburst
    assert cut(calm(15) + [(6.3, 0.3, -0.5, True)] + calm(14)) == [0] * 15 + [1] * 15
    assert max(cut(calm(20) + [(1.0, 0.3, -0.5, True), (2.0, 0.3, -0.5, False)])) == 0  # a tiny end joins its neighbour
    long = cut(calm(100))  # 630 seconds of one mood
    assert max(long) == 3 and [long.count(i) for i in range(4)] == [25] * 4
    assert cut([]) == [] and cut(calm(1)) == [0]
    between = cut(calm(15) + [(5.0, -0.6, 0.8, True)] * 4 + [(6.3, -0.6, 0.8, True)] + battle(14))
    assert between[15:19] == [1] * 4  # short scenes go to the nearer mood


def test_scenes_of_events(spark, tables):
    got = {r["event_id"]: r["scene"] for r in found(spark, "e16_scenes")}
    for rows in by_user(tables).values():
        ids = [got[r["event_id"]] for r in rows]
        assert ids[0] == 0 and all(b - a in (0, 1) for a, b in zip(ids, ids[1:]))


def test_viterbi_and_alignment(spark):
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, labels = int(rng.integers(1, 7)), rng.integers(1, 4, int(rng.integers(1, 4))).tolist()
        logs = np.log(rng.dirichlet(np.ones(4), n))
        best = max((p for p in itertools.product(range(4), repeat=n) if [x for x, _ in itertools.groupby(p) if x] == labels), key=lambda p: sum(logs[t, x] for t, x in enumerate(p)), default=None)
        want, t = [], 0
        for x, g in itertools.groupby(best or ()):
            size = len(list(g))
            want += [(t, t + size - 1)] * bool(x)
            t += size
        assert readings.align(logs, labels) == (want if best else [(-1, -1)] * len(labels))
    rows = found(spark, "m8_alignment")
    for unit in {r["unit"] for r in rows}:
        own = sorted((r["pos"], r["label"], r["first"], r["last"]) for r in rows if r["unit"] == unit)
        assert [x[1] for x in own] == [1, 2, 2, 4] and all(a <= b for _, _, a, b in own) and all(a[3] < b[2] for a, b in zip(own, own[1:]))
    assert {r["label"] for r in found(spark, "m7_viterbi")} <= {0, 1}


def test_colours(spark, tables):
    near, sent = defaultdict(set), defaultdict(set)
    for r in tables("lineitem"):
        sent[r["l_orderkey"], r["l_suppkey"]].add(r["l_partkey"])
    for parts in sent.values():
        for a in parts:
            near[a] |= parts - {a}
    near = {a: b for a, b in near.items() if b}
    got = {r["l_partkey"]: r["colour"] for r in found(spark, "a26_colours")}
    assert got.keys() == near.keys() and max(got.values()) >= 1
    before = lambda a, b: (-len(near[b]), b) < (-len(near[a]), a)
    for a, c in got.items():
        taken = {got[b] for b in near[a] if before(a, b)}
        assert c not in taken and set(range(c)) <= taken


def scenes_of(spark, tables):
    nations, out = defaultdict(list), {}
    for r in tables("nation"):
        nations[r["n_regionkey"]].append(r["n_nationkey"])
    for user, rows in by_user(tables).items():
        out[user] = [(e, sorted((abs(e["value"] - t * 4), t) for t in nations[len(e["event_type"]) % 5])) for e in rows]
    return out


def test_tracks(spark, tables):
    plain = {(r["user_id"], r["scene"]): r["track"] for r in found(spark, "w11_tracks")}
    pinned = {(r["user_id"], r["scene"]): (r["track"], r["pinned"]) for r in found(spark, "e17_pinned_tracks")}
    for user, scenes in scenes_of(spark, tables).items():
        ban = {3, 7} if user % 7 == 0 else set()
        used, used2 = [], []
        for i, (e, costs) in enumerate(scenes, 1):
            pick = next((t for _, t in costs if t not in used[-3:]), costs[0][1])
            assert plain[user, i] == pick
            used += [pick] * (used[-1:] != [pick])
            free = [t for _, t in costs if t not in ban]
            pick = 0 if e["event_id"] % 50 == 0 else 7 if e["event_id"] % 20 == 0 and 7 not in ban else next((t for t in free if t not in used2[-3:]), free[0])
            assert pinned[user, i] == (pick, e["event_id"] % 50 == 0)
            used2 += [pick] * (used2[-1:] != [pick])


def test_voices_and_pins(spark, tables):
    months = defaultdict(set)
    lines = defaultdict(int)
    for o in tables("orders"):
        months[o["o_custkey"]].add(o["o_orderdate"].strftime("%Y-%m"))
        lines[o["o_custkey"]] += 1
    voices = defaultdict(list)
    for s in tables("supplier"):
        voices[s["s_nationkey"]].append(s["s_name"])
    got = {r["o_custkey"]: (r["nation"], r["voice"]) for r in found(spark, "e8_voices")}
    for nation in {n for n, _ in got.values()}:
        clash, load = defaultdict(list), defaultdict(int)
        for c in sorted((c for c in got if got[c][0] == nation), key=lambda c: (-lines[c], c)):
            cost = {v: (sum(m in clash[v] for m in ()) + sum(clash[v].count(m) for m in months[c]), load[v], v) for v in voices[nation]}
            assert cost[got[c][1]] == min(cost.values())
            clash[got[c][1]] += months[c]
            load[got[c][1]] += lines[c]
    kept = defaultdict(set)
    for r in found(spark, "e9_keep_pins"):
        kept[r["voice"]].add(r["name"])
    own = defaultdict(lambda: [0.0, 0, set()])
    for r in tables("lineitem"):
        x = own[r["l_suppkey"], str(r["l_partkey"])]
        x[0], x[1] = x[0] + r["l_quantity"], x[1] + 1
        x[2].add(r["l_shipdate"].strftime("%Y-%m"))
    for voice in {v for v, _ in own}:
        taken = set()
        for name in sorted((n for v, n in own if v == voice), key=lambda n: (-own[voice, n][0], -own[voice, n][1], n)):
            stays = not taken & own[voice, name][2]
            assert (name in kept[voice]) == stays
            taken |= own[voice, name][2] if stays else set()


def test_mentions(spark, tables):
    names = sorted(["the", "and the", "of the", "and", "des", "le", "und der", "der", "les"], key=lambda n: (-len(n), n))
    want = {(d["doc_id"], m.start(), m.end(), m.group()) for d in tables("documents") for m in re.finditer(r"(?<!\w)(?:" + "|".join(names) + r")(?!\w)", d["text"], re.I)}
    assert {tuple(r) for r in found(spark, "f34_mentions")} == want and len(want) > 100
    df = spark.createDataFrame([("Chu Mặc mặc áo. Mặc đi.", ["Mặc", "Chu Mặc"]), ("x", []), (None, ["x"])], "t string, a array<string>")
    got = [[tuple(s) for s in r[0] or ()] for r in df.select(passages.mention_spans(F.col("t"), F.col("a"), case=True)).collect()]
    assert got == [[(0, 7, "Chu Mặc"), (16, 19, "Mặc")], [], []]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_heard(spark, tables):
    turns = {(r["conv_id"], r["turn"]): r["text"] for r in tables("conversations")}
    got = found(spark, "f24_f29_heard")
    assert len(got) == sum((c, t + 1) in turns for c, t in turns)
    for r in got:
        a, b = turns[r["conv_id"], r["turn"]], turns[r["conv_id"], r["turn"] + 1]
        n, m, alike = len(a.split()), len(b.split()), max(0.0, 1 - edits(a, b) / max(1, len(a)))
        assert r["edits"] == edits(a.split(), b.split()) and r["wer"] == pytest.approx(r["edits"] / max(1, n), abs=1e-6)
        assert r["severe"] == (n > 0 and (m == 0 or alike < 0.35 and (m >= max(n + 4, 3 * n) or abs(m - n) <= 4)))
        assert r["too_fast"] == (m > max(4, r["turn"] * 10 + 2) and r["turn"] > 0)
        assert r["accepted"] == (alike >= 0.2 and not (r["wer"] > 0.9 and alike < 0.32))


#: text, duration, timed pieces, word times
TIMED = [
    ("HÀ NỘI", 800, [("hà", 0, 300), ("nội", 300, 700)], [(0, 300), (300, 700)]),
    ("và và và", 2000, [("và", 1000, 1300, 4)], [(0, 1000), (1000, 1300), (1300, 2000)]),
    ("ab cd", 1200, [("ab", 0, 500), ("cd", 500, 1500)], [(0, 500), (500, 1200)]),
    ("Xin chào — các bạn.", 2000, [("Xin", 0, 400), ("chào", 400, 900), ("các", 1000, 1300), ("bạn", 1300, 1900)], [(0, 400), (400, 900), (900, 1000), (1000, 1300), (1300, 1900)]),
    ("Một hai ba", 1000, [], [(0, 375), (375, 750), (750, 1000)]),
    ("", 500, [("x", 0, 10)], []),
]


def test_word_times(spark, tables):
    for text, ms, pieces, want in TIMED:
        assert readings.map_words(text, ms, pieces) == want
    lines = {r["conv_id"] * 100 + r["turn"]: r["text"].split() for r in tables("conversations")}
    got = defaultdict(list)
    for r in sorted(found(spark, "f35_word_times"), key=lambda r: r["pos"]):
        got[r["line"]].append((r["start_ms"], r["end_ms"]))
    for line, words in lines.items():
        times = got[line]
        assert len(times) == len(words) and all(0 <= a <= b <= 300 * len(words) for a, b in times)
        assert all(a[1] <= b[0] for a, b in zip(times, times[1:]))


def test_numbers(spark):
    want = {0: "không", 4: "bốn", 14: "mười bốn", 24: "hai mươi tư", 21: "hai mươi mốt", 15: "mười lăm", 105: "một trăm lẻ năm", 1005: "một nghìn không trăm lẻ năm", 2024: "hai nghìn không trăm hai mươi tư", 1_000_000: "một triệu", 10**12 - 1: None, -1: None, 10**12: None}
    got = dict(map(tuple, spark.createDataFrame([(n,) for n in want], "n long").select("n", readings.number_words(F.col("n"))).collect()))
    assert all(got[n] == w for n, w in want.items() if n != 10**12 - 1) and got[10**12 - 1].endswith("chín")
    roman = spark.createDataFrame([("XIV",), ("mcmxcix",), ("iiii",), ("",), (None,), ("lx",)], "r string").select(readings.roman_value(F.col("r"))).collect()
    assert [r[0] for r in roman] == [14, 1999, None, None, None, 60]


def test_wrapped_lines(spark):
    df = spark.createDataFrame([("a long\nline.\nNext soft\u00ad\nhyphen,\nwent on:\nso\n- Speech\nmore",), (None,)], "t string")
    got = [r[0] for r in df.select(passages.join_wrapped(F.col("t"))).collect()]
    assert got == ["a long line.\nNext softhyphen, went on:\nso\n- Speech more", None]


def test_thin_chains(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 4.0), ("a", 8.0), ("a", 12.0), ("a", 40.0), ("b", 1.0), ("b", None), (None, 3.0), (None, 4.0)], "k string, s double")
    got = sorted(map(tuple, intervals.thin(df, ["k"], F.col("s"), [], 5).collect()), key=str)
    assert got == sorted([("a", 0.0), ("a", 8.0), ("a", 40.0), ("b", 1.0), ("b", None), (None, 3.0)], key=str)
    assert intervals.thin(df.limit(0), ["k"], F.col("s"), [], 5).count() == 0


def test_marks(spark):
    names = spark.createDataFrame([("Làn My", 9), ("Lán Mỹ", 3), ("Lan My", 1), ("MÁ", 2), ("MÀ", 5)], "name string, lines int")
    assert dict(map(tuple, entity.dropped_marks(names).collect())) == {"Lan My": "Lán Mỹ"}
    one = names.limit(1).select(tx.accents(F.lit("Đức ế")).alias("m")).first()["m"]
    assert len(one) == 5 and {x.split(":")[0] for x in one} == {"0", "1", "4"}


def test_ranks_with_ties_and_nulls(spark):
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 11 == 0 else 7.0 if i % 3 == 0 else float(rng.integers(0, 40))) for i in range(900)]
    df = spark.createDataFrame(rows, "i long, v double").repartition(5)
    for down in (False, True):
        got = {r["i"]: r["place"] for r in ranking.global_rank(df, "v", "i", "place", down, cuts=16).collect()}
        order = sorted(rows, key=lambda r: (r[1] is None, (-r[1] if down else r[1]) if r[1] is not None else 0, r[0]))
        assert [got[i] for i, _ in order] == list(range(1, 901))
    assert ranking.global_rank(df.limit(0), "v", "i", "place").count() == 0


def test_grid_search_with_fine_cells(spark):
    rng = np.random.default_rng(5)
    pts = [(i, *(float(x) for x in np.clip(rng.normal(0, 0.5, 2), -1.5, 1.5))) for i in range(600)] + [(1000 + i, 0.25, 0.25) for i in range(60)] + [(2000, None, 1.0)]
    df = spark.createDataFrame(pts, "k long, x double, y double")
    got = defaultdict(list)
    for r in select.nearest_in_grid(df, "k", ("x", "y"), (25.0, 50.0), 6.0, 3, per_cell=4).collect():
        got[r["k"]].append((r["rank"], r["near"], round(r["d"], 9)))
    cell = lambda v: min(4, max(0, int(np.floor((v + 1) / 2 * 5))))
    for k, x, y in pts[::7]:
        near = [] if x is None else sorted((round(float(np.sqrt(25 * (x - a) ** 2 + 50 * (y - b) ** 2)), 9), j) for j, a, b in pts if j != k and a is not None and abs(cell(x) - cell(a)) <= 1 and abs(cell(y) - cell(b)) <= 1)
        assert sorted(got[k]) == [(n + 1, j, d) for n, (d, j) in enumerate([p for p in near if p[0] < 6][:3])]


def test_running_heads(spark):
    texts = {i: f"My Book {i}\nChapter {i}\nfirst {'abcde'[i] * 3}\n\nlast {'vwxyz'[i] * 3}\n{i}" for i in range(5)}
    texts[5] = "other\nbody"
    df = spark.createDataFrame([("b", i, t) for i, t in texts.items()], "b string, p int, t string")
    got = {r["p"]: (r["t"], r["dropped"]) for r in pages.drop_running_lines(df, "b", "p", "t").collect()}
    assert got == {i: (t.split("\n", 1)[1].rsplit("\n", 1)[0], 2) if i < 5 else (t, 0) for i, t in texts.items()}
    few = {r["p"]: r["dropped"] for r in pages.drop_running_lines(df.where("p < 2"), "b", "p", "t").collect()}
    assert few == {0: 1, 1: 1}  # two pages show no running head, but page numbers


def test_anchors(spark):
    """Against all alignments, and a name's form that must leave a plain word alone."""
    rng = np.random.default_rng(8)

    def every(units, heard):
        if not units and not heard:
            yield (0, 0, 0, 0)
        if heard:
            yield from ((a + 1, b, c, d + 1) for a, b, c, d in every(units, heard[1:]))
        if units:
            u = units[0]
            yield from ((a + 1, b, c, d + 1) for a, b, c, d in every(units[1:], heard))
            if heard:
                same = u == heard[0]
                yield from ((a + (not same), b - same, c, d) for a, b, c, d in every(units[1:], heard[1:]))
            for f in u if not isinstance(u, str) else ():
                if heard[: len(f)] == f:
                    yield from ((a, b, c - 1, d) for a, b, c, d in every(units[1:], heard[len(f) :]))

    for _ in range(60):
        word = lambda: "xyz"[rng.integers(0, 3)]
        units = [word() if rng.random() < 0.7 else [[word()], [word(), word()]] for _ in range(rng.integers(0, 5))]
        heard = [word() for _ in range(rng.integers(0, 5))]
        cost, steps = readings.anchored(units, heard)
        assert cost == min(every(units, heard))
        assert [u for _, u, _, _ in steps if u >= 0] == list(range(len(units)))
    assert [k for k, *_ in readings.anchored([[["an"]], "an"], ["an"])[1]] == ["drop", "match"]
    rows = found(spark, "f30_anchors")
    assert {r["kind"] for r in rows} <= {"match", "swap", "name", "drop", "put"} and any(r["kind"] == "name" for r in rows)


def test_spoken_symbols(spark):
    cases = {
        "Thường (Common) (C) » Hiếm": "Thường, Common, C, Hiếm", "↓ 1.000 Đơn vị": "giảm 1.000 đơn vị".replace("đ", "Đ"), "Lửa => Băng": "Lửa, Băng", "=> Băng": "Băng", "8.5/10 điểm": "8.5/10 điểm",
        "Mạnh / khó": "Mạnh, khó", "Cái #&!@! gì": "Cái … gì".replace(" …", "…"), "[thở dài] Ừ [A-rank].": "[thở dài] Ừ, A-rank.", "(Legendary)": "Legendary", "a + b = c": "a cộng b bằng c", "• mục": "mục", "!!! ***": "!!!",
    }
    df = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string").select("t", speech.spoken_symbols(F.col("t")).alias("s"))
    got = dict(map(tuple, df.collect()))
    assert {t: got[t] for t in cases} == cases and got[None] is None
    again = dict(map(tuple, df.select("s", speech.spoken_symbols(F.col("s"))).collect()))
    assert all(a == b for a, b in again.items())  # stable on its own output
    docs = {r["doc_id"]: r["said"] for r in QUERIES["f2_spoken_symbols"](spark, SF).collect()}
    assert len(docs) == 200 and all(not re.search(r"[()\[\]↓»|]", x) for x in docs.values())
