"""Runs with gathered traits, learned chains, components, voices and epithets on hand tables and by brute force."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from versehall.operators import chains, dialogue, graph, names


def islands(spark, rows, gap=5):
    df = spark.createDataFrame(rows, "who string, a long, z long, id long, sex array<string>, age array<string>")
    got = chains.trait_islands(df, ["who"], "a", "z", "id", ["sex", "age"], gap)
    return {r.id: r.canonical for r in got.collect()}


def test_islands_gather_traits(spark):
    rows = [
        ("x", 1, 1, 1, [], None), ("x", 3, 3, 2, ["m"], []), ("x", 5, 5, 3, [], ["old"]), ("x", 7, 7, 4, ["f"], []),  # 4 contradicts what 2 brought
        ("x", 9, 20, 5, [], ["young"]), ("x", 11, 11, 6, [], []), ("x", 22, 22, 7, ["f", None], ["young", "old"]), ("x", 28, 28, 8, ["f"], ["old"]),
        ("y", 1, 1, 9, ["m"], []), (None, 2, 2, 10, [], []), (None, 4, 4, 11, ["m"], []),
    ]
    got = islands(spark, rows)
    # 6 begins before 5 ends, so an island begins there; 7 is too far from 6; 8 is just too far from 7
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10, 11: 10}
    assert islands(spark, rows, gap=6)[8] == 7
    assert islands(spark, []) == {}


def test_islands_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice("xyz"), a := rng.randint(0, 300), a + rng.randint(0, 4), i, rng.choice([[], ["m"], ["f"], ["m", "f"]]), rng.choice([[], [], ["old"], ["young"]])) for i in range(300)]
    want, state = {}, {}
    for who, a, z, i, sex, age in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        known = state.get(who)
        if known and 0 < a - known[0] <= 5 and all(not p or not q or p & q for p, q in zip(known[1], (set(sex), set(age)))):
            state[who] = (max(known[0], z), [p | q for p, q in zip(known[1], (set(sex), set(age)))], known[2])
        else:
            state[who] = (z, [set(sex), set(age)], i)
        want[i] = state[who][2]
    assert islands(spark, rows) == want


def test_transitions_by_relation(spark):
    df = spark.createDataFrame([("c", i, x, r) for i, (x, r) in enumerate([("a", None), ("a", "p"), ("b", "p"), ("a", "q"), (None, "q"), (None, "p"), ("b", None)])], "k string, i int, x string, r string")
    got = {(r.relation, r.pattern): (r.n, round(r.share, 6)) for r in chains.learn_transitions(df, ["k"], ["i"], F.col("x"), F.col("r")).collect()}
    assert got == {("p", "same"): (1, round(2 / 6, 6)), ("p", "back"): (0, round(1 / 6, 6)), ("p", "other"): (2, 0.5), ("q", "same"): (0, 0.2), ("q", "back"): (1, 0.4), ("q", "other"): (1, 0.4)}


def every_chain(scores, steps):
    def total(path):
        out = scores[0][path[0]]
        for t in range(1, len(path)):
            p = 0 if path[t] == path[t - 1] else 1 if t > 1 and path[t] == path[t - 2] else 2
            out += steps[t][p] + scores[t][path[t]]
        return out

    return max(itertools.product(range(scores.shape[1]), repeat=len(scores)), key=lambda p: round(total(p), 9))


def test_decoding_against_all_chains(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 6):
        scores, steps = np.log(rng.dirichlet([1] * 3, n)), np.log(rng.dirichlet([1] * 3, n))
        assert tuple(chains.best_chain(scores, steps)) == every_chain(scores, steps)
    table = spark.createDataFrame([("p", "same", 0.8), ("p", "back", 0.1), ("p", "other", 0.1)], "relation string, pattern string, share double")
    rows = [("u", i, i, [math.log(x), math.log(1 - x)], "p" if i < 3 else "never seen") for i, x in enumerate([0.9, 0.4, 0.45, 0.1])]
    df = spark.createDataFrame(rows, "u string, s int, id int, l array<double>, r string")
    got = chains.decode_chains(df, ["u"], ["s"], "id", F.col("l"), F.col("r"), table)
    assert [r.choice for r in got.orderBy("id").collect()] == [0, 0, 0, 1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1040)] + [(5000, 5000), (7, None)] + [(3000, 2000), (2000, 3000), (2999, 3000)]
    random.Random(3).shuffle(edges)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1040)} | {5000: 5000, 2000: 2000, 3000: 2000, 2999: 2000}
    assert got == want
    rng = random.Random(4)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)]
    root = {v: v for p in pairs for v in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = graph.components(spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string")).collect()
    groups = lambda m: {frozenset(k for k in m if m[k] == c) for c in set(m.values())}
    assert groups({int(r.node): r.component for r in got}) == groups(root)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_voices_joined_over_other_lines(spark):
    t = [("x", 1, "a"), ("x", 1, "b"), ("x", 2, "b"), ("x", 3, "c"), ("x", 4, "c"), ("x", 4, "d"), ("y", 1, "a"), ("y", 2, "a"), ("y", 3, None)]
    got = dialogue.split_labels(spark.createDataFrame(t, "label string, line int, term string"), "label", "line", "term")
    assert [tuple(r) for r in got.collect()] == [("x", 2, 2)]


def links(spark, texts, labels, between=()):
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    got = names.epithet_links(docs, "t", spark.createDataFrame([(x,) for x in labels], "l string"), "l", between)
    return {(r.epithet, r.name): r.n for r in got.collect()}


def test_epithets_beside_names(spark):
    labels = ["Krai", "Thousand Tricks", "Tino Shade", "Sir", None, "!"]
    assert links(spark, ["The Thousand Tricks Krai came. KRAI Thousand Tricks!"], labels) == {("Thousand Tricks", "Krai"): 2, ("Krai", "Thousand Tricks"): 2}
    # a comma, a line end or two spaces part two people
    assert links(spark, ["Krai, Thousand Tricks", "Krai\nThousand Tricks", "Krai  Thousand Tricks", None, ""], labels) == {}
    # first and last words stand for a name, but not for an epithet, and must have three letters
    assert links(spark, ["Sir Tino met shade krai"], labels) == {("Sir", "Tino Shade"): 1, ("Krai", "Tino Shade"): 1}
    assert links(spark, ["Krai called the Thousand Tricks; Krai called Thousand Tricks"], labels, ["called", "called  THE"]) == {("Thousand Tricks", "Krai"): 2}
    # labels of which one holds the other, or that share a word
    assert links(spark, ["Tino Tino Shade", "Shade Tino"], ["Tino", "Tino Shade"]) == {}
    assert links(spark, ["Tino Shade Shade Hall"], ["Tino Shade", "Shade Hall"]) == {}
    # accents and case do not count, words do
    assert links(spark, ["Thiên Biến KRÂI; Thiên Biếnn Krai"], ["Krai", "thien bien"]) == {("thien bien", "Krai"): 1, ("Krai", "thien bien"): 1}
    assert links(spark, ["a b"], []) == {}
