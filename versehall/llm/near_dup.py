"""Near-duplicate groups by MinHash with tensored banding.

Two collections of `keys` short minhash keys each are computed per document; the key of table
(i, j) is the pair of key i of the first collection and key j of the second. keys**2 tables thus
cost 2 * keys * rows minhashes instead of keys**2 * 2 * rows. A pair of similarity J meets in some
table with probability (1 - (1 - J**rows)**keys)**2, 0.99998 at J = 0.85 for the defaults.

Every link is confirmed on the full shingle sets. Buckets are not expanded into all pairs:
documents with equal sets are one node; in a bucket every node is first held against the bucket's
smallest node; then, where a bucket still holds several components, nodes of different components
are compared in blocks by a sketch of SKETCH minhash bytes, each pair in the first bucket it shares,
and only pairs whose estimate is within MARGIN of the threshold (over four standard errors) are
confirmed. So the components are those of
all colliding pairs, while a bucket that one group of copies fills costs one pair a member. Copies
of one set take their set's component at the end and are no links.

A leader of a large group is a hot key, and so is a large bucket or a set with many copies. What such
keys are joined with is staged first and the joins are merge joins, so that both sides are plain
shuffles, which adaptive execution splits where a key is skewed; texts and confirmations of a hot
leader are dealt out in parts of MEMBERS pairs.

Defined cases: null or blank texts have an empty set and link with nothing; fewer words than a
shingle make one shingle of the whole sequence; rows with a null doc_id link with nothing
(component null, kept); rows that repeat a doc_id are one document; an empty table gives an empty
result; other columns play no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versehall.llm.common import components, in_arrow, stage

SHINGLE = 5
KEYS, ROWS = 12, 3  # keys of each collection, minhashes of each key
SKETCH, MARGIN = 256, 0.10
MEMBERS = 256  # nodes held against one leader in one group
BLOCK = 1024  # nodes of a bucket compared with as many others in one group
SEED = 20240611
KNOWN_WORDS = 200_000


class _WordHashes(dict):
    """Word -> 64-bit hash, filled on demand."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def _stir(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text; A-Z are lower-cased."""
    # bytes.lower() changes A-Z only and bytes.split() cuts at \x20 and \x09-\x0D only
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    return np.unique(_stir(out))


_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _RNG.integers(0, 1 << 32, SKETCH, dtype=np.uint32)


def minhashes(s: np.ndarray) -> np.ndarray:
    """SKETCH minima of a non-empty set under linear maps of its hashes' upper halves."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        y = np.multiply.outer(_FACTORS, x[i : i + 1024])
        y += _OFFSETS[:, None]
        np.minimum(low, y.min(1), out=low)
    return low


def tensor_keys(low: np.ndarray, keys: int = KEYS, rows: int = ROWS) -> np.ndarray:
    """2 * keys keys, each of its place and `rows` minhashes of its own."""
    out = np.arange(1, 2 * keys + 1, dtype=np.uint64)
    for part in low[: 2 * keys * rows].reshape(2 * keys, rows).T:
        out = _stir(out * np.uint64(0x9E3779B97F4A7C15) + part)
    return out.view(np.int64)


def signatures(docs: DataFrame, keys: int = KEYS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, n_shingles, set_hi and set_lo (the set's identity), keys, sketch."""
    if 2 * keys * rows > SKETCH:
        raise ValueError(f"{keys} keys of {rows} minhashes need more than {SKETCH}")

    def run(part: dict) -> dict:
        out: dict = {"doc_id": part["doc_id"], "n_shingles": [], "set_hi": [], "set_lo": [], "keys": [], "sketch": []}
        for text in part["text"]:
            s = shingles(text)
            both = xxhash.xxh3_128_intdigest(s.tobytes())
            out["n_shingles"].append(len(s))
            out["set_hi"].append((both >> 64) - (1 << 63))
            out["set_lo"].append((both & ((1 << 64) - 1)) - (1 << 63))
            low = minhashes(s) if len(s) else None
            out["keys"].append([] if low is None else tensor_keys(low, keys, rows))
            # after the sketch itself 32 bits of each key, by which a pair finds its first bucket
            out["sketch"].append(b"" if low is None else low.astype(np.uint8).tobytes() + out["keys"][-1].astype(np.uint32).tobytes())
        return out

    schema = "doc_id long, n_shingles long, set_hi long, set_lo long, keys array<long>, sketch binary"
    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def bucket_members(nodes: DataFrame, keys: int = KEYS) -> DataFrame:
    """(bucket, table, node, n) of the tables' buckets. Keys that no other node has are dropped before
    the pairs of keys are formed."""
    single = nodes.select("node", "n", F.posexplode("keys").alias("place", "key"))
    shared = single.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    lists = single.join(shared, "key").groupBy("node", "n")
    half = lambda c: F.collect_list(F.when(c, F.struct("key", "place")))
    lists = lists.agg(half(F.col("place") < keys).alias("a"), half(F.col("place") >= keys).alias("b"))
    rows = lists.select("node", "n", "b", F.explode("a").alias("x")).select("node", "n", "x", F.explode("b").alias("y"))
    table = (F.col("x.place") * keys + F.col("y.place") - keys).cast("short").alias("table")
    return stage(rows.select(F.xxhash64("x.key", "y.key").alias("bucket"), table, "node", "n"), "buckets")


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows of sketches may belong to sets of the similarity."""
    return (a == b).mean(1) >= percent / 100 - MARGIN


def likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (x, y) whose sketches (node, sketch) come near the similarity."""

    def run(part: dict) -> dict:
        a, b = (np.frombuffer(b"".join(x[:SKETCH] for x in part[k]), np.uint8).reshape(-1, SKETCH) for k in ("s", "t"))
        ok = np.flatnonzero(_alike(a, b, percent))
        return {k: [part[k][i] for i in ok] for k in ("x", "y")}

    both = pairs.join(sketches.select(F.col("node").alias("x"), F.col("sketch").alias("s")).hint("merge"), "x")
    both = both.join(sketches.select(F.col("node").alias("y"), F.col("sketch").alias("t")).hint("merge"), "y")
    return in_arrow(both.select("x", "y", "s", "t"), run, "x long, y long", max_rows=8192)


def across(own: DataFrame, percent: int, keys: int = KEYS) -> DataFrame:
    """Likely pairs (x, y) of different components within buckets, from rows (bucket, table, node,
    n, c, sketch); a pair comes once, from the first table in which it meets. Buckets are cut into
    blocks of some BLOCK nodes and every pair of blocks is one group, so no group grows with its
    bucket."""
    parts = stage(own.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "blocks")
    rows = own.join(parts.hint("merge"), "bucket").withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(F.xxhash64("bucket", F.least("p", "q"), F.greatest("p", "q")).alias("g"), (F.col("p") > F.col("q")).alias("side"), (F.col("p") == F.col("q")).alias("one"), "table", "node", "n", "c", "sketch")
    # a group is read as a run of equal g in a sorted stream: far cheaper than a call for each
    rows = rows.repartition("g").sortWithinPartitions("g")
    out = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def pairs(t: pa.Table) -> tuple[list, list]:
        g, table, node, n, c = (t.column(k).to_numpy() for k in ("g", "table", "node", "n", "c"))
        side, one = (t.column(k).to_numpy(zero_copy_only=False) for k in ("side", "one"))
        every = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(g), -1)
        sketch, both = every[:, :SKETCH], np.ascontiguousarray(every[:, SKETCH:]).view(np.uint32)
        xs, ys = [], []
        cuts = np.flatnonzero(np.diff(g)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(g)]):
            if b - a < 2 or (c[a:b] == c[a]).all():
                continue
            ok = (c[a:b, None] != c[None, a:b]) & (node[a:b, None] < node[None, a:b])
            ok &= np.minimum(n[a:b, None], n[None, a:b]) * 100 >= percent * np.maximum(n[a:b, None], n[None, a:b])
            ok &= one[a:b, None] | (side[a:b, None] != side[None, a:b])
            i, j = np.nonzero(ok)
            for k in range(0, len(i), 8192):
                ik, jk = i[k : k + 8192] + a, j[k : k + 8192] + a
                same = both[ik] == both[jk]
                first = same[:, :keys].argmax(1) * keys + same[:, keys:].argmax(1)
                ik, jk = ik[first == table[a]], jk[first == table[a]]
                near = _alike(sketch[ik], sketch[jk], percent)
                xs.append(node[ik[near]])
                ys.append(node[jk[near]])
        return xs, ys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                if batch.num_rows == 0 or batch.column(0)[0] == batch.column(0)[-1]:
                    continue
            if not held:
                continue
            t = pa.Table.from_batches(held)
            g = t.column("g").to_numpy()
            end = len(g) if batch is None else int(np.flatnonzero(g != g[-1])[-1]) + 1  # the last group may go on
            xs, ys = pairs(t.slice(0, end)) if end else ([], [])
            held = t.slice(end).to_batches()
            if xs:
                yield pa.RecordBatch.from_arrays([np.concatenate(xs), np.concatenate(ys)], schema=out)

    return rows.mapInArrow(run, "x long, y long")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (x, y) whose full sets reach the similarity: (a, b).

    `texts` (node, text) goes to the pairs' y, and to each x once for every MEMBERS of its y."""
    sizes = stage(pairs.groupBy("x").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")), "leaders")
    left = pairs.join(sizes.hint("merge"), "x").select("x", "y", F.pmod(F.xxhash64("y"), F.col("parts")).cast("int").alias("part"))
    left = left.join(texts.withColumnRenamed("node", "y"), "y").select("x", "part", "y", "text")
    right = sizes.join(texts.withColumnRenamed("node", "x"), "x").select("x", "text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = right.select([F.col(c).alias(c) for c in right.columns])  # columns of its own, or the two sides are ambiguous

    def run(ys: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for x, text in zip(xs["x"], xs["text"]):
            s = shingles(text)
            for y, other in zip(ys["y"], ys["text"]):
                t = shingles(other)
                if min(len(s), len(t)) * 100 < percent * max(len(s), len(t)) or not len(t):
                    continue
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    a.append(x)
                    b.append(y)
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return left.groupBy("x", "part").cogroup(right.groupBy("x", "part")).applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, keys: int = KEYS, rows: int = ROWS) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id (the smallest doc_id reachable over
    links of at least `percent` % similarity), kept."""
    sig = stage(signatures(docs, keys, rows), "signatures")
    full = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = full.groupBy("set_hi", "set_lo", "n_shingles", "keys", "sketch").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    nodes = stage(nodes.withColumnRenamed("n_shingles", "n"), "nodes")
    members = bucket_members(nodes, keys)
    near = f"least(n, m) * 100 >= {percent} * greatest(n, m)"
    leaders = members.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("l"), F.max("node").alias("top")).where("top > l.node")
    leaders = stage(leaders.select("bucket", F.col("l.node").alias("x"), F.col("l.n").alias("m")), "leaders")
    first = members.join(leaders.hint("merge"), "bucket")
    first = first.where(f"node <> x AND {near}").select("x", F.col("node").alias("y")).distinct()
    sketches = stage(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "sketch"), "sketches")
    first = stage(likely(first, sketches, percent), "pairs")
    # the texts of colliding nodes; a merge join at any size, so that its cost stays in proportion
    plain = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    texts = stage(plain.join(members.select("node").distinct().hint("merge"), "node"), "texts")
    links = stage(confirm(first, texts, percent), "links")
    label = components(links).withColumnRenamed("component", "c")
    # what is left: colliding nodes of different components
    own = members.join(label, "node", "left").select("bucket", "table", "node", "n", F.coalesce("c", "node").alias("c"))
    mixed = own.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("bucket")
    own = stage(own.join(stage(mixed, "mixed").hint("merge"), "bucket"), "mixed").join(sketches, "node")
    rest = stage(across(own, percent, keys).join(first, ["x", "y"], "left_anti"), "pairs")
    links = links.union(stage(confirm(rest, texts, percent), "links"))
    # a doc_id with several texts stands for all their sets
    ids = sig.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("set_hi", "set_lo")).alias("a"), F.max(F.struct("set_hi", "set_lo")).alias("b"))
    ids = stage(ids.where("a <> b").select("doc_id"), "repeated")
    several = not ids.isEmpty()
    if several:
        sets = full.join(ids, "doc_id", "left_semi").select("doc_id", "set_hi", "set_lo").join(nodes, ["set_hi", "set_lo"])
        links = links.union(sets.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    label = stage(components(links), "components")
    # every set with copies or links has a component, and every row takes its set's
    sets = nodes.join(label, "node", "left").where("copies > 1 OR component IS NOT NULL")
    sets = stage(sets.select("set_hi", "set_lo", F.coalesce("component", "node").alias("component")), "sets")
    alone = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id"))
    out = sig.select("doc_id", "n_shingles", "set_hi", "set_lo").join(sets.hint("merge"), ["set_hi", "set_lo"], "left")
    if several:
        mine = ids.join(label.withColumnRenamed("node", "doc_id"), "doc_id").select("doc_id", F.col("component").alias("mine"))
        out = out.join(mine, "doc_id", "left")
        alone = F.coalesce("mine", alone)
    out = out.select("doc_id", "n_shingles", F.coalesce(alone, F.when(F.col("doc_id").isNotNull(), F.col("component")), "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
