"""Approximate nearest neighbours by inner product: inverted lists and an adaptive dimension scan.

Vectors are lifted by one coordinate to equal length (so that the largest inner product is the
smallest distance) and turned by a random rotation, which spreads a distance evenly over the
dimensions. Every row is put on the list of its nearest centroid. Within a probed list squared
differences are added one column block after the other; after each block the partial distance is
tested against the bound, the distance of the k-th best so far, and candidates that with high
confidence are further away are abandoned: of a distance of `width` turned columns, `seen` of them
hold a share that follows a Beta distribution. Rows that no query follows any more, and queries that follow none, are dropped from the
blocks to come. A query's bound starts as its k-th best of the sample and goes from list to list.
Survivors are scored by the exact inner product in double precision. Results come from the scan
alone; a query for which the probed lists held fewer than k is sent to all lists, with no bound to start from.
Equal vectors are searched once.

The sample of at most SAMPLE vectors (a quarter of all, from LEAST_SAMPLE on), chosen by hash, is the documented bound of what reaches the
driver; it gives the centroids and the number of probed lists, the smallest that finds `recall` of
the sample's own neighbours. There is a list for every LIST_ROWS rows; where the sample is too small
for so many, its centroids are cut further, each by the vectors near it, in Spark, on at most some FINE_SAMPLE
vectors a centroid and up to MOST_LISTS lists. Every row is indexed. Lists are packed into chunks of
some CHUNK rows, larger ones are cut, and the queries of a chunk are cut too, so no task grows with
a popular list; a query goes once to a chunk, with the lists it probes there.

Defined cases: rows null, zero or holding null or non-finite components take no part; shorter
vectors count as zero in the dimensions they lack; rows that repeat id and vector count once; ties go
to the smaller id; fewer than k others give all of them; empty tables an empty
result; other columns play no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versehall.llm.common import in_arrow, ship, stage
from versehall.llm.vectors import distinct, finite, spread

SAMPLE, LEAST_SAMPLE = 8192, 1000
LIST_ROWS = 100
FINE_SAMPLE, MOST_LISTS = 4096, 16384
CHUNK, QUERY_CHUNK = 4096, 4096
BLOCK = 13  # columns of a block
CONFIDENCE = 2.6  # of the abandonment test, in standard deviations
GATHER = 0.1  # share of a list's pairs alive from which on they are followed one by one
COMPACT = 0.8  # share of rows or queries still followed below which the others are dropped
RECALL = 0.97
SEED = 5


@dataclass
class Index:
    """What every task needs: the lift, the rotation, the centroids, the lists to probe, the sample."""

    width: int
    norm: float
    turn: np.ndarray
    centroids: np.ndarray
    probes: int
    sample: np.ndarray

    def lift(self, v: np.ndarray) -> np.ndarray:
        """Rows of equal length one, turned."""
        v = v / self.norm
        rest = np.sqrt(np.maximum(0.0, 1.0 - (v * v).sum(1)))
        return (np.column_stack([v, rest]) @ self.turn).astype(np.float32)

    def ask(self, q: np.ndarray) -> np.ndarray:
        """Queries turned; they are scaled to length one and have nothing in the added coordinate."""
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        return (np.column_stack([q, np.zeros(len(q))]) @ self.turn).astype(np.float32)

    def nearest(self, v: np.ndarray, n: int) -> np.ndarray:
        d = (self.centroids**2).sum(1) - 2 * (v @ self.centroids.T)
        if n == 1:
            return d.argmin(1)[:, None]
        if n >= d.shape[1]:
            return np.argsort(d, axis=1)
        some = np.argpartition(d, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1), 1)

    def first(self, y: np.ndarray, k: int) -> np.ndarray:
        """The bound of each (turned) query: its k-th best distance in the sample."""
        if len(self.sample) < k:
            return np.full(len(y), np.inf, np.float32)
        return slack(np.partition(2 - 2 * (y @ self.sample.T), k - 1, axis=1)[:, k - 1])


def slack(d: np.ndarray) -> np.ndarray:
    """Room for rounding in single precision."""
    return d * np.float32(1.0001) + np.float32(1e-5)


def dense(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def means(x: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centroids of k-means."""
    out = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        own = ((out**2).sum(1) - 2 * (x @ out.T)).argmin(1)
        order = np.argsort(own, kind="stable")
        here, first = np.unique(own[order], return_index=True)
        out[here] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return out


def build(sample: np.ndarray, n: int, norm: float) -> Index:
    """Rotation and centroids from the sample of n vectors."""
    rng = np.random.default_rng(SEED)
    width = sample.shape[1]
    index = Index(width, norm, np.linalg.qr(rng.standard_normal((width + 1, width + 1)))[0], np.zeros((1, width + 1), np.float32), 1, None)
    index.sample = index.lift(sample)
    index.centroids = means(index.sample, max(1, min(math.ceil(n / LIST_ROWS), len(sample) // 16)), rng)
    return index


def aim_probes(index: Index, sample: np.ndarray, k: int, recall: float) -> int:
    """How many lists the sample's own neighbours need."""
    rng = np.random.default_rng(SEED)
    own = np.concatenate([index.nearest(index.sample[i : i + 512], 1)[:, 0] for i in range(0, len(sample), 512)])
    asks = rng.choice(len(sample), min(400, len(sample)), replace=False)
    scores = sample[asks] @ sample.T
    scores[np.arange(len(asks)), asks] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : max(1, min(k, len(sample) - 1))]
    place = np.argsort(index.nearest(index.ask(sample[asks]), len(index.centroids)), axis=1)  # of each list in the query's order
    needed = np.sort(np.take_along_axis(place, own[best], 1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1


def refine(units: DataFrame, index: Index, n: int) -> np.ndarray:
    """More centroids where the sample is too small for them: every list is cut by k-means on vectors
    of its own, at most some FINE_SAMPLE of them, drawn by hash at a rate of the list's own, however
    unevenly the rows lie on the lists."""
    lists = len(index.centroids)
    each = math.ceil(min(n / LIST_ROWS, MOST_LISTS) / lists)
    spark = units.sparkSession
    shared, rows = spark.sparkContext.broadcast(index), min(1.0, lists * FINE_SAMPLE / n)
    draw = F.pmod(F.xxhash64("u", F.lit("fine")), F.lit(1_000_000))
    some = units.where(draw < round(rows * 1_000_000)).select("v", draw.alias("draw"))

    def place(part: dict) -> dict:
        x = shared.value.lift(dense(part["v"], shared.value.width))
        return {"list": shared.value.nearest(x, 1)[:, 0], "draw": part["draw"], "x": [r.tobytes() for r in x]}

    near = stage(in_arrow(some, place, "list int, draw long, x binary"), "fine-sample")
    sizes = near.groupBy("list").count().collect()  # a row a list of the sample
    upto = spark.createDataFrame([(r["list"], round(rows * 1_000_000 * min(1.0, FINE_SAMPLE / r["count"]))) for r in sizes], "list int, upto long")
    near = near.join(F.broadcast(upto), "list").where("draw < upto").select("list", "x")

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(rows["x"].sort_values()), np.float32).reshape(len(rows), -1)
        made = means(x, max(1, min(each, len(x) // 16)), np.random.default_rng(SEED))
        return pd.DataFrame({"list": rows["list"].iloc[0], "c": [c.tobytes() for c in made]})

    made = near.groupBy("list").applyInPandas(cut, "list int, c binary").collect()  # at most MOST_LISTS rows
    held = {r["list"] for r in made}
    made = sorted((r["list"], bytes(r["c"])) for r in made) + [(i, c.tobytes()) for i, c in enumerate(index.centroids) if i not in held]
    return np.frombuffer(b"".join(c for _, c in sorted(made)), np.float32).reshape(len(made), -1)


def limit(seen: int, width: int) -> np.float32:
    """The share of a distance that its first `seen` columns hold at most, with CONFIDENCE."""
    share = seen / width
    return np.float32(min(1.0, share + CONFIDENCE * math.sqrt(2 * share * (1 - share) / (width + 2))))


def scan(x: np.ndarray, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the pairs of queries `q` and rows `x` of one list (both turned) that
    survive the tests against the queries' bounds."""
    width = x.shape[1]
    part, alive, at = np.zeros((len(q), len(x)), np.float32), None, 0
    qs, rs = np.arange(len(q)), np.arange(len(x))  # those that are still followed
    while at < width and len(qs) and len(rs):  # all pairs of them, while many are alive
        cut = slice(at, min(width, at + BLOCK))
        a, b = q[qs, cut], x[rs, cut]
        part += (a * a).sum(1)[:, None] + ((b * b).sum(1) - 2 * (a @ b.T))
        at = cut.stop
        ok = part <= (bound[qs] * limit(at, width))[:, None]
        alive = ok if alive is None else alive & ok
        if np.count_nonzero(alive) < GATHER * alive.size:
            break
        keep_q, keep_r = alive.any(1), alive.any(0)
        if min(keep_q.mean(), keep_r.mean()) < COMPACT:
            qs, rs = qs[keep_q], rs[keep_r]
            part, alive = part[keep_q][:, keep_r], alive[keep_q][:, keep_r]
    i, j = np.nonzero(alive)
    d = part[i, j]
    i, j = qs[i], rs[j]
    while at < width and len(i):  # then those left
        cut = slice(at, min(width, at + BLOCK))
        d = d + ((q[i, cut] - x[j, cut]) ** 2).sum(1)
        at = cut.stop
        ok = d <= bound[i] * limit(at, width)
        i, j, d = i[ok], j[ok], d[ok]
    return i, j, d


def scan_lists(x: np.ndarray, own: np.ndarray, y: np.ndarray, asked: np.ndarray, lists: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that survive: rows `x` on lists `own`, queries `y` where `asked` (places of
    queries) probe `lists`. The k nearest so far and the bounds go on from list to list."""
    order = np.argsort(own, kind="stable")
    names, first = np.unique(own[order], return_index=True)
    by = np.argsort(lists, kind="stable")
    asked, lists = asked[by], lists[by]
    best = np.full((len(y), k), np.inf, np.float32)
    qs, rs, ds = [], [], []
    for name, a, b in zip(names, first, np.append(first[1:], len(own))):
        q = asked[np.searchsorted(lists, name) : np.searchsorted(lists, name, side="right")]
        if not len(q):
            continue
        rows = order[a:b]
        for r in range(0, len(rows), 1024):
            i, j, d = scan(x[rows[r : r + 1024]], y[q], bound[q])
            if not len(i):
                continue
            qs.append(q[i])
            rs.append(rows[r + j])
            ds.append(d)
            met, start = np.unique(i, return_index=True)
            size = np.diff(np.append(start, len(i)))
            new = np.full((len(met), size.max()), np.inf, np.float32)
            new[np.repeat(np.arange(len(met)), size), np.arange(len(i)) - np.repeat(start, size)] = d
            both = np.concatenate([best[q[met]], new], axis=1)
            best[q[met]] = np.partition(both, k - 1, axis=1)[:, :k]
            bound[q[met]] = np.minimum(bound[q[met]], slack(best[q[met]].max(1)))
    if not qs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    q, r, d = map(np.concatenate, (qs, rs, ds))
    ok = d <= bound[q]
    return q[ok], r[ok]


def search(vectors: DataFrame, is_query: Column, k: int = 20, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows (vec_id, embedding) that `is_query` picks."""
    spark = vectors.sparkSession
    ship(spark)
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where(finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    units, members, askers = distinct(rows, k)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    n, width, most = units.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    if not n:
        return spread(units.select(F.col("u").alias("q"), "u", F.lit(0.0).alias("score")), members, askers, k)
    sample = min(sample, max(LEAST_SAMPLE, n // 4))
    picked = units.orderBy(F.xxhash64("u"), "u").limit(sample).select("u", "v").collect()  # at most `sample` rows
    known = dense([r["v"] for r in picked], width)
    fitted = build(known, n, most)
    if n / LIST_ROWS > 2 * len(fitted.centroids) and n > len(known):
        fitted.centroids = refine(units, fitted, n)
    fitted.probes = aim_probes(fitted, known, k, recall)
    index, kind = spark.sparkContext.broadcast(fitted), np.float32 if single else np.float64

    def place(part: dict) -> dict:
        plain = dense(part["v"], index.value.width)
        return {"u": part["u"], "list": index.value.nearest(index.value.lift(plain), 1)[:, 0], "v": [r.astype(kind).tobytes() for r in plain]}

    placed = stage(in_arrow(units.select("u", "v"), place, "u long, list int, v binary"), "placed")
    # at most MOST_LISTS rows reach the driver: lists are packed into chunks, large ones cut into some
    sizes = np.zeros(len(fitted.centroids), np.int64)
    for r in placed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    parts = np.maximum(1, -(-sizes // CHUNK))
    chunk, held = np.zeros(len(sizes), np.int64), 0
    for i in range(1, len(sizes)):
        alone = parts[i] > 1 or parts[i - 1] > 1 or held + sizes[i] + sizes[i - 1] > CHUNK
        held = 0 if alone else held + sizes[i - 1]
        chunk[i] = chunk[i - 1] + (parts[i - 1] if alone else 0)
    plan = spark.sparkContext.broadcast((chunk, parts))
    packs = F.broadcast(spark.createDataFrame(pd.DataFrame({"list": np.arange(len(sizes), dtype=np.int32), "first": chunk, "parts": parts.astype(np.int32)})))
    left = placed.join(packs, "list").select((F.col("first") + F.pmod(F.xxhash64("u"), F.col("parts"))).alias("chunk"), "list", "u", "v")

    def probe(asking: DataFrame, every: bool) -> DataFrame:
        """(q, u, score) of the queries (u, v), at least the k + 1 best of each on the lists it probes in
        every chunk."""

        def aim(part: dict) -> dict:
            ix, (chunk, parts) = index.value, plan.value
            plain = dense(part["v"], ix.width)
            turned = ix.ask(plain)
            goes = []
            for probed in ix.nearest(turned, len(ix.centroids) if every else ix.probes):
                to: dict = {}
                for name in np.sort(probed).tolist():
                    for c in range(chunk[name], chunk[name] + parts[name]):
                        to.setdefault(c, []).append(name)
                goes.append([{"chunk": c, "lists": x} for c, x in to.items()])
            bound = np.full(len(plain), np.inf, np.float32) if every else ix.first(turned, k + 1)
            return {"q": part["u"], "goes": goes, "bound": bound, "w": [r.astype(kind).tobytes() for r in plain]}

        aimed = stage(in_arrow(asking.select("u", "v"), aim, "q long, goes array<struct<chunk:long,lists:array<int>>>, bound float, w binary"), "aimed")
        asks = aimed.select("q", "bound", "w", F.explode("goes").alias("g")).select("q", "bound", "w", "g.chunk", "g.lists")
        cuts = stage(asks.groupBy("chunk").agg(F.ceil(F.count("*") / QUERY_CHUNK).cast("int").alias("qc")), "cuts")
        cuts = F.broadcast(cuts) if cuts.count() <= 100_000 else cuts.hint("merge")  # a row a chunk
        rows = left.join(cuts, "chunk").select("chunk", "list", "u", "v", F.explode(F.sequence(F.lit(0), F.col("qc") - 1)).alias("s"))
        right = asks.join(cuts, "chunk").select(F.col("chunk").alias("chunk_q"), F.pmod(F.xxhash64("q"), F.col("qc")).cast("int").alias("s_q"), "q", "bound", "w", "lists")

        def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            q = r = np.empty(0, np.int64)
            if len(rows) and len(queries):
                ix = index.value
                rows = rows.sort_values("u", ignore_index=True)
                v = np.frombuffer(b"".join(rows["v"]), kind).reshape(len(rows), -1).astype(np.float64)
                w = np.frombuffer(b"".join(queries["w"]), kind).reshape(len(queries), -1).astype(np.float64)
                asked = np.repeat(np.arange(len(queries)), queries["lists"].map(len))
                q, r = scan_lists(ix.lift(v), rows["list"].to_numpy(), ix.ask(w), asked, np.concatenate(list(queries["lists"])), queries["bound"].to_numpy().copy(), k + 1)
            if not len(q):
                return pd.DataFrame({"q": q, "u": q, "score": np.empty(0)})
            score = np.concatenate([(v[r[i : i + 65536]] * w[q[i : i + 65536]]).sum(1) for i in range(0, len(q), 65536)])
            order = np.lexsort((r, -score, q))  # ties to the smaller id
            q, r, score = q[order], r[order], score[order]
            first = np.flatnonzero(np.append(True, np.diff(q) != 0))
            ok = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) <= k
            return pd.DataFrame({"q": queries["q"].to_numpy()[q[ok]], "u": rows["u"].to_numpy()[r[ok]], "score": score[ok]})

        return rows.groupBy("chunk", "s").cogroup(right.groupBy("chunk_q", "s_q")).applyInPandas(run, "q long, u long, score double")

    asking = units.where("query")
    found = stage(probe(asking, every=False), "found")
    full = found.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") > min(k, n - 1))
    short = stage(asking.join(full, asking["u"] == full["q"], "left_anti"), "short")
    if short.limit(1).count():
        found = found.join(short.select(F.col("u").alias("q")), "q", "left_anti").union(stage(probe(short, every=True), "found"))
    return spread(found, members, askers, k)
