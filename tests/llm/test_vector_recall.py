"""The adaptive scan by itself: recall, whole answers, and components beyond a double."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from versehall.llm import adaptive_ann, exact_topk


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.95), ("sf0.1", 0.93)])
def test_recall_of_the_scan_alone(spark, sf, least):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    rows = df.where("embedding IS NOT NULL").collect()
    ids = np.array([r.vec_id for r in rows])
    m = np.array([r.embedding for r in rows], float)
    found = {}
    for r in adaptive_ann.search(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    shares = []
    for i in np.flatnonzero(ids % 20 == 0):
        scores = m @ m[i]
        scores[i] = -np.inf
        floor = np.sort(scores)[-20]
        got = found[ids[i]]
        assert len(got) == len(set(got)) == 20
        shares.append(np.mean(scores[np.searchsorted(ids, got)] >= floor))
    assert np.mean(shares) >= least and min(shares) >= 0.7


def test_every_query_gets_its_k(spark, monkeypatch):
    """With one probed list of a few rows nearly every query has to go on to all lists."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(adaptive_ann, "LIST_ROWS", 5)
    monkeypatch.setattr(adaptive_ann, "aim_probes", lambda *a: 1)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(400)]
    got = adaptive_ann.search(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, k=30).groupBy("query_id").count().collect()
    assert len(got) == 20 and {r["count"] for r in got} == {30}
    few = adaptive_ann.search(vectors_of(spark, rows[:12]), F.col("vec_id") % 20 == 0, k=30)
    assert few.count() == 11


def test_scan_drops_what_nobody_follows():
    """Rows far from all queries go before the later column blocks; the pairs found are those of a plain scan."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((300, 65)) * 0.05, rng.standard_normal((700, 65)) + 3]).astype(np.float32)
    q = (rng.standard_normal((40, 65)) * 0.05).astype(np.float32)
    bound = np.full(40, 1.0, np.float32)
    i, j, d = adaptive_ann.scan(x, q, bound)
    plain = ((q[:, None] - x[None]) ** 2).sum(2)
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(plain <= bound[:, None]))))
    assert set(zip(i.tolist(), j.tolist())) <= want and len(i) >= 0.95 * len(want) > 0
    assert np.allclose(d, plain[i, j], atol=1e-3)
    none = adaptive_ann.scan(x[300:], q, bound)
    assert not len(none[0])


def test_products_beyond_a_double(spark):
    rows = [(0, [1.0, 1.0]), (1, [1e308, 0.0]), (2, [-1e308, 0.0]), (3, [2.0, 1.0])]
    got = {r.vec_id: r.score for r in exact_topk.search(vectors_of(spark, rows), F.col("vec_id") == 0).collect()}
    assert got == {1: 2**63 - 1, 3: 64 * 64 * 3, 2: -(2**63)}
