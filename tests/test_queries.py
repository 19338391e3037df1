"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from versehall.operators import pages
from versehall.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    want = duck.sql(SQL[name])
    assert cols == sorted(want.columns)
    types = dict(zip(want.columns, map(str, want.types)))
    assert {k: TYPES[v] for k, v in df.dtypes} == types
    at = [want.columns.index(c) for c in cols]
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_containment_of_short_passages(spark, tmp_path):
    """Names and passages of every length, cut inside words and before punctuation, with repeated and null ids and texts."""
    docs = [(8, "aaaa Anna\nAnna Brown Anna"), (1, "Old Anna Brown, of Kent, met one two three four five six seven eight nine. Done é日本"), (2, "annas"), (3, ""), (None, "Anna"), (4, "Anna\nBrown"), (4, "x Anna Brown y"), (5, None), (6, "a  b c d")]
    items = ["Anna", "Anna Brown", "nna Bro", "Brown, of Kent", "one two three four five six seven eight nine", "two three four five six seven eight nine. Do", "é日", "x", "", None, " ", "a  b c", "missing", "aa", "one two three four five six seven eight ten", "Anna"]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = duckdb.connect()
    for n in ("documents", "benchmark"):
        own.sql(f"create view {n} as select * from '{tmp_path}/{n}.parquet/*.parquet'")
    want = own.sql("SELECT doc_id, item_id, mentions FROM (" + SQL["j19_containment"] + ")").fetchall()
    assert len({i for _, i, _ in want}) == 12  # the empty passage stands nowhere
    assert max(n for *_, n in want) > 1
    assert sorted(map(tuple, QUERIES["j19_containment"](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}.parquet")
    joined = pages.containment(read("documents"), read("benchmark"), "doc_id", "text", "item_id", "text", most_bytes=0)
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(want, key=str)
