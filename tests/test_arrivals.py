"""State merged as rows arrive, and the linked tables of a library, on hand-made and shuffled rows."""

import random

from pyspark.sql import functions as F

from versehall.operators import merge
from versehall.streaming.merged import Kept, fold_batch, merge_stream, read_state

SCHEMA = "k long, at long, inc int, v string"


def rows_of(seed, n=120):
    rng = random.Random(seed)
    return [(rng.randint(0, 9), rng.randint(0, 6), rng.randint(0, 1), f"v{i}") for i in range(n)]


def fields():
    """Ties to ours, then to the greater value."""
    return Kept(lambda b: b.where("v <> 'gone'").withColumn("side", -F.col("inc")), ["k"], ["at", "side", "v"])


def gone():
    return Kept(lambda b: b.where("v = 'gone'").select("k"), ["k"])


def want(rows):
    out = {}
    for k, at, inc, v in rows:
        if v != "gone" and (k not in out or (at, -inc, v) > (out[k][0], -out[k][1], out[k][2])):
            out[k] = (at, inc, v)
    return out


def got(state):
    return {r.k: (r["at"], r.inc, r.v) for r in state.collect()}


def test_any_order_of_arrival_gives_the_same_state(spark, tmp_path):
    rows = rows_of(1)
    for seed in (2, 3):
        random.Random(seed).shuffle(rows)
        path, at, n = f"{tmp_path}/{seed}", 0, 0
        for size in (1, 50, 7, 62):
            fold_batch(spark.createDataFrame(rows[at : at + size], SCHEMA), n, path, {"f": fields()}, buckets=3)
            at, n = at + size, n + 1
            assert got(read_state(spark, path, "f")) == want(rows[:at])
        assert at == len(rows)


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    rows, path, tables = rows_of(4), str(tmp_path), {"f": fields(), "gone": gone()}
    for n in range(3):
        fold_batch(spark.createDataFrame(rows[n * 40 : n * 40 + 40], SCHEMA), n, path, tables, buckets=2)
    before = got(read_state(spark, path, "f"))
    fold_batch(spark.createDataFrame(rows[80:], SCHEMA), 2, path, tables, buckets=2)
    assert got(read_state(spark, path, "f")) == before == want(rows)
    assert read_state(spark, path, "gone") is None
    # a version that was begun but not finished is no part of the state
    (tmp_path / "f" / "version=3" / "bucket=0").mkdir(parents=True)
    assert got(read_state(spark, path, "f")) == before


def test_stream_with_a_stop_between(spark, tmp_path):
    rows = rows_of(5) + [(3, 0, 1, "gone"), (None, 2, 0, "x")]
    random.Random(6).shuffle(rows)
    path, files, tables = f"{tmp_path}/state", f"{tmp_path}/in", {"f": fields(), "gone": gone()}
    for part in (rows[:70], rows[70:]):
        spark.createDataFrame(part, SCHEMA).repartition(4).write.mode("append").parquet(files)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(files)
        merge_stream(stream, path, tables, f"{tmp_path}/offsets", buckets=2).awaitTermination()
    assert got(read_state(spark, path, "f")) == want(rows)
    left = merge.drop_tombstones(read_state(spark, path, "f"), read_state(spark, path, "gone"), ["k"])
    assert 3 not in got(left) and len(got(left)) == len(want(rows)) - 1


def test_empty_batches(spark, tmp_path):
    fold_batch(spark.createDataFrame([], SCHEMA), 0, str(tmp_path), {"f": fields()})
    assert read_state(spark, str(tmp_path), "f") is None


def library(spark, records=(), pointers=(), dead=(), sent=(), sent_dead=()):
    df = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    got = merge.merge_library(
        df(records, "record string, book string, name string, name_at long, heard_at long"),
        df(pointers, "book string, record string, active_at long"),
        df(dead, "record string, at long"),
        df(sent, "seq long, record string, book string, name string, name_at long, active_at long, heard_at long"),
        df(sent_dead, "record string, at long"),
    )
    return [sorted(map(tuple, x.collect())) for x in got]


def test_deletion_outlives_every_time(spark):
    ours = [("a", "B", "A", 1, 5), ("b", "B", "Bee", 1, 7), ("c", "B", "Cee", 1, 6)]
    records, pointers, dead = library(spark, ours, [("B", "a", 50)], [("z", 3)], [(1, "a", "B", "later", 99, 99, 99), (2, "z", "B", "back", 99, 99, 99), (3, "c", "B", "", 0, 50, 0)], [("a", 2), ("z", 1)])
    assert [r[0] for r in records] == ["b", "c"]
    # the pointer passes to the record heard last and keeps its time, which a message must be above
    assert pointers == [("B", "b", 50)] and dead == [("a", 2), ("z", 3)]


def test_names_owners_and_pointers(spark):
    ours = [("a", "B", "A", 5, 1), ("b", "B", "Bee", 5, 1)]
    sent = [
        (1, "a", "X", "tie", 5, 0, 2), (2, "b", "X", " New ", 6, 8, 0), (3, "b", "X", "same time", 6, 8, 0), (4, "b", "X", "  ", 9, 7, 0),
        (5, "c", "Y", None, 4, 0, 3), (6, "c", "Z", "too early", 3, 0, 0), (7, "d", "Y", "n" * 80, 1, 2, 0),
    ]
    records, pointers, _ = library(spark, ours, [("B", "a", 7)], sent=sent)
    assert records == [("a", "B", "A", 5, 2), ("b", "B", "New", 6, 1), ("c", "Y", "Default", 4, 3), ("d", "Y", "n" * 60, 1, 0)]
    assert pointers == [("B", "b", 8), ("Y", "d", 2)]
    # a book without a pointer points to what it adopts first
    assert library(spark, sent=[(2, "q", "N", "Q", 0, 0, 0), (1, "p", "N", "P", 0, 0, 0)])[1] == [("N", "p", 0)]
    assert library(spark) == [[], [], []]
