"""Merging state of several devices. The tie rules differ on purpose: a field's incoming value
replaces the local one only if newer, a bookmark's also if equally old."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versehall.staging import stage


def last_writer(rows: DataFrame, keys: Sequence[str], at: str, value: str, incoming: Column, ties_to_incoming: bool, order: Sequence[str] = ()) -> DataFrame:
    """L1 (ties to local), L2 (ties to incoming): the newest value of each key."""
    side = incoming.cast("int") if ties_to_incoming else -incoming.cast("int")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(value, at), F.struct(F.col(at), side, *order)).alias("__x")).select(*keys, f"__x.{value}", f"__x.{at}")


def drop_tombstones(rows: DataFrame, tombstones: DataFrame, keys: Sequence[str]) -> DataFrame:
    """L2: deleted ids go whatever their time."""
    return rows.join(tombstones.select(*keys).distinct(), list(keys), "left_anti")


def keep_sessions(rows: DataFrame, owner: Sequence[str], session: str, started: str, incoming: Column, n: int = 200) -> DataFrame:
    """L3: sessions by id, the incoming one replacing the local, the last n by start."""
    once = Window.partitionBy(*owner, session).orderBy(incoming.desc(), F.col(started).desc())
    out = rows.withColumn("__r", F.row_number().over(once)).where("__r = 1")
    last = Window.partitionBy(*owner).orderBy(F.col(started).desc(), F.col(session).desc())
    return out.withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= n).drop("__r")


def merge_edits(local: DataFrame, incoming: DataFrame, key: str, value: str, sets: str) -> DataFrame:
    """Local values win, sets are united, and `conflict` marks keys where both differ."""
    a = local.select(key, F.col(value).alias("__a"), F.col(sets).alias("__s"))
    b = incoming.select(key, F.col(value).alias("__b"), F.col(sets).alias("__t"))
    both = a.join(b, key, "full_outer")
    union = F.array_sort(F.array_union(F.coalesce("__s", F.array().cast(f"{dict(local.dtypes)[sets]}")), F.coalesce("__t", F.array().cast(f"{dict(incoming.dtypes)[sets]}"))))
    conflict = F.col("__a").isNotNull() & F.col("__b").isNotNull() & (F.col("__a") != F.col("__b"))
    return both.select(key, F.coalesce("__a", "__b").alias(value), union.alias(sets), conflict.alias("conflict"))


def night_log(rows: DataFrame, keys: Sequence[str], at: str, incoming: Column) -> DataFrame:
    """L4: the newer log of a key; of equal ones that with more events; dismissed on either stays."""
    best = F.max_by(F.struct("events", at), F.struct(F.col(at), F.size("events"), -incoming.cast("int")))
    return rows.groupBy(*keys).agg(best.alias("__x"), F.max("dismissed").alias("dismissed")).select(*keys, "__x.events", f"__x.{at}", "dismissed")


def stale(rows: DataFrame, keys: Sequence[str], at: Column, now: Column, limit: float) -> DataFrame:
    """Age of the newest sign of life of each key, at least 0, and whether it is over `limit`."""
    age = F.first(now) - F.max(at)
    out = rows.groupBy(*keys).agg(F.when(age < 0, 0).otherwise(age).alias("age"))
    return out.withColumn("stale", F.col("age") > limit)


def merge_records(records: DataFrame, tombstones: DataFrame, key: str, at: str, owner: str, incoming: Column) -> DataFrame:
    """Per key the newer record (ties to local), unless a tombstone of the key is at least as new;
    `active` marks each owner's newest one left."""
    kept = [c for c in records.columns if c not in (key, at)]
    newest = records.groupBy(key).agg(F.max_by(F.struct(at, *kept), F.struct(F.col(at), -incoming.cast("int"))).alias("x")).select(key, "x.*")
    dead = tombstones.groupBy(key).agg(F.max(at).alias("__dead"))
    left = newest.join(dead, key, "left").where(F.col("__dead").isNull() | (F.col(at) > F.col("__dead"))).drop("__dead")
    last = Window.partitionBy(owner).orderBy(F.col(at).desc(), F.col(key).desc())
    return left.withColumn("active", F.row_number().over(last) == 1)


def merge_library(
    records: DataFrame, pointers: DataFrame, tombstones: DataFrame, arrived: DataFrame, arrived_tombstones: DataFrame, default_name: str = "Default", name_length: int = 60
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """L5 over the linked tables of a library, all messages at once.

    records (record, book, name, name_at, heard_at), pointers (book, record, active_at) and tombstones (record, at)
    are ours; `arrived` (seq, record, book, name, name_at, active_at, heard_at) are messages of other
    devices in the order of seq. Gives the three tables merged, by these rules:

    * a deleted record never comes back, whatever its time; a tombstone keeps its latest time;
    * an unknown record is adopted, by the book of its first message; a known one stays with its book;
    * the later name wins, ties to ours and then to the earlier message; blank names do not count, but
      an adopted record begins as `default_name` where its first message has none;
    * a book's pointer has a time of its own: a message that chose its record later moves it. A pointer
      to a deleted record passes to the book's record heard last; a book without one points to its first adopted.
    """
    dead = tombstones.select("record", "at").unionByName(arrived_tombstones.select("record", "at")).groupBy("record").agg(F.max("at").alias("at"))
    # staged where used more than once: each table is worked out once, and plans stay small
    dead = stage(dead, "tombstones")
    ours = stage(records.join(dead, "record", "left_anti"), "own-records")
    sent = arrived.join(dead, "record", "left_anti")
    sent = sent.join(ours.select("record", F.lit(True).alias("known")), "record", "left").withColumn("known", F.col("known").isNotNull())
    first = sent.groupBy("record").agg(F.min("seq").alias("first"))
    sent = stage(sent.join(first, "record").withColumn("fresh", ~F.col("known") & (F.col("seq") == F.col("first"))), "messages")

    name = F.substring(F.trim(F.coalesce("name", F.lit(""))), 1, name_length)
    name = F.when(name != "", name).when(F.col("fresh"), F.lit(default_name))
    named = sent.select("record", name.alias("name"), F.coalesce("name_at", F.lit(0)).alias("name_at"), "seq").where("name IS NOT NULL")
    named = ours.select("record", "name", "name_at", F.lit(-1).cast("long").alias("seq")).unionByName(named)
    names = named.groupBy("record").agg(F.max_by(F.struct("name", "name_at"), F.struct(F.col("name_at"), -F.col("seq"))).alias("n")).select("record", "n.*")
    owned = ours.select("record", "book").unionByName(sent.where("fresh").select("record", "book"))
    heard = ours.select("record", "heard_at").unionByName(sent.select("record", "heard_at")).groupBy("record").agg(F.max(F.coalesce("heard_at", F.lit(0))).alias("heard_at"))
    merged = stage(owned.join(names, "record").join(heard, "record"), "records")

    live = merged.select("record", "book")
    chosen = sent.where("active_at > 0").join(live.withColumnRenamed("book", "of"), "record").select(F.col("of").alias("book"), "record", "active_at", "seq")
    adopted = sent.where("fresh").select("book", "record", F.lit(0).alias("active_at"), "seq")
    held = stage(pointers.select("book", "record", "active_at").join(live, ["record", "book"], "left_semi"), "held-pointers")
    lost = pointers.join(held.select("book"), "book", "left_anti").select("book", F.col("active_at").alias("lost_at"))
    # a book that lost its record passes to the one heard last among those it had, at the lost one's time
    passed = ours.select("record", "book").join(merged.select("record", F.col("heard_at").alias("last_heard")), "record").join(lost, "book").groupBy("book").agg(F.max_by("record", F.struct("last_heard", "record")).alias("record"), F.first("lost_at").alias("active_at"))
    new = adopted.join(held.select("book"), "book", "left_anti").join(passed.select("book"), "book", "left_anti")
    every = held.withColumn("seq", F.lit(-1).cast("long")).unionByName(passed.withColumn("seq", F.lit(-1).cast("long"))).unionByName(new).unionByName(chosen)
    best = F.max_by(F.struct("record", "active_at"), F.struct(F.col("active_at"), -F.col("seq")))
    merged_pointers = every.groupBy("book").agg(best.alias("p")).select("book", "p.record", "p.active_at")
    return merged.select("record", "book", "name", "name_at", "heard_at"), merged_pointers, dead


def merge_wishes(local: DataFrame, incoming: DataFrame, key: str, status: str, order: Sequence[str]) -> DataFrame:
    """Wishes of both sides by key, the status further along `order` winning."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(status))
    both = local.select(key, status).unionByName(incoming.select(key, status))
    return both.groupBy(key).agg(F.max_by(status, F.struct(place, status)).alias(status))


def content_keys(rows: DataFrame, by: str, name: Column, digest: Column, hex_digits: int = 3) -> DataFrame:
    """(by, key), one digest of all of a group's (name, digest) whatever their order. Names are
    dealt to 16**hex_digits parts by hash, each part's sorted lines are digested, then the parts' digests."""
    line, part = F.concat(name, F.lit("="), digest), F.substring(F.md5(name), 1, hex_digits)
    hashed = lambda lines: F.sha2(F.array_join(F.sort_array(F.collect_list(lines)), "\n"), 256)
    parts = rows.select(by, line.alias("line"), part.alias("part")).groupBy(by, "part").agg(hashed(F.col("line")).alias("digest"))
    return parts.groupBy(by).agg(hashed(F.concat("part", F.lit("="), "digest")).alias("key"))


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """SNK6: write `rows` in place of what the table at `path` holds for their values of `by`. The
    committer moves whole partitions at the end of the job, so readers see the old or the new ones."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def replace_table(rows: DataFrame, path: str) -> None:
    """SNK1: write `rows` beside the table at `path` and move them into its place when they are complete:
    a job that fails leaves the old table as it was, also where `rows` are read from it."""
    spark = rows.sparkSession
    files = spark._jvm.org.apache.hadoop.fs
    fresh, old, kept = (files.Path(f"{path.rstrip('/')}{end}") for end in (".new", "", ".old"))
    system = old.getFileSystem(spark._jsc.hadoopConfiguration())
    rows.write.mode("overwrite").parquet(fresh.toString())
    system.delete(kept, True)
    if system.exists(old):
        system.rename(old, kept)
    if not system.rename(fresh, old):
        system.rename(kept, old)
        raise OSError(f"{path} could not be replaced")
    system.delete(kept, True)


def merge_nights(rows: DataFrame, key: str, incoming: Column) -> DataFrame:
    """L4: one night log a key from rows (key, id, started, ended, events, dismissed): of different nights the
    one that started later (ties to ours); of one night the record with more events (ties to ours), dismissed if
    any of its records is, ended as ours says, else as theirs. A night's start is the latest its records give."""
    side = -incoming.cast("int")
    size = F.size(F.coalesce("events", F.array().cast(dict(rows.dtypes)["events"])))
    own = rows.withColumn("__ours", side).groupBy(key, "id").agg(
        F.max(F.struct("started", "__ours")).alias("__s"), F.max_by(F.struct("events"), F.struct(size, F.col("__ours"), F.col("started"))).alias("__e"),
        F.coalesce(F.bool_or("dismissed"), F.lit(False)).alias("dismissed"), F.max_by("ended", F.when(F.col("ended").isNotNull(), F.struct(F.col("__ours"), F.col("ended")))).alias("ended"))
    best = F.max_by(F.struct("id", F.col("__s.started").alias("started"), "ended", F.col("__e.events").alias("events"), "dismissed"), F.struct(F.col("__s.started"), F.col("__s.__ours"), F.col("id")))
    return own.groupBy(key).agg(best.alias("x")).select(key, "x.*")


def merge_wish_sections(local: DataFrame, incoming: DataFrame, by: Sequence[str], caps: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """The wishes (by, section, item, value) of both sides; where both have an item ours stays, and it is a
    conflict if they differ. A book in which a section would hold more than its cap keeps ours as they
    were. Gives the wishes and (by, conflicts) of every book."""
    keys = [*by, "section", "item"]
    both = local.select(*keys, F.col("value").alias("__a"), F.lit(True).alias("__mine")).join(incoming.select(*keys, F.col("value").alias("__b"), F.lit(True).alias("__sent")), keys, "full_outer")
    both = stage(both.withColumn("__mine", F.col("__mine").isNotNull()).withColumn("__sent", F.col("__sent").isNotNull()), "wishes")
    limit = F.create_map(*[F.lit(x) for s, n in caps.items() for x in (s, n)])
    sizes = both.groupBy(*by, "section").agg(F.count("*").alias("n"))
    over = sizes.where(F.col("n") > F.coalesce(F.element_at(limit, F.col("section")), F.lit(1 << 31))).select(*by).distinct().withColumn("__over", F.lit(True))
    both = both.join(over, list(by), "left").withColumn("__over", F.col("__over").isNotNull())
    wishes = both.where(F.col("__mine") | ~F.col("__over")).select(*keys, F.when(F.col("__mine"), F.col("__a")).otherwise(F.col("__b")).alias("value"))
    clash = F.col("__mine") & F.col("__sent") & ~F.col("__a").eqNullSafe(F.col("__b")) & ~F.col("__over")
    return wishes, both.groupBy(*by).agg(F.count_if(clash).alias("conflicts"))
