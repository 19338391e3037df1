"""Queries of merged state: as rows arrive in any order, and over the linked tables of a library."""

from pyspark.sql import functions as F

from versehall.operators import merge
from versehall.operators.intervals import micros
from versehall.plans.entities import _newest, _state
from versehall.plans.registry import QUERIES, SQL, query, table
from versehall.staging import own_path
from versehall.streaming.merged import Kept, merge_stream, read_state


def _arrived(spark, rows, tables):
    """`rows` dealt out by hash into files, streamed in about four micro-batches and folded: the state tables."""
    files, states = own_path(spark, "arriving"), own_path(spark, "states")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(parts, F.xxhash64(F.lit("arrival"), *rows.columns)).write.parquet(files)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-parts // 4)).parquet(files)
    merge_stream(stream, states, tables, own_path(spark, "offsets")).awaitTermination()
    return {name: read_state(spark, states, name) for name in tables}


def _fields(to_incoming: bool) -> Kept:
    side = F.col("incoming").cast("int")
    return Kept(lambda b: b.withColumn("side", side if to_incoming else -side).drop("incoming"), ["user_id", "event_type"], ["day", "side", "event_id"])


@query(_newest("ASC"))
def l1_arriving(spark, sf_dir):
    """As `l1_last_writer`, by a stream."""
    return _arrived(spark, _state(spark, sf_dir), {"fields": _fields(False)})["fields"].select("user_id", "event_type", "value", "day")


@query(_newest("DESC") + " AND user_id % 10 <> 3")
def l2_arriving(spark, sf_dir):
    """As `l2_bookmarks`, by a stream that feeds bookmarks and tombstones; a deletion holds for rows that come later, too."""
    dead = Kept(lambda b: b.where("user_id % 10 = 3").select("user_id"), ["user_id"])
    got = _arrived(spark, _state(spark, sf_dir), {"bookmarks": _fields(True), "tombstones": dead})
    return merge.drop_tombstones(got["bookmarks"], got["tombstones"], ["user_id"]).select("user_id", "event_type", "value", "day")


def l3_arriving(spark, sf_dir):
    """As `l3_sessions`, by a stream: the incoming row of a session replaces the local one whichever comes first.
    The last 20 are picked when the state is read, since a session pushed out may move up again."""
    s = table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 2).cast("long").alias("session"), micros("ts").alias("started"), (F.col("event_id") % 2).alias("side"))
    got = _arrived(spark, s, {"sessions": Kept(lambda b: b, ["user_id", "session"], ["side", "started"])})["sessions"]
    return merge.keep_sessions(got, ["user_id"], "session", "started", F.col("side"), 20).select("user_id", "session", "started")


QUERIES["l3_arriving"], SQL["l3_arriving"] = l3_arriving, SQL["l3_sessions"]

_OWN = """SELECT *, user_id || '-' || event_id % 7 AS record, (epoch_us(ts) // 86400000000)::BIGINT AS day FROM events"""


@query(f"""WITH e AS ({_OWN}), mine AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY event_id DESC) AS r FROM e WHERE event_id % 3 = 0),
  had AS (SELECT record, user_id AS book, event_type AS name, day AS name_at, day AS heard_at, event_id FROM mine WHERE r = 1),
  pointed AS (SELECT book, arg_max(record, event_id) AS record, max(name_at) - 3 AS active_at FROM had GROUP BY book),
  dead AS (SELECT DISTINCT record FROM e WHERE event_id % 61 = 2),
  sent AS (SELECT event_id AS seq, record, user_id + event_id % 2 AS book, CASE WHEN value >= 20 THEN event_type ELSE ' ' END AS name, day AS name_at, CASE WHEN value > 40 THEN day ELSE 0 END AS active_at, day AS heard_at
           FROM e WHERE event_id % 3 = 1 AND record NOT IN (SELECT record FROM dead)),
  ours AS (SELECT * FROM had WHERE record NOT IN (SELECT record FROM dead)),
  f AS (SELECT s.*, o.record IS NULL AND seq = min(seq) OVER (PARTITION BY s.record) AS fresh FROM sent s LEFT JOIN ours o USING (record)),
  names AS (SELECT record, name, name_at, -1 AS seq FROM ours UNION ALL SELECT record, CASE WHEN trim(name) <> '' THEN trim(name) ELSE 'Default' END, name_at, seq FROM f WHERE trim(name) <> '' OR fresh),
  n AS (SELECT record, name, name_at FROM names QUALIFY row_number() OVER (PARTITION BY record ORDER BY name_at DESC, seq) = 1),
  h AS (SELECT record, max(heard_at) AS heard_at FROM (SELECT record, heard_at FROM ours UNION ALL SELECT record, heard_at FROM f) GROUP BY record),
  owned AS (SELECT record, book FROM ours UNION ALL SELECT record, book FROM f WHERE fresh),
  held AS (SELECT p.book, p.record, p.active_at FROM pointed p JOIN owned o USING (record, book)),
  passed AS (SELECT o.book, max(struct_pack(h := h.heard_at, r := o.record)).r AS record, any_value(p.active_at) AS active_at FROM ours o JOIN h USING (record) JOIN pointed p ON p.book = o.book
             WHERE p.book NOT IN (SELECT book FROM held) GROUP BY o.book),
  ways AS (SELECT book, record, active_at, -1 AS seq FROM held UNION ALL SELECT book, record, active_at, -1 FROM passed
           UNION ALL SELECT book, record, 0, seq FROM f WHERE fresh AND book NOT IN (SELECT book FROM held) AND book NOT IN (SELECT book FROM passed)
           UNION ALL SELECT o.book, f.record, f.active_at, f.seq FROM f JOIN owned o USING (record) WHERE f.active_at > 0),
  active AS (SELECT book, record, active_at FROM ways QUALIFY row_number() OVER (PARTITION BY book ORDER BY active_at DESC, seq) = 1)
  SELECT record, owned.book, name, name_at, heard_at, a.record IS NOT NULL AS is_active, a.active_at FROM owned JOIN n USING (record) JOIN h USING (record) LEFT JOIN active a USING (record)""")
def l5_library(spark, sf_dir):
    """Two thirds of the events as the tables of two devices: a record is a user and a class of events, its book the user."""
    e = table(spark, sf_dir, "events").withColumn("day", F.floor(micros("ts") / 864e8).cast("long"))
    e = e.withColumn("record", F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string")))
    had = e.where("event_id % 3 = 0").groupBy("record").agg(F.max_by(F.struct(F.col("user_id").alias("book"), F.col("event_type").alias("name"), F.col("day").alias("name_at"), F.col("day").alias("heard_at"), "event_id"), "event_id").alias("x")).select("record", "x.*")
    pointed = had.groupBy("book").agg(F.max_by("record", "event_id").alias("record"), (F.max("name_at") - 3).alias("active_at"))
    sent = e.where("event_id % 3 = 1").select(
        F.col("event_id").alias("seq"), "record", (F.col("user_id") + F.col("event_id") % 2).alias("book"), F.when(F.col("value") >= 20, F.col("event_type")).otherwise(" ").alias("name"),
        F.col("day").alias("name_at"), F.when(F.col("value") > 40, F.col("day")).otherwise(0).alias("active_at"), F.col("day").alias("heard_at"))
    none = e.where("false").select("record", F.col("day").alias("at"))
    merged, active, _ = merge.merge_library(had.drop("event_id"), pointed, none, sent, e.where("event_id % 61 = 2").select("record", F.col("day").alias("at")))
    return merged.join(active.select("record", "active_at"), "record", "left").select("record", "book", "name", "name_at", "heard_at", F.col("active_at").isNotNull().alias("is_active"), "active_at")


@query("""WITH e AS (SELECT user_id, event_id // 8 AS night, event_id % 2 = 1 AS theirs, ts, value FROM events), r AS (SELECT user_id, night, theirs, max(epoch_us(ts)) AS started, CASE WHEN count(*) > 1 THEN min(epoch_us(ts)) END AS ended, list_sort(list(value)) AS ev, bool_or(value > 90) AS dismissed FROM e GROUP BY ALL),
  n AS (SELECT user_id, night, max(started) AS started, bool_or(NOT theirs AND started = top) AS own, bool_or(dismissed) AS dismissed, coalesce(max(CASE WHEN NOT theirs THEN ended END), max(ended)) AS ended, arg_max(ev, (len(ev), NOT theirs)) AS ev
        FROM (SELECT *, max(started) OVER (PARTITION BY user_id, night) AS top FROM r) GROUP BY user_id, night),
  k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY started DESC, own DESC, night DESC) AS p FROM n) SELECT user_id, night, started, ended, len(ev)::INTEGER AS n_events, round(list_sum(ev), 4) AS total, dismissed FROM k WHERE p = 1""")
def l4_nights(spark, sf_dir):
    """A user's events by eights as nights of two devices, the odd ones from the other."""
    e = table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 8).cast("long").alias("id"), (F.col("event_id") % 2 == 1).alias("theirs"), micros("ts").alias("at"), "value")
    r = e.groupBy("user_id", "id", "theirs").agg(F.max("at").alias("started"), F.when(F.count("*") > 1, F.min("at")).alias("ended"), F.sort_array(F.collect_list("value")).alias("events"), F.bool_or(F.col("value") > 90).alias("dismissed"))
    n = merge.merge_nights(r, "user_id", F.col("theirs"))
    total = F.aggregate("events", F.lit(0.0), lambda s, x: s + x)
    return n.select("user_id", F.col("id").alias("night"), "started", "ended", F.size("events").alias("n_events"), F.round(total, 4).alias("total"), "dismissed")


@query("""WITH o AS (SELECT o_custkey AS book, CASE WHEN o_orderkey % 3 = 0 THEN 'voices' ELSE 'lines' END AS section, o_orderkey % 7 AS item, o_orderkey % 2 AS side, max(o_orderpriority) AS value FROM orders GROUP BY ALL),
  f AS (SELECT coalesce(a.book, b.book) AS book, coalesce(a.section, b.section) AS section, coalesce(a.item, b.item) AS item, a.value AS a, b.value AS b FROM (SELECT * FROM o WHERE side = 0) a FULL JOIN (SELECT * FROM o WHERE side = 1) b ON a.book = b.book AND a.section = b.section AND a.item = b.item),
  s AS (SELECT DISTINCT book FROM (SELECT book, section, count(*) AS n FROM f GROUP BY ALL) WHERE n > CASE section WHEN 'voices' THEN 3 ELSE 5 END)
  SELECT f.book, count(*) FILTER (a IS NOT NULL OR s.book IS NULL) AS wishes, count(*) FILTER (a <> b AND s.book IS NULL) AS conflicts, coalesce(min(CASE WHEN a IS NOT NULL OR s.book IS NULL THEN section || item || coalesce(a, b) END), '') AS least FROM f LEFT JOIN s USING (book) GROUP BY f.book""")
def l7_wishes(spark, sf_dir):
    """A customer's orders as wishes of two devices in two sections of three and five at most."""
    o = table(spark, sf_dir, "orders")
    w = o.groupBy(F.col("o_custkey").alias("book"), F.when(F.col("o_orderkey") % 3 == 0, "voices").otherwise("lines").alias("section"), (F.col("o_orderkey") % 7).alias("item"), (F.col("o_orderkey") % 2).alias("side")).agg(F.max("o_orderpriority").alias("value"))
    wishes, conflicts = merge.merge_wish_sections(w.where("side = 0"), w.where("side = 1"), ["book"], {"voices": 3, "lines": 5})
    kept = wishes.groupBy("book").agg(F.count("*").alias("wishes"), F.min(F.concat("section", F.col("item").cast("string"), "value")).alias("least"))
    return conflicts.join(kept, "book", "left").select("book", F.coalesce("wishes", F.lit(0)).alias("wishes"), "conflicts", F.coalesce("least", F.lit("")).alias("least"))
