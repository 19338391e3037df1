"""Queries over ordered rows: intervals, gaps, adjacency, islands, timelines."""

from pyspark.sql import functions as F

from versehall.operators import intervals as iv
from versehall.operators import ranking as rk
from versehall.plans.registry import query, table

DAY = 86_400_000_000


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER
  (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mode FROM events""")
def j13_asof(spark, sf_dir):
    e = iv.asof_last(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("value"), F.col("event_type") == "view", "mode")
    return e.select("event_id", "user_id", "mode")


@query("""WITH m AS (SELECT user_id, ts AS s, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e, event_id AS span_id FROM events WHERE event_type = 'view')
  SELECT x.event_id, m.span_id FROM events x JOIN m ON x.user_id = m.user_id AND x.ts >= m.s AND x.ts < m.e""")
def j14_interval_join(spark, sf_dir):
    e = _events(spark, sf_dir)
    spans = iv.intervals(e.where("event_type = 'view'"), ["user_id"], "ts", ["event_id"]).select("user_id", F.col("event_id").alias("span_id"), "start", "end")
    return iv.interval_join(e.select("event_id", "user_id", "ts"), spans, ["user_id"], "ts", 7 * DAY).select("event_id", "span_id")


@query("""SELECT event_id, event_type, next_event_id FROM (SELECT *, lead(event_type) OVER w AS nt, lead(event_id) OVER w AS next_event_id
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = nt""")
def j15_adjacent(spark, sf_dir):
    return iv.adjacent(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["event_type"], ["event_id"]).select("event_id", "event_type", "next_event_id")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
  k AS (SELECT user_id, event_id, s FROM e WHERE r = 1 UNION ALL SELECT user_id, event_id, s FROM
    (SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY e.r) AS n FROM k JOIN e ON e.user_id = k.user_id AND e.s > k.s + 864e8) x WHERE n = 1)
  SELECT event_id FROM k""")
def j20_band_dedup(spark, sf_dir):
    """Events kept a day apart: each is held against the last one kept."""
    return iv.thin(_events(spark, sf_dir), ["user_id"], iv.micros("ts"), ["event_id"], DAY).select("event_id")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, event_type = 'purchase' AS a FROM events),
  n AS (SELECT x.event_id, x.r, x.a, x.event_type, min(y.r) AS nr FROM e x LEFT JOIN e y ON y.user_id = x.user_id AND y.r > x.r AND (y.a OR y.event_type <> 'view') GROUP BY ALL),
  t AS (SELECT n.event_id, CASE WHEN n.a THEN n.event_id WHEN n.event_type = 'view' AND z.a AND n.nr - n.r <= 3 THEN z.event_id END AS owner FROM n JOIN e o ON o.event_id = n.event_id LEFT JOIN e z ON z.user_id = o.user_id AND z.r = n.nr)
  SELECT event_id, owner FROM t""")
def w10_block_before(spark, sf_dir):
    """Views right before a purchase, at most three, go with it."""
    e = iv.block_before(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_type") == "view", 3, "owner")
    return e.select("event_id", "owner")


@query("""WITH g AS (SELECT event_type, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS d FROM events)
  SELECT event_type, count(d) AS n, round(sum(d) / 1e6, 2) AS seconds FROM g WHERE d >= 0 AND d < 432000000000 GROUP BY event_type""")
def w2_stage_gaps(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("s", iv.micros("ts"))
    g = iv.gaps(e, ["user_id"], F.col("s"), ["event_id"], 432_000_000_000).where("gap IS NOT NULL")
    return g.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("gap") / 1e6, 2).alias("seconds"))


@query("""WITH i AS (SELECT event_type, ts, lead(ts, 1, (SELECT max(ts) FROM events)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM events)
  SELECT event_type, round(sum(date_diff('microsecond', ts, e)) / 1e6, 2) AS seconds FROM i GROUP BY event_type""")
def w3_state_durations(spark, sf_dir):
    e = _events(spark, sf_dir)
    e = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("stop"))))  # one row
    spans = iv.intervals(e, ["user_id"], "ts", ["event_id"], F.col("stop"))
    return spans.groupBy("event_type").agg(F.round(F.sum(iv.micros("end") - iv.micros("start")) / 1e6, 2).alias("seconds"))


@query("""SELECT user_id, event_id, round(sum(round(value * 100)::BIGINT * (1 + event_id % 3)) OVER w / sum(1 + event_id % 3) OVER w, 4) AS mean FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""")
def w6_range_mean(spark, sf_dir):
    e = iv.range_mean(_events(spark, sf_dir), ["user_id"], iv.micros("ts"), DAY, F.round(F.col("value") * 100).cast("long"), 1 + F.col("event_id") % 3, "mean")
    return e.select("user_id", "event_id", F.round("mean", 4).alias("mean"))


@query("""SELECT conv_id, turn, CASE WHEN lead(turn) OVER w IS NULL THEN 0 WHEN lead(role) OVER w <> role THEN greatest(170, 380)
  ELSE 170 END::INTEGER AS break_ms FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def w8_breaks(spark, sf_dir):
    return iv.breaks(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role", F.lit(170)).select("conv_id", "turn", "break_ms")


@query("""WITH f AS (SELECT user_id, event_id, ts, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS fresh FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f)
  SELECT user_id, island::BIGINT AS island, min(event_type) AS event_type, count(*) AS n FROM i GROUP BY user_id, island""")
def w9_islands(spark, sf_dir):
    i = iv.islands(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type"))
    return i.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@query("""WITH p AS (SELECT event_type AS t, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  c AS (SELECT CASE WHEN t = a THEN 'same' WHEN t = b THEN 'back' ELSE 'other' END AS pattern, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY 1)
  SELECT pattern, n, round((n + 1) / (sum(n) OVER () + 3), 6) AS share FROM c""")
def a28_transitions(spark, sf_dir):
    return iv.transitions(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type"), 3)


@query("""WITH e AS (SELECT epoch_us(ts) / 1e6 AS s FROM events), n AS (SELECT max(s) AS now FROM e),
  r AS (SELECT count(*) AS n, max(now) - min(s) AS span FROM e, n WHERE s > now - 864000 AND s <= now)
  SELECT n, CASE WHEN n >= 12 AND span >= 60 THEN round(n / span, 6) END AS rate FROM r""")
def w15_throughput(spark, sf_dir):
    e = _events(spark, sf_dir).select((iv.micros("ts") / 1e6).alias("s"))
    e = e.crossJoin(F.broadcast(e.agg(F.max("s").alias("now"))))  # one row
    return iv.throughput(e, F.col("s"), F.col("now"), 864_000)


@query("""WITH d AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS done, sum(CASE WHEN event_type <> 'purchase' THEN least(60.0, value) ELSE 60.0 END) AS heard FROM events GROUP BY user_id)
  SELECT user_id, done, round(heard, 4) AS heard FROM d""")
def m11_progress(spark, sf_dir):
    done = F.col("event_type") == "purchase"
    e = _events(spark, sf_dir).groupBy("user_id").agg(F.count_if(done).alias("done"), F.sum(F.when(done, 60.0).otherwise(F.least(F.lit(60.0), F.col("value")))).alias("heard"))
    return e.select("user_id", "done", F.round("heard", 4).alias("heard"))


_HOST = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"


@query(f"""WITH p AS (SELECT page_id, {_HOST} AS host, try_cast(nullif(regexp_extract(url, '([0-9]{{1,9}})[^0-9]*$', 1), '') AS INTEGER) AS n FROM pages),
  r AS (SELECT *, max(n) OVER (PARTITION BY host ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM p WHERE n IS NOT NULL)
  SELECT page_id, n FROM r WHERE top IS NULL OR n > top""")
def w14_volume_starts(spark, sf_dir):
    """Pages of a host, in order, where the number in the address is above all before."""
    n = F.regexp_extract("url", "([0-9]{1,9})[^0-9]*$", 1)
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.when(n != "", n.try_cast("int")).alias("n"))
    return iv.volume_starts(p, ["host"], ["page_id"], F.col("n")).select("page_id", "n")


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY length(p_name) DESC, p_partkey) AS place FROM part")
def s3_longest_first(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.length("p_name").alias("n"))
    return rk.global_rank(p, "n", "p_partkey", "place", descending=True).select("p_partkey", "p_name", "place")


@query("""WITH c AS (SELECT event_id, value, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS c FROM events)
  SELECT event_id, c, row_number() OVER (ORDER BY c, value DESC, event_id) AS place FROM c""")
def s5_category_order(spark, sf_dir):
    """Categories in their order, the larger value first."""
    c = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    e = _events(spark, sf_dir).select("event_id", c.alias("c"), "value")
    return rk.ranked(e, [F.asc("c"), F.desc_nulls_last("value"), F.asc("event_id")], "place").select("event_id", "c", "place")


@query("""WITH x AS (SELECT s_nationkey, sum(s_acctbal) AS spoken, count(*) AS names FROM supplier GROUP BY s_nationkey), y AS (SELECT s_nationkey, round(spoken * spoken / names, 6) AS score FROM x)
  SELECT s_nationkey, score, row_number() OVER (ORDER BY score DESC, s_nationkey) AS place FROM y""")
def s10_ratio_score(spark, sf_dir):
    x = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("spoken"), F.count("*").alias("names"))
    x = x.select("s_nationkey", F.round(F.col("spoken") * F.col("spoken") / F.col("names"), 6).alias("score"))
    return rk.global_rank(x, "score", "s_nationkey", "place", descending=True)


@query("""WITH a AS (SELECT c_custkey AS k, 2 * row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS pos FROM customer),
  b AS (SELECT o_custkey AS k, 2 * row_number() OVER (ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey) + 1 AS pos FROM orders GROUP BY o_custkey)
  SELECT k, min(pos)::BIGINT AS pos FROM (SELECT * FROM a UNION ALL SELECT * FROM b) x GROUP BY k ORDER BY 2, 1 LIMIT 40""")
def s9_interleaved(spark, sf_dir):
    """Two rankings taken in turn, each name once: the first 40."""
    c = rk.global_rank(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal"), "c_acctbal", "k", "r", descending=True)
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    o = rk.global_rank(o, "total", "k", "r", descending=True)
    both = c.select("k", (2 * F.col("r")).alias("pos")).union(o.select("k", (2 * F.col("r") + 1).alias("pos")))
    return both.groupBy("k").agg(F.min("pos").cast("long").alias("pos")).orderBy("pos", "k").limit(40)


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey)::BIGINT AS place FROM orders")
def s1_multi_key(spark, sf_dir):
    """Five priorities hold all orders: each is ranked over many tasks."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return rk.ranked(o, [F.asc("o_orderstatus"), F.desc("o_totalprice"), F.asc("o_orderkey")], "place", ["o_orderpriority"]).select("o_orderkey", "place")


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY v NULLS LAST, c_custkey)::BIGINT AS place FROM (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer) x")
def s2_nulls_last(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("v"))
    return rk.ranked(c, [F.asc_nulls_last("v"), F.asc("c_custkey")], "place", ["c_mktsegment"]).select("c_custkey", "place")


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY (recent IS NULL)::INT, recent DESC NULLS LAST, c_name, c_custkey)::BIGINT AS place FROM (SELECT c_custkey, c_nationkey, c_name, max(o_orderdate) AS recent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1, 2, 3) x")
def s13_two_tiers(spark, sf_dir):
    last = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("recent"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name").join(last, "c_custkey", "left")
    return rk.ranked(c, [F.desc_nulls_last("recent"), F.asc("c_name"), F.asc("c_custkey")], "place", ["c_nationkey"]).select("c_custkey", "place")
