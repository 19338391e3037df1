"""Queries for identities, selection by features, and merges of state."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from versehall.functions import text as tx
from versehall.operators import entity, merge, select
from versehall.operators import sequential as seq
from versehall.operators.intervals import micros
from versehall.plans.registry import plain, query, table

plain("e11_shared_voice", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1")


@query("""WITH n AS (SELECT max(epoch_us(ts)) AS now FROM events) SELECT user_id, (n.now - max(epoch_us(ts)))::BIGINT AS age, n.now - max(epoch_us(ts)) > 864e8 AS stale FROM events, n GROUP BY user_id, n.now""")
def l9_stale(spark, sf_dir):
    """Users whose last event lies over a day before the newest one of all."""
    e = table(spark, sf_dir, "events").select("user_id", micros("ts").alias("at"))
    e = e.crossJoin(F.broadcast(e.agg(F.max("at").alias("now"))))  # one row
    return merge.stale(e, ["user_id"], F.col("at"), F.col("now"), 86_400_000_000)


#: A cast of hand-written names (name, lines) and the words of their book (name, hits), the same for both engines.
_CAST = """SELECT * FROM VALUES ('Thủ Lãnh', 32), ('Thu Lãnh', 66), ('Thu Lanh', 4), ('Má', 9), ('Mà', 3), ('Ma', 2), ('Làn Mỹ', 5), ('Lán My', 4), ('Lan Mỹ', 1),
  ('Karlo', 3), ('Mareia', 1), ('Josefine', 2), ('Anna', 40), ('Anna Brow', 2), ('Anna Brown Lee', 3), ('Ann', 9), ('Tào Tháo', 12), ('Tháo', 17), ('Thao', 3),
  ('Chị Dậu', 8), ('Dậu', 6), ('Lý Ca', 3), ('Ca', 5), ('Vân', 2), ('Triệu Vân', 7), ('Lục Vân', 5), ('an_na', 3), ('ANNA', 2), ('anna', 40) AS c(name, lines)"""
_WORDS = "SELECT * FROM VALUES ('Karla', 9), ('Maria', 7), ('Marta', 5), ('Josephine', 4), ('Anna', 9), ('Rare', 1), ('Kuro Hana', 6), ('Kuro Yuki', 5), ('Hana', 3) AS w(name, hits)"
_PREFIXES = ["chị", "anh", "ông", "bà"]


def _cast(spark):
    return spark.sql(_CAST)


def _rows(columns: str, *rows: tuple) -> str:
    """Rows worked out by hand from the rules, as SQL."""
    return f"SELECT * FROM (VALUES {', '.join(map(str, rows))}) AS t({columns})"


@query(_rows("name, target", ("Thu Lãnh", "Thủ Lãnh"), ("Thu Lanh", "Thủ Lãnh"), ("Ma", "Má"), ("Lan Mỹ", "Làn Mỹ"), ("Thao", "Tháo")))
def e2_dropped_marks(spark, sf_dir):
    """Làn Mỹ, Lán My: neither bears all marks of the other."""
    return entity.dropped_marks(_cast(spark))


@query(_rows("name, of, dropped", ("Thu Lãnh", "Thủ Lãnh", True), ("Má", "Mà", False), ("Mà", "Má", False), ("Ma", "Má", True), ("Lán My", "Làn Mỹ", False), ("Thủ Lãnh", "Thu Lãnh", False), ("Dau", "Dậu", True), ("dịp", "địp", True)).replace("True", "true").replace("False", "false"))
def f10_dropped_marks_of(spark, sf_dir):
    pairs = [("Thu Lãnh", "Thủ Lãnh"), ("Má", "Mà"), ("Mà", "Má"), ("Ma", "Má"), ("Lán My", "Làn Mỹ"), ("Thủ Lãnh", "Thu Lãnh"), ("Dau", "Dậu"), ("dịp", "địp")]
    return spark.createDataFrame(pairs, "name string, of string").withColumn("dropped", tx.dropped_marks_of(F.col("name"), F.col("of")))


@query(_rows("name, target", ("Karlo", "Karla"), ("Mareia", "Maria"), ("Josefine", "Josephine"), ("Ann", "Anna"), ("an_na", "Anna"), ("ANNA", "Anna"), ("anna", "Anna")))
def e4_e5_source_spelling(spark, sf_dir):
    return entity.to_source_spelling(_cast(spark), spark.sql(_WORDS))


@query(_rows("name, target", ("Tháo", "Tào Tháo"), ("Thao", "Tào Tháo"), ("Ca", "Lý Ca")))
def e6_given_to_full(spark, sf_dir):
    """Dậu is not the wife named after that husband; two names end in Vân."""
    return entity.given_to_full(_cast(spark), _PREFIXES)


@query(_rows("name, target", ("Yuki", "Kuro Yuki"), ("Hana", "KURO HANA")))
def e6_part_of_written(spark, sf_dir):
    """Kuro belongs to two full names; the cast spells one of them its own way."""
    names = spark.createDataFrame([("Kuro", 3), ("Yuki", 2), ("Hana", 5), ("KURO HANA", 4), ("Sora", 1)], "name string, lines int")
    return entity.part_of_written(names, spark.sql(_WORDS).select("name"))


@query(_rows("name, canonical", ("Thu Lãnh", "Thủ Lãnh"), ("Thu Lanh", "Thủ Lãnh"), ("Thao", "Tào Tháo"), ("Tháo", "Tào Tháo"), ("an_na", "an_na"), ("ANNA", "Anna"), ("anna", "Anna"), ("Anna Brow", "Anna"), ("Anna Brown Lee", "Anna"), ("Karlo", "Karla"), ("Ca", "Boss")))
def e1_resolved_names(spark, sf_dir):
    """The passes in order: identity, marks, stray surnames, spelling of the book, given names; then
    what the listener confirmed."""
    words = spark.sql(_WORDS).where("name <> 'Anna'")
    passes = [entity.by_identity, entity.dropped_marks, lambda n: entity.stray_surnames(n, most=3), lambda n: entity.to_source_spelling(n, words), lambda n: entity.given_to_full(n, _PREFIXES)]
    confirmed = spark.createDataFrame([("Ca", "Boss")], "name string, target string")
    shown = ["Thu Lãnh", "Thu Lanh", "Thao", "Tháo", "an_na", "ANNA", "anna", "Anna Brow", "Anna Brown Lee", "Karlo", "Ca"]
    return entity.resolve(_cast(spark), passes, confirmed).where(F.col("name").isin(shown))


def _names(spark, sf_dir):
    """First and second words of part names and both together, with how often they occur."""
    p = table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("w"))
    each = p.select(F.explode(F.array(F.col("w")[0], F.concat_ws(" ", F.col("w")[0], F.col("w")[1]))).alias("name"))
    return each.where("name <> ''").groupBy("name").agg(F.count("*").alias("lines"))


_NAMES = """n AS (SELECT name, count(*) AS lines FROM (SELECT unnest([split_part(p_name, ' ', 1), rtrim(split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2))]) AS name FROM part) WHERE name <> '' GROUP BY 1)"""


@query(f"""WITH {_NAMES}, l AS (SELECT name, lines, string_split(name, ' ') AS w FROM n)
  SELECT a.name, arg_min(b.name, (len(b.w), -b.lines, b.name)) AS target FROM l a JOIN l b ON len(a.w) >= 2 AND a.lines <= 30 AND len(b.w) < len(a.w) AND starts_with(a.name, b.name || ' ')
  AND b.lines >= 10 * greatest(1, a.lines) GROUP BY a.name""")
def e3_stray_surnames(spark, sf_dir):
    return entity.stray_surnames(_names(spark, sf_dir), most=30)


@query("""WITH c AS (SELECT a.name AS name, count(*) AS m, min(b.name) AS target FROM
  (SELECT DISTINCT substr(c_name, 10) AS name FROM customer) a JOIN (SELECT DISTINCT substr(s_name, 10) AS name FROM supplier) b ON levenshtein(a.name, b.name) = 1 GROUP BY 1)
  SELECT name, target FROM c WHERE m = 1""")
def j18_fuzzy(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.expr("substr(c_name, 10)").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.expr("substr(s_name, 10)").alias("name"))
    return entity.fuzzy_unique(a, b, "name", 1)


@query("""WITH c AS (SELECT s_nationkey AS voice, s_suppkey AS holder, round(s_acctbal / 3000) AS r, max(round(s_acctbal / 3000)) OVER (PARTITION BY s_nationkey) AS top FROM supplier)
  SELECT voice, min(holder) AS holder FROM c WHERE r = top GROUP BY voice HAVING count(*) = 1""")
def e10_carry_over(spark, sf_dir):
    claims = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("voice"), F.col("s_suppkey").alias("holder"), F.round(F.col("s_acctbal") / 3000).alias("r"))
    return entity.carry_over(claims, "voice", "holder", [F.col("r")])


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 11 = 0 THEN 'confirmed ' || c_custkey END, n_name, c_name) AS canonical FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 1""")
def e7_alias_overlay(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    confirmed = F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit("confirmed "), F.col("c_custkey").cast("string")))
    return c.join(n, "c_nationkey", "left").select("c_custkey", F.coalesce(confirmed, "n_name", "c_name").alias("canonical"))


def _points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    x = lambda i: (F.col("embedding")[i].cast("double") * 4).alias("xy"[i])
    return e.select("vec_id", "label", x(0), x(1))


@query("""SELECT vec_id, least(4, greatest(0, floor((embedding[1]::DOUBLE * 4 + 1) / 2 * 5)))::INTEGER AS cx, least(4, greatest(0, floor((embedding[2]::DOUBLE * 4 + 1) / 2 * 5)))::INTEGER AS cy FROM embeddings""")
def m9_grid(spark, sf_dir):
    c = tx.grid_cell(F.col("x"), F.col("y"))
    return _points(spark, sf_dir).select("vec_id", c["cx"].alias("cx"), c["cy"].alias("cy"))


@query("""SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def m2_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(tx.cosine(F.col("embedding"), F.col("other")), 5).alias("sim"))


@query("""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 4 AS x, embedding[2]::DOUBLE * 4 AS y FROM embeddings),
  g AS (SELECT *, least(4, greatest(0, floor((x + 1) / 2 * 5))) AS cx, least(4, greatest(0, floor((y + 1) / 2 * 5))) AS cy FROM p),
  d AS (SELECT a.vec_id, b.vec_id AS near, sqrt(((a.x - b.x) * (a.x - b.x)) / 0.04 + 2 * ((a.y - b.y) * (a.y - b.y)) / 0.04) AS d FROM g a JOIN g b ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND a.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, near) AS rank FROM d WHERE d < 6) SELECT vec_id, near, rank::INTEGER AS rank, round(d, 5) AS d FROM r WHERE rank <= 3""")
def j17_grid_neighbours(spark, sf_dir):
    p = _points(spark, sf_dir).select("vec_id", "x", "y")
    near = select.nearest_in_grid(p, "vec_id", ("x", "y"), (1 / 0.04, 2 / 0.04), 6.0, 3)
    return near.select("vec_id", "near", "rank", F.round("d", 5).alias("d"))


@query("""SELECT a.vec_id, round(sqrt(coalesce(((a.embedding[1]::DOUBLE - b.embedding[1]::DOUBLE) ** 2 + 0.5 * b.embedding[3]::DOUBLE ** 2) / (a.embedding[4]::DOUBLE ** 2 + b.embedding[3]::DOUBLE ** 2 + 0.04), 0)
  + CASE WHEN b.vec_id % 3 = 0 THEN 0 ELSE 2 * ((a.embedding[2]::DOUBLE - b.embedding[2]::DOUBLE) ** 2) / 0.04 END), 5) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def m1_scaled_distance(spark, sf_dir):
    """Each vector to the next one on two axes, the second missing for every third."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"), (F.col("vec_id") % 3 == 0).alias("lacks"))
    a, b_, zero = F.col("a"), F.col("b"), F.lit(0.0)
    axes = [(a[0], a[3], b_[0], b_[2], 1.0), (a[1], zero, F.when(~F.col("lacks"), b_[1]), zero, 2.0)]
    return e.join(b, "vec_id").select("vec_id", F.round(tx.scaled_distance(axes), 5).alias("d"))


@query("""WITH c AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, abs(embedding[3]::DOUBLE) AS c, CASE WHEN vec_id % 5 > 0 THEN abs(embedding[4]::DOUBLE) END AS sd FROM embeddings)
  SELECT vec_id, round(CASE WHEN c >= 0.2 THEN x ELSE c / 0.2 * x + (1 - c / 0.2) * 0.15 END, 6) AS tx, round(CASE WHEN c >= 0.2 THEN y ELSE c / 0.2 * y - (1 - c / 0.2) * 0.55 END, 6) AS ty,
  round(sqrt(coalesce(sd, 0.35) ** 2 + (0.4 * (1 - least(1, c))) ** 2), 6) AS sigma, round(ln(exp(x) + exp(y)), 6) AS lse FROM c""")
def m3_m4_targets(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    e = e.select("vec_id", F.col("e")[0].alias("x"), F.col("e")[1].alias("y"), F.abs(F.col("e")[2]).alias("c"), F.when(F.col("vec_id") % 5 > 0, F.abs(F.col("e")[3])).alias("sd"))
    x, y = select.pull(F.col("x"), F.col("y"), F.col("c"))
    sigma, lse = select.spread_of(F.col("sd"), F.col("c")), select.log_sum_exp(F.array("x", "y"))
    return e.select("vec_id", F.round(x, 6).alias("tx"), F.round(y, 6).alias("ty"), F.round(sigma, 6).alias("sigma"), F.round(lse, 6).alias("lse"))


def _state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_type", "value", "event_id", (F.floor(micros("ts") / 864e8)).cast("long").alias("day"), (F.col("event_id") % 2 == 1).alias("incoming"))


def _newest(sign: str) -> str:
    return f"""WITH s AS (SELECT *, epoch_us(ts) // 86400000000 AS day FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY day DESC, (event_id % 2) {sign}, event_id DESC) AS n FROM s)
      SELECT user_id, event_type, value, day FROM r WHERE n = 1"""


@query(_newest("ASC"))
def l1_last_writer(spark, sf_dir):
    return merge.last_writer(_state(spark, sf_dir), ["user_id", "event_type"], "day", "value", F.col("incoming"), False, ["event_id"])


@query(_newest("DESC") + " AND user_id % 10 <> 3")
def l2_bookmarks(spark, sf_dir):
    s = _state(spark, sf_dir)
    newest = merge.last_writer(s, ["user_id", "event_type"], "day", "value", F.col("incoming"), True, ["event_id"])
    return merge.drop_tombstones(newest, s.where("user_id % 10 = 3"), ["user_id"])


@query("""WITH s AS (SELECT user_id, event_id // 2 AS session, epoch_us(ts) AS started, event_id % 2 AS inc FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY inc DESC, started DESC) AS r FROM s),
  k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY started DESC, session DESC) AS n FROM o WHERE r = 1) SELECT user_id, session, started FROM k WHERE n <= 20""")
def l3_sessions(spark, sf_dir):
    s = table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 2).cast("long").alias("session"), micros("ts").alias("started"), (F.col("event_id") % 2 == 1).alias("inc"))
    return merge.keep_sessions(s, ["user_id"], "session", "started", F.col("inc"), 20).select("user_id", "session", "started")


@query("""WITH a AS (SELECT p_partkey AS k, p_brand AS v, p_size AS s FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE p_brand END AS v, p_size + 1 AS s FROM part WHERE p_partkey % 5 <> 0)
  SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v, len(list_distinct(list_filter_null)) AS n_set, coalesce(a.v <> b.v, false) AS conflict FROM a FULL JOIN b ON a.k = b.k, LATERAL (SELECT [a.s, b.s] AS list_filter_null)""")
def l6_merge_edits(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v"), F.array("p_size").alias("s"))
    b = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("v"), F.array(F.col("p_size") + 1).alias("s"))
    return merge.merge_edits(a, b, "k", "v", "s").select("k", "v", F.size("s").cast("long").alias("n_set"), "conflict")


@query("""WITH p AS (SELECT source, doc_id || '=' || md5(text) AS line, substr(md5(doc_id::VARCHAR), 1, 3) AS part FROM documents),
  h AS (SELECT source, part, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM p GROUP BY source, part) SELECT source, sha256(string_agg(part || '=' || digest, chr(10) ORDER BY part)) AS key FROM h GROUP BY source""")
def l8_content_key(spark, sf_dir):
    """One key for all documents of a source: digests of 4096 parts, then of those, so that no task
    holds a source."""
    d = table(spark, sf_dir, "documents")
    return merge.content_keys(d, "source", F.col("doc_id").cast("string"), F.md5("text"))


@query("""SELECT event_id, list_sort(list_distinct([event_type, CASE WHEN value > 50 THEN 'big' ELSE 'small' END])) AS codes, len([x for x in [event_type, CASE WHEN value > 50 THEN 'big' ELSE 'small' END] if x NOT IN ('view', 'small')])::INTEGER AS blocking FROM events""")
def u3_u7_code_sets(spark, sf_dir):
    codes = F.split(F.concat_ws("|", "event_type", F.when(F.col("value") > 50, "big").otherwise("small")), r"\|")
    blocking = F.size(F.array_except(codes, F.array(F.lit("view"), F.lit("small"))))
    return table(spark, sf_dir, "events").select("event_id", F.array_sort(F.array_union(codes, F.array().cast("array<string>"))).alias("codes"), blocking.alias("blocking"))


def _scenes(spark, sf_dir):
    """Every event is a scene of its user; its tracks are the five nations of a region."""
    e = table(spark, sf_dir, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("scene"), "event_id", "value", F.pmod(F.length("event_type"), F.lit(5)).alias("n_regionkey"))
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").alias("track")))  # 25 rows
    return e.join(n, "n_regionkey").select("user_id", "scene", "event_id", "track", F.abs(F.col("value") - F.col("track") * 4).alias("cost"))


@query()
def w11_tracks(spark, sf_dir):
    """Sequential: held against a plain loop in the tests."""
    return select.pick_tracks(_scenes(spark, sf_dir), "user_id", "scene", "track", "cost").drop("pinned")


@query()
def e17_pinned_tracks(spark, sf_dir):
    """Every 50th event pins track 0, every 20th keeps track 7, and every seventh user has banned 3 and 7."""
    s = _scenes(spark, sf_dir)
    one = s.select("user_id", "scene", "event_id").distinct()
    pins = one.where("event_id % 50 = 0").withColumn("track", F.lit(0))
    kept = one.where("event_id % 20 = 0").withColumn("track", F.lit(7))
    banned = one.where("user_id % 7 = 0").select("user_id", F.explode(F.array(F.lit(3), F.lit(7))).alias("track"))
    return select.pick_tracks(s, "user_id", "scene", "track", "cost", pins=pins, kept=kept, banned=banned)


@query()
def e8_voices(spark, sf_dir):
    """Customers of a nation as its cast, their orders' months as chapters, its suppliers as voices."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("lines"), F.sort_array(F.collect_set(F.date_format("o_orderdate", "yyyy-MM"))).alias("chapters"))
    v = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_name")
    return seq.allocate_voices(c.join(o, "o_custkey"), v, "nation", "o_custkey", "lines", "chapters", "s_name")
