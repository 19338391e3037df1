"""Queries of chains, runs, voices and names whose rules look beyond neighbouring rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from versehall.operators import chains, dialogue, names
from versehall.operators.intervals import micros
from versehall.plans.registry import query, table
from versehall.plans.texts import _FOLD


def _timed(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", (micros("ts") / 1e6).alias("s"))
    return e.withColumn("minute", F.floor(F.col("s") / 60).cast("long"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) // 60000000 AS a, epoch_us(ts) // 60000000 + floor(value)::BIGINT * 10 AS z,
    CASE WHEN value < 20 THEN ['m'] WHEN value > 60 THEN ['f'] ELSE [] END AS g, CASE event_id % 4 WHEN 0 THEN ['old'] WHEN 1 THEN ['young', 'old'] ELSE [] END AS y FROM events),
  n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY a, event_id) AS r FROM e),
  f AS (SELECT user_id, event_type, r, event_id, event_id AS canonical, z, g, y FROM n WHERE r = 1
        UNION ALL SELECT n.user_id, n.event_type, n.r, n.event_id, CASE WHEN j THEN f.canonical ELSE n.event_id END, CASE WHEN j THEN greatest(f.z, n.z) ELSE n.z END,
               CASE WHEN j THEN list_distinct(f.g || n.g) ELSE n.g END, CASE WHEN j THEN list_distinct(f.y || n.y) ELSE n.y END
        FROM f JOIN n ON n.user_id = f.user_id AND n.event_type = f.event_type AND n.r = f.r + 1,
             LATERAL (SELECT n.a > f.z AND n.a - f.z <= 10080 AND (len(f.g) = 0 OR len(n.g) = 0 OR list_has_any(f.g, n.g)) AND (len(f.y) = 0 OR len(n.y) = 0 OR list_has_any(f.y, n.y)) AS j))
  SELECT user_id, event_type, event_id, canonical FROM f""")
def w9_trait_islands(spark, sf_dir):
    """A user's events of a type as appearances of one kind of person, joined over at most a week
    while what is known of sex and age does not contradict."""
    e = _timed(spark, sf_dir).withColumn("until", F.col("minute") + F.floor("value").cast("long") * 10)
    none = F.array().cast("array<string>")
    e = e.withColumn("sex", F.when(F.col("value") < 20, F.array(F.lit("m"))).when(F.col("value") > 60, F.array(F.lit("f"))).otherwise(none))
    e = e.withColumn("age", F.when(F.col("event_id") % 4 == 0, F.array(F.lit("old"))).when(F.col("event_id") % 4 == 1, F.array(F.lit("young"), F.lit("old"))).otherwise(none))
    return chains.trait_islands(e, ["user_id", "event_type"], "minute", "until", "event_id", ["sex", "age"], 10080)


def _related(spark, sf_dir):
    """Events with their relation to the user's event before: within an hour, a day, or later."""
    e = _timed(spark, sf_dir)
    gap = F.col("s") - F.lag("s").over(Window.partitionBy("user_id").orderBy("s", "event_id"))
    return e.withColumn("relation", F.when(gap <= 3600, "near").when(gap <= 86400, "far").when(gap.isNotNull(), "apart"))


@query("""WITH p AS (SELECT event_type AS t, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w AS gap FROM events
    WHERE user_id % 5 <> 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  c AS (SELECT CASE WHEN gap <= 3600 THEN 'near' WHEN gap <= 86400 THEN 'far' ELSE 'apart' END AS relation, CASE WHEN t = a THEN 'same' WHEN t = b THEN 'back' ELSE 'other' END AS pattern FROM p WHERE gap IS NOT NULL),
  n AS (SELECT relation, pattern, count(*) AS n FROM c GROUP BY ALL), g AS (SELECT relation, unnest(['same', 'back', 'other']) AS pattern, sum(n) AS total FROM n GROUP BY relation)
  SELECT g.relation, g.pattern, coalesce(n.n, 0) AS n, round((coalesce(n.n, 0) + 1) / (total + 3), 6) AS share FROM g LEFT JOIN n USING (relation, pattern)""")
def a28_relations(spark, sf_dir):
    """Learned on four fifths of the users."""
    e = _related(spark, sf_dir).where("user_id % 5 <> 0")
    t = chains.learn_transitions(e, ["user_id"], ["s", "event_id"], F.col("event_type"), F.col("relation"))
    return t.withColumn("share", F.round("share", 6))


@query()
def m7_learned(spark, sf_dir):
    """Types of the other fifth's events by their values and the learned transitions: the likelihood of a type
    by value, and the transition tables by relation, come from four fifths of the users."""
    e = _related(spark, sf_dir).withColumn("bin", F.least(F.floor(F.col("value") / 10), F.lit(20)).cast("int"))
    known = e.where("user_id % 5 <> 0")
    table_ = chains.learn_transitions(known, ["user_id"], ["s", "event_id"], F.col("event_type"), F.col("relation"))
    seen = known.groupBy("bin", "event_type").agg(F.count("*").alias("n"))
    grid = e.sparkSession.range(21).select(F.col("id").cast("int").alias("bin")).crossJoin(known.select("event_type").distinct())  # 21 bins x the kinds of events
    counts = grid.join(seen, ["bin", "event_type"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    per_bin = counts.groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("event_type", "n"))).alias("c"), F.sum("n").alias("all"))
    per_bin = per_bin.select("bin", F.transform("c", lambda x: F.log(x["n"] / F.col("all"))).alias("scores"), F.transform("c", lambda x: x["event_type"]).alias("labels"))
    rows = e.where("user_id % 5 = 0").join(F.broadcast(per_bin), "bin")  # 21 rows
    got = chains.decode_chains(rows, ["user_id"], ["s", "event_id"], "event_id", F.col("scores"), F.col("relation"), table_)
    label = F.element_at("labels", F.col("choice") + 1)
    return got.join(rows.select("user_id", "event_id", "event_type", "labels"), ["user_id", "event_id"]).select("user_id", "event_id", "event_type", label.alias("decoded"))


#: Terms of address here: short words of the invented prose that are neither rare nor everywhere.
_TERMS = "he re ha or ed le st ea ou nd nt wh ti el this that with from for was are by at an un que des les die das und den von zu ist".split()
_SELVES = "he re le".split()


@query(rf"""WITH RECURSIVE s AS (SELECT conv_id, turn, role, unnest(string_split_regex(lower(text), '[.!?\n]')) AS part, generate_subscripts(string_split_regex(lower(text), '[.!?\n]'), 1) AS k FROM conversations),
  o AS MATERIALIZED (SELECT conv_id, role, turn * 1000 + k - 1 AS line, w AS t FROM (SELECT *, unnest(regexp_extract_all(part, '\p{{L}}+')) AS w FROM s) WHERE w IN ({", ".join(f"'{t}'" for t in _TERMS)})),
  f AS (SELECT conv_id, role, line, min(t) AS f FROM o GROUP BY ALL), e AS (SELECT DISTINCT conv_id, role, t AS a, f AS b FROM o JOIN f USING (conv_id, role, line)),
  b AS MATERIALIZED (SELECT conv_id, role, a, b FROM e UNION SELECT conv_id, role, b, a FROM e),
  r AS (SELECT DISTINCT conv_id, role, a AS v, a AS m FROM b UNION SELECT b.conv_id, b.role, b.b, r.m FROM r JOIN b ON b.conv_id = r.conv_id AND b.role = r.role AND b.a = r.v),
  c AS (SELECT conv_id, role, v AS t, min(m) AS voice FROM r GROUP BY ALL),
  g AS (SELECT o.conv_id, o.role, o.t, c.voice, count(*) AS n FROM o JOIN c USING (conv_id, role, t) GROUP BY ALL),
  l AS (SELECT f.conv_id, f.role, c.voice, count(*) AS lines, min(line) AS begins FROM f JOIN c ON c.conv_id = f.conv_id AND c.role = f.role AND c.t = f.f GROUP BY ALL),
  w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY lines DESC, begins) AS place FROM l WHERE lines >= 2),
  x AS (SELECT g.*, w.place FROM g JOIN w USING (conv_id, role, voice) WHERE place <= 2),
  k AS (SELECT conv_id, role, place, count(*) AS kinds, list(t) FILTER (t IN ({", ".join(f"'{t}'" for t in _SELVES)})) AS selves FROM x GROUP BY ALL),
  p AS (SELECT a.conv_id, a.role FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.role = b.role AND a.place = 1 AND b.place = 2
        WHERE (len(a.selves) > 0 AND len(b.selves) > 0 AND NOT list_has_any(a.selves, b.selves)) OR least(a.kinds, b.kinds) >= 2),
  y AS (SELECT role, t, count(*) AS every FROM o GROUP BY ALL), z AS (SELECT conv_id, role, count(*) AS own FROM o GROUP BY ALL), q AS (SELECT role, count(*) AS size FROM o GROUP BY ALL),
  h AS (SELECT x.conv_id, x.role, x.place, sum(n * ln((every - n + 0.5e0) / (size - own + 0.5e0 * {len(_TERMS)}))) / sum(n) AS fit, list_sort(list(x.t)) AS terms
        FROM x JOIN p USING (conv_id, role) JOIN y USING (role, t) JOIN z USING (conv_id, role) JOIN q USING (role) WHERE size - own >= 8 GROUP BY ALL)
  SELECT a.conv_id, a.role, a.terms AS odd, b.terms AS usual, round(b.fit - a.fit, 4) AS margin FROM h a JOIN h b ON a.conv_id = b.conv_id AND a.role = b.role AND a.place <> b.place WHERE b.fit - a.fit >= 0.5""")
def e18_split_doubts(spark, sf_dir):
    """Roles as labels, conversations as chapters, sentences as lines."""
    c = table(spark, sf_dir, "conversations")
    s = c.select("conv_id", "turn", "role", F.posexplode(F.split(F.lower("text"), r"[.!?\n]")).alias("k", "part"))
    t = s.select("conv_id", "role", (F.col("turn") * 1000 + F.col("k")).alias("line"), F.explode(F.regexp_extract_all("part", F.lit(r"\p{L}+"), F.lit(0))).alias("t")).where(F.col("t").isin(_TERMS))
    found = dialogue.split_doubts(t, "role", "conv_id", "line", "t", _SELVES, len(_TERMS))
    return found.select("conv_id", "role", "odd", "usual", F.round("margin", 4).alias("margin"))


_LABEL = "[a-z,;] ([A-Z][a-z]+(?: [A-Z][a-z]+)?)"
_GAP = r"[^\p{L}\p{M}\p{N}]{2,}|[^\p{L}\p{M}\p{N} ]"


def _links_sql(labels: str) -> str:
    """Links between the labels that `labels` gives, by words in place of characters."""
    return rf"""WITH l AS ({labels}), m AS (SELECT label, lower(label) AS folded, string_split(lower(label), ' ') AS ws FROM l),
  f AS (SELECT DISTINCT label, folded, unnest(list_distinct([folded] || CASE WHEN len(ws) > 1 THEN [x for x in [ws[1], ws[-1]] if length(x) >= 3] ELSE [] END)) AS form FROM m),
  i AS (SELECT label, folded, form, form = folded AS whole, len(string_split(form, ' ')) AS k FROM f UNION ALL SELECT NULL, NULL, unnest(['of', 'with the']), NULL, unnest([1, 2])),
  t AS (SELECT row_number() OVER () AS doc, string_split(regexp_replace(translate({_FOLD.format('text')}, 'đ', 'd'), '{_GAP}', ' | ', 'g'), ' ') AS t FROM documents WHERE text IS NOT NULL),
  w AS (SELECT doc, a, k, array_to_string(t[a:a + k - 1], ' ') AS form FROM (SELECT doc, t, unnest(range(1, len(t) + 1)) AS a FROM t), (VALUES (1), (2)) v(k) WHERE a + k - 1 <= len(t)),
  h AS MATERIALIZED (SELECT doc, a, a + i.k AS z, label, folded, whole FROM w JOIN i USING (form, k)),
  n AS (SELECT doc, a, z, label, folded, whole FROM h WHERE label IS NOT NULL),
  e AS (SELECT doc, z AS at, a AS la, label AS ll, folded AS lf, whole AS lw FROM n UNION SELECT n.doc, h.z, n.a, n.label, n.folded, false FROM n JOIN h ON h.doc = n.doc AND h.a = n.z AND h.label IS NULL),
  p AS (SELECT n.doc, n.a, n.label, n.whole, e.* EXCLUDE (doc) FROM n JOIN e ON e.doc = n.doc AND e.at = n.a
        WHERE NOT contains(folded, lf) AND NOT contains(lf, folded) AND NOT list_has_any(string_split(folded, ' '), string_split(lf, ' '))),
  b AS (SELECT doc, la AS place, ll AS epithet, label AS name FROM p WHERE lw UNION SELECT doc, a, label, ll FROM p WHERE whole)
  SELECT epithet, name, count(*) AS n FROM b GROUP BY ALL"""


@query(_links_sql(f"SELECT DISTINCT unnest(regexp_extract_all(text, '{_LABEL}', 1)) AS label FROM documents"))
def e20_epithet_links(spark, sf_dir):
    """Names are the capitalised words inside sentences, of one or two words."""
    d = table(spark, sf_dir, "documents")
    labels = d.select(F.explode(F.regexp_extract_all("text", F.lit(_LABEL), F.lit(1))).alias("label")).distinct()
    return names.epithet_links(d, "text", labels, "label", ["of", "with the"])


@query(_links_sql("SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{7,}')) AS label FROM benchmark"))
def e20_cast_links(spark, sf_dir):
    """As `e20_epithet_links`, for a cast that does not grow with the documents: the longer words of the benchmark's passages."""
    labels = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{7,}"), F.lit(0))).alias("label")).distinct()
    return names.epithet_links(table(spark, sf_dir, "documents"), "text", labels, "label", ["of", "with the"])
