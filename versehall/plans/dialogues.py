"""Queries over dialogue words and findings."""

from pyspark.sql import functions as F

from versehall.functions import readings
from versehall.operators import dialogue as dl
from versehall.plans.registry import query, table


@query("""WITH o AS (SELECT conv_id, turn, role, w AS word, count(*) AS n FROM (SELECT conv_id, turn, role, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM conversations) GROUP BY ALL),
  p AS (SELECT role, word, sum(n) AS c FROM o GROUP BY ALL), t AS (SELECT role, sum(c) AS size FROM p GROUP BY ALL), v AS (SELECT count(DISTINCT word) AS v FROM p), s AS (SELECT conv_id, turn, role, sum(n) AS m FROM o GROUP BY ALL),
  h AS (SELECT o.conv_id, o.turn, o.role, p.role AS by_, sum(n * ln(greatest(c - CASE WHEN o.role = p.role THEN n ELSE 0 END, 0) + 0.5)) AS seen, sum(n) AS k FROM o JOIN p USING (word) GROUP BY ALL),
  f AS (SELECT conv_id, turn, h.role, by_, seen + (m - k) * ln(0.5) - m * ln(size - CASE WHEN h.role = by_ THEN m ELSE 0 END + 0.5 * v) AS score FROM h JOIN s USING (conv_id, turn) JOIN t ON t.role = by_, v),
  b AS (SELECT conv_id, turn, role, arg_max(by_, score) AS likelier, max(score) AS best FROM f WHERE by_ <> role GROUP BY ALL)
  SELECT b.conv_id, b.turn, b.role, likelier, round(best - score, 4) AS margin FROM b JOIN f ON f.conv_id = b.conv_id AND f.turn = b.turn AND f.by_ = b.role WHERE best - score >= 1""")
def e19_cue_doubt(spark, sf_dir):
    out = dl.cue_doubt(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "role", "text")
    return out.select("conv_id", "turn", "role", "likelier", F.round("margin", 4).alias("margin"))


@query("""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\\p{L}])(The|For|And) (\\p{Lu}\\p{L}+)', 1)) AS title, unnest(regexp_extract_all(text, '(?:^|[^\\p{L}])(The|For|And) (\\p{Lu}\\p{L}+)', 2)) AS name FROM documents)
  SELECT title, name, count(*) AS n, count(DISTINCT doc_id) AS docs FROM x GROUP BY title, name""")
def e20_epithets(spark, sf_dir):
    return dl.epithets(table(spark, sf_dir, "documents"), "doc_id", "text", ["The", "For", "And"])


@query("""SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click') AND event_id NOT IN (SELECT event_id FROM events WHERE value > 80)""")
def e22_blockers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return dl.blockers(e, "event_id", "event_type", ["view", "click"], e.where("value > 80")).select("event_id", "event_type")


#: The kinds of findings in order of their rules: severity, doubt, and the events that show them here.
_FINDINGS = [
    ("speaker", 1.0, 0.85, "event_type = 'click' AND value > 90"), ("gender", 1.0, 0.5, "event_type = 'view' AND value > 90"), ("turn", 1.0, 0.9, "event_id % 97 = 0"),
    ("bracket", 1.0, 0.8, "event_id % 89 = 1"), ("vocative", 0.9, 0.7, "value BETWEEN 40 AND 42"), ("audio", 0.9, 0.5, "value > 75"), ("alias", 0.8, 0.6, "user_id % 50 = 7"),
    ("shared-voice", 0.6, 0.8, "value < 1"), ("pronunciation", 0.5, 0.35, "event_id % 31 = 5"), ("unnamed", 0.3, 0.4, "event_type = 'purchase'"),
]


@query("WITH f AS (" + " UNION ALL ".join(f"SELECT event_id, '{k}' AS kind, {i} AS rule, floor(value) * {d}e0 * {w}e0 AS raw FROM events WHERE {c}" for i, (k, w, d, c) in enumerate(_FINDINGS)) + """),
  o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY rule) AS r FROM f) SELECT event_id, kind, rule, round(raw, 3) AS score FROM o WHERE r = 1""")
def e21_work_items(spark, sf_dir):
    """Ten kinds of findings; a line asked about by an earlier rule is not asked again."""
    e = table(spark, sf_dir, "events")
    found = [e.where(c).select("event_id", F.lit(k).alias("kind"), F.floor("value").cast("double").alias("affected"), F.lit(d).alias("doubt")) for k, _, d, c in _FINDINGS]
    return dl.work_items(found, {k: w for k, w, _, _ in _FINDINGS}, "event_id")


@query("""WITH s AS (SELECT event_type, round(floor(value) * 0.85e0, 3) AS score, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, round(sum(score * n), 2) AS score FROM s GROUP BY event_type""")
def s6_priority(spark, sf_dir):
    """What all findings of a kind weigh together."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.floor("value").cast("double").alias("affected"), F.lit(0.85).alias("doubt"))
    items = dl.work_items([e], {k: 1.0 for k in ("view", "click", "purchase", "signup", "error")}, "event_id")
    return items.groupBy(F.col("kind").alias("event_type")).agg(F.round(F.sum("score"), 2).alias("score"))


@query("""WITH c AS (SELECT lang, source, count(*) FILTER (WHERE n_chars > 2000) AS d, count(*) FILTER (WHERE n_chars <= 2000) AS n FROM documents GROUP BY ALL), r AS (SELECT *, (d + 1) / (n + 1) AS ratio FROM c),
  k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ratio DESC, d DESC, source DESC) AS p FROM r WHERE ratio >= 0.5) SELECT lang, source AS name, round(ratio, 6) AS ratio FROM k WHERE p = 1""")
def e24_narrator(spark, sf_dir):
    m = table(spark, sf_dir, "documents").select("lang", F.col("source").alias("name"), F.when(F.col("n_chars") > 2000, "dialogue").otherwise("narration").alias("kind"))
    return dl.narrator(m, "lang", F.col("kind"), m, 0.5).select("lang", "name", F.round("ratio", 6).alias("ratio"))


@query("""WITH u AS (SELECT conv_id, turn, length(text) AS w, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations)
  SELECT a.conv_id, a.turn, min(b.turn) AS first, max(b.turn) AS last FROM u a JOIN u b ON a.conv_id = b.conv_id AND ((b.turn <= a.turn AND a.upto - a.w - (b.upto - b.w) <= 400) OR (b.turn >= a.turn AND b.upto - a.upto <= 400)) GROUP BY a.conv_id, a.turn""")
def w12_context(spark, sf_dir):
    return dl.context_budget(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text"), 800)


@query("""WITH g AS (SELECT unnest([0.5, 1.0, 2.0, 4.0]) AS t), e AS (SELECT vec_id, t, ln(exp(embedding[1]::DOUBLE * 9 / t) + exp(embedding[2]::DOUBLE * 9 / t)) - CASE WHEN label % 2 = 0 THEN embedding[1]::DOUBLE * 9 / t ELSE embedding[2]::DOUBLE * 9 / t END AS nll FROM embeddings, g),
  s AS (SELECT t, sum(nll) AS nll FROM e GROUP BY t) SELECT arg_min(t, nll)::DOUBLE AS t, round(min(nll), 4) AS nll FROM s""")
def m6_temperature(spark, sf_dir):
    z = F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double") * 9)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(z).alias("k", "z"))
    out = dl.temperature(rows, "vec_id", "z", F.col("k") == F.col("label") % 2, [0.5, 1.0, 2.0, 4.0])
    return out.select("t", F.round("nll", 4).alias("nll"))


@query("""WITH n AS (SELECT o_orderkey, floor(o_totalprice * 10007)::BIGINT % 1000000000000 AS n FROM orders), d AS (SELECT ['không', 'một', 'hai', 'ba', 'bốn', 'năm', 'sáu', 'bảy', 'tám', 'chín'] AS d),
  g AS (SELECT o_orderkey, n, i, (n // (1000 ** i)::BIGINT) % 1000 AS g, n >= (1000 ** (i + 1))::BIGINT AS inner_ FROM n, (SELECT unnest([0, 1, 2, 3]) AS i)),
  w AS (SELECT o_orderkey, i, concat_ws(' ', CASE WHEN inner_ OR g >= 100 THEN d[g // 100 + 1] || ' trăm' END,
    CASE WHEN g % 100 >= 20 THEN d[g % 100 // 10 + 1] || ' mươi' WHEN g % 100 >= 10 THEN 'mười' WHEN g % 10 > 0 AND (inner_ OR g >= 100) THEN 'lẻ' END,
    CASE WHEN g % 100 > 20 AND g % 10 = 1 THEN 'mốt' WHEN g % 100 > 20 AND g % 10 = 4 THEN 'tư' WHEN g % 100 > 10 AND g % 10 = 5 THEN 'lăm' WHEN g % 10 > 0 THEN d[g % 10 + 1] END)
    || ['', ' nghìn', ' triệu', ' tỷ'][i + 1] AS t FROM g, d WHERE g > 0)
  SELECT o_orderkey, string_agg(t, ' ' ORDER BY i DESC) AS words FROM w GROUP BY o_orderkey""")
def f5_number_words(spark, sf_dir):
    n = F.floor(F.col("o_totalprice") * 10007).cast("long") % 1_000_000_000_000
    return table(spark, sf_dir, "orders").select("o_orderkey", readings.number_words(n).alias("words"))
