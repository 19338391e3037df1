"""Queries of scores, thresholds, order statistics and readings by their full rules."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from versehall.functions import readings as rd
from versehall.functions import speech as sp
from versehall.functions import passages as ps
from versehall.functions import text as tx
from versehall.operators import chains, dialogue, ordering, scoring
from versehall.operators import intervals as iv
from versehall.plans.registry import query, table


@query("""SELECT round(median(value), 6) AS med, round(min(value), 6) AS low, round(max(value) - min(value), 6) AS spread, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.95), 6) AS p95 FROM events""")
def a13_by_histogram(spark, sf_dir):
    """As `a13_percentiles`, without one task that holds the values."""
    e = table(spark, sf_dir, "events")
    q = ordering.quantiles(e, [], F.col("value"), [0.0, 0.05, 0.5, 0.95, 1.0])
    at = lambda s: F.max(F.when(F.col("share") == s, F.col("quantile")))
    r = lambda c, name: F.round(c, 6).alias(name)
    return q.agg(r(at(0.5), "med"), r(at(0.0), "low"), r(at(1.0) - at(0.0), "spread"), r(at(0.05), "p05"), r(at(0.95), "p95"))


@query("""SELECT event_type, round(median(value), 6) AS med, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type""")
def a14_by_histogram(spark, sf_dir):
    """As `a14_group_percentiles`, without a task a type."""
    q = ordering.quantiles(table(spark, sf_dir, "events"), ["event_type"], F.col("value"), [0.05, 0.5, 0.95])
    at = lambda s: F.round(F.max(F.when(F.col("share") == s, F.col("quantile"))), 6)
    return q.groupBy("event_type").agg(at(0.5).alias("med"), at(0.05).alias("p05"), at(0.95).alias("p95"))


@query("""WITH r AS (SELECT doc_id, toxic, n_chars, row_number() OVER (PARTITION BY toxic ORDER BY n_chars DESC) AS r, count(*) OVER (PARTITION BY toxic) AS n FROM labels JOIN documents USING (doc_id)),
  c AS (SELECT toxic, n_chars AS cut FROM r WHERE r = greatest(1, floor(n * 0.4))) SELECT doc_id, r.toxic FROM r JOIN c ON r.toxic IS NOT DISTINCT FROM c.toxic AND r.n_chars >= c.cut""")
def s15_threshold(spark, sf_dir):
    """The longest two fifths of the documents of either label, ties at the cut included."""
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", "toxic", "n_chars")
    return ordering.keep_by_threshold(both, ["toxic"], F.col("n_chars"), 0.4).select("doc_id", "toxic")


@query("""WITH p AS (SELECT l_orderkey, CASE WHEN l_returnflag <> 'N' THEN l_returnflag || l_linestatus END AS label, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
  s AS (SELECT l_orderkey, label, q / sum(q) OVER (PARTITION BY l_orderkey) AS p FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC, label NULLS LAST) AS r FROM s),
  m AS (SELECT a.l_orderkey, a.label, round(ln(greatest(a.p, 1e-12)) - ln(greatest(coalesce(b.p, 0), 1e-12)), 9) AS margin FROM r a LEFT JOIN r b ON a.l_orderkey = b.l_orderkey AND b.r = 2 WHERE a.r = 1),
  o AS (SELECT *, label IS NOT NULL AS named, row_number() OVER (PARTITION BY label IS NOT NULL ORDER BY margin DESC) AS k, count(*) OVER (PARTITION BY label IS NOT NULL) AS n FROM m),
  c AS (SELECT named, margin AS cut FROM o WHERE k = greatest(1, floor(n * 0.3))) SELECT l_orderkey, label, round(margin, 6) AS margin FROM o JOIN c USING (named) WHERE margin >= cut""")
def e25_pseudo_labels(spark, sf_dir):
    """An order's kinds of lines by their share as probabilities, open lines as the class of none: the orders
    whose first kind leads the second by most, by class."""
    li = table(spark, sf_dir, "lineitem").withColumn("label", F.when(F.col("l_returnflag") != "N", F.concat("l_returnflag", "l_linestatus")))
    li = li.select("l_orderkey", "label", "l_quantity").repartition("l_orderkey")  # the one shuffle of the lines
    p = li.groupBy("l_orderkey", "label").agg(F.sum("l_quantity").alias("q"))
    p = p.withColumn("p", F.col("q") / F.sum("q").over(Window.partitionBy("l_orderkey")))
    m = ordering.margins(p, ["l_orderkey"], "label", "p").withColumn("margin", F.round("margin", 9)).withColumn("named", F.col("label").isNotNull())
    return ordering.keep_by_threshold(m, ["named"], F.col("margin"), 0.3).select("l_orderkey", "label", F.round("margin", 6).alias("margin"))


@query("""WITH e AS (SELECT epoch_us(ts) / 1e6 AS s FROM events), n AS (SELECT max(s) AS now FROM e), r AS (SELECT count(*) AS n, max(now) - min(s) AS span FROM e, n WHERE s >= now - 864000 AND s <= now)
  SELECT n, CASE WHEN n >= 12 THEN round(n / greatest(60.0, span), 6) END AS rate FROM r""")
def w15_recent_rate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((iv.micros("ts") / 1e6).alias("s"))
    e = e.crossJoin(F.broadcast(e.agg(F.max("s").alias("now"))))  # one row
    return iv.recent_rate(e, F.col("s"), F.col("now"), 864_000)


@query("""WITH w AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM documents) x WHERE regexp_full_match(w, '(?i)[ivxlcdm]+')),
  v AS (SELECT w, [CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 ELSE 1000 END for c in string_split(w, '')] AS n FROM w)
  SELECT w AS token, CASE WHEN regexp_matches(w, '^M*(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$') AND (length(w) > 1 OR w = 'I') THEN list_sum([CASE WHEN i < len(n) AND n[i] < n[i + 1] THEN -n[i] ELSE n[i] END for i in range(1, len(n) + 1)])::INTEGER END AS value FROM v""")
def f4_roman_numerals(spark, sf_dir):
    """Words of the documents made of numerals' letters, as they stand: "mi" and "C" are none."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("token"))
    return w.where("token RLIKE '(?i)^[ivxlcdm]+$'").distinct().withColumn("value", rd.roman_numeral(F.col("token")))


_CRIES = "Hahaha! Aaaah, argh [Sigh] hmm... hAAAIz huhu Áaaa ôaaa haha1 [cười]..... hehehehehehehehehe oooh grh ƯƯƯƯ ha"
_LAUGH = "|".join(f"(?:{x}){{2,8}}" for x in sp.LAUGHS)
_VOWEL = "(?:" + "|".join(f"{v}{{3,}}" for v in sp.VOWELS) + ")h*"
_SOUNDS = "regexp_replace(text, '([a-z])\\. ([A-Z])', '\\1. " + _CRIES + " \\2', 'g')"
for _cue, _sound in sp.SOUNDS.items():
    _SOUNDS = f"regexp_replace({_SOUNDS}, '\\[" + _cue.replace(" ", "\\s+") + f"\\]', '{_sound}', 'gi')"


@query(rf"""WITH s AS (SELECT doc_id, regexp_extract_all({_SOUNDS}, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_]+') AS w FROM documents),
  t AS (SELECT doc_id, [CASE WHEN regexp_full_match(lower(x), '{sp.PAIN}') THEN 'Á' WHEN regexp_full_match(lower(x), 'ha+i+z+') THEN 'Hầy' WHEN regexp_full_match(lower(x), 'hừ+m+|h+m+') THEN 'Hừm'
    WHEN regexp_full_match(lower(x), '{_LAUGH}') THEN upper(x[1]) || substr(rtrim(repeat(lower(x[1:2]) || ' ', least(4, length(x) // 2))), 2)
    WHEN regexp_full_match(lower(x), '[À-ỹ]{_VOWEL}') THEN CASE WHEN translate(lower(x[1]), '{"".join(sp._TONED)}', '{"".join(sp._TONED.values())}') = lower(x[2]) THEN x[1] || '... ' || lower(x[2]) ELSE x END
    WHEN regexp_full_match(lower(x), '{_VOWEL}') THEN upper(x[1]) || '... ' || lower(x[1]) ELSE x END FOR x IN w] AS w FROM s)
  SELECT doc_id, md5(regexp_replace(array_to_string(w, ''), '\.{{4,}}', '...', 'g')) AS digest FROM t""")
def f3_cries(spark, sf_dir):
    """Documents with cries and laughs put between their sentences."""
    marked = F.regexp_replace("text", r"([a-z])\. ([A-Z])", f"$1. {_CRIES} $2")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(sp.spoken_cries(marked)).alias("digest"))


#: Gold rows and answers made of events: (table alias suffix n) an annotator n's reading of each event.
def _reading(n: int) -> str:
    return f"""SELECT event_id, CASE (event_id + {n}) % 5 WHEN 0 THEN ['narration'] WHEN 1 THEN ['narration', 'thought'] ELSE ['dialogue'] END AS kinds,
      CASE WHEN value > 60 THEN [{{'name': event_type, 'credit': 1.0::DOUBLE}}, {{'name': 'view', 'credit': 0.5::DOUBLE}}] WHEN value > 30 + {n} THEN [{{'name': event_type, 'credit': 1.0::DOUBLE}}, {{'name': 'NPC*', 'credit': 1.0::DOUBLE}}]
           ELSE [{{'name': 'NARRATOR', 'credit': 1.0::DOUBLE}}] END AS speakers,
      CASE WHEN event_id % (3 + {n}) = 0 THEN ['calm', 'neutral'] ELSE ['neutral'] END AS emotions, ['normal'] AS paces, CASE WHEN value > 70 THEN ['loud', 'normal'] ELSE ['normal'] END AS volumes,
      0 AS low, 1 + event_id % 3 AS high, CASE event_id % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'f' ELSE 'u' END AS gender FROM events"""


def _gold(spark, sf_dir, n):
    e, v = table(spark, sf_dir, "events"), F.col("value")
    texts = lambda *xs: F.array(*[F.lit(x) for x in xs])
    who = lambda name, credit: F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), F.lit(float(credit)).alias("credit"))
    k = (F.col("event_id") + n) % 5
    return e.select(
        "event_id", F.when(k == 0, texts("narration")).when(k == 1, texts("narration", "thought")).otherwise(texts("dialogue")).alias("kinds"),
        F.when(v > 60, F.array(who(F.col("event_type"), 1), who("view", 0.5))).when(v > 30 + n, F.array(who(F.col("event_type"), 1), who("NPC*", 1))).otherwise(F.array(who("NARRATOR", 1))).alias("speakers"),
        F.when(F.col("event_id") % (3 + n) == 0, texts("calm", "neutral")).otherwise(texts("neutral")).alias("emotions"), texts("normal").alias("paces"),
        F.when(v > 70, texts("loud", "normal")).otherwise(texts("normal")).alias("volumes"), F.lit(0).alias("low"), (1 + F.col("event_id") % 3).alias("high"),
        F.when(F.col("event_id") % 4 == 0, "m").when(F.col("event_id") % 4 == 1, "f").otherwise("u").alias("gender"),
    )


@query(f"""WITH g AS ({_reading(0)}), a AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'narration' ELSE 'dialogue' END AS kind, CASE event_id % 7 WHEN 0 THEN 'NARRATOR' WHEN 1 THEN 'NPC*' WHEN 2 THEN 'view' ELSE event_type END AS speaker,
    CASE WHEN event_id % 2 = 0 THEN 'calm' ELSE 'neutral' END AS emotion, event_id % 4 AS intensity, CASE WHEN event_id % 9 = 0 THEN 'fast' ELSE 'normal' END AS pace, CASE WHEN event_id % 5 = 0 THEN 'loud' ELSE 'normal' END AS volume,
    CASE WHEN event_id % 3 = 0 THEN 'male' ELSE 'female' END AS sex FROM events WHERE event_id % 11 <> 0),
  j AS (SELECT g.*, a.* EXCLUDE (event_id), coalesce(list_max([x.credit for x in speakers if x.name = speaker]), 0) AS c, len([k for k in kinds if k <> 'narration']) > 0 AS spoken FROM g JOIN a USING (event_id)),
  r AS (SELECT 'kind' AS axis, list_contains(kinds, kind)::INT::DOUBLE AS credit FROM j UNION ALL SELECT 'speaker', CASE WHEN spoken THEN c ELSE 0 END FROM j WHERE spoken OR speaker <> 'NARRATOR'
    UNION ALL SELECT 'emotion', list_contains(emotions, emotion)::INT::DOUBLE FROM j UNION ALL SELECT 'intensity', (intensity BETWEEN low AND high)::INT::DOUBLE FROM j
    UNION ALL SELECT 'pace', list_contains(paces, pace)::INT::DOUBLE FROM j UNION ALL SELECT 'volume', list_contains(volumes, volume)::INT::DOUBLE FROM j
    UNION ALL SELECT 'gender', (sex = CASE gender WHEN 'm' THEN 'male' ELSE 'female' END)::INT::DOUBLE FROM j WHERE gender <> 'u' AND c > 0 AND speaker <> 'NPC*')
  SELECT axis, round(sum(credit), 4) AS earned, count(*) AS possible, round(avg(credit), 6) AS rate,
    round(avg(credit) * CASE axis {" ".join(f"WHEN '{a}' THEN {w}" for a, w in scoring.WEIGHTS.items())} END, 6) AS weighted FROM r GROUP BY axis""")
def a19_seven_axes(spark, sf_dir):
    g, e = _gold(spark, sf_dir, 0), table(spark, sf_dir, "events").where("event_id % 11 <> 0")
    i = F.col("event_id")
    a = e.select(
        "event_id", F.when(i % 6 == 0, "narration").otherwise("dialogue").alias("kind"), F.when(i % 7 == 0, "NARRATOR").when(i % 7 == 1, "NPC*").when(i % 7 == 2, "view").otherwise(F.col("event_type")).alias("speaker"),
        F.when(i % 2 == 0, "calm").otherwise("neutral").alias("emotion"), (i % 4).alias("intensity"), F.when(i % 9 == 0, "fast").otherwise("normal").alias("pace"), F.when(i % 5 == 0, "loud").otherwise("normal").alias("volume"),
        F.when(i % 3 == 0, "male").otherwise("female").alias("gender"))
    s = scoring.weighted_score(scoring.axis_credits(g, a, ["event_id"]))
    return s.select("axis", F.round("earned", 4).alias("earned"), "possible", F.round("rate", 6).alias("rate"), F.round("weighted", 6).alias("weighted"))


@query(f"""WITH a AS ({_reading(0)}), b AS ({_reading(1)}), j AS (SELECT a.kinds AS k, b.kinds AS l, a.speakers AS s, b.speakers AS t, a.emotions AS e, b.emotions AS f FROM a JOIN b USING (event_id)),
  r AS (SELECT len([x for x in k || l if x <> 'narration']) > 0 AS spoken, s[1].name = t[1].name AS preferred, list_contains([x.name for x in t if x.credit = 1], s[1].name) AND list_contains([x.name for x in s if x.credit = 1], t[1].name) AS compatible,
    list_sort(k) = list_sort(l) AS kinds, e[1] = f[1] AS emotion, list_has_any(e, f) AS both_ FROM j)
  SELECT count(*) AS rows, count(*) FILTER (spoken) AS spoken, round(count(*) FILTER (spoken AND preferred) / count(*) FILTER (spoken), 6) AS speaker_preferred, round(count(*) FILTER (spoken AND compatible) / count(*) FILTER (spoken), 6) AS speaker_compatible,
    round(avg(kinds::INT), 6) AS kinds_same, round(avg(emotion::INT), 6) AS emotion_preferred, round(avg(both_::INT), 6) AS emotion_overlap FROM r""")
def a20_annotators(spark, sf_dir):
    out = scoring.agreement(_gold(spark, sf_dir, 0), _gold(spark, sf_dir, 1), ["event_id"])
    return out.select("rows", "spoken", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, event_type, row_number() OVER w AS r, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS f FROM (SELECT user_id, event_id, ts, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'x' ELSE event_type END AS event_type FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  u AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY r) AS unit FROM e), s AS MATERIALIZED (SELECT user_id, unit, count(*) AS n, min(r) AS first FROM u GROUP BY ALL),
  p AS (SELECT user_id, unit, 0::BIGINT AS starts, CASE WHEN n > 4 THEN (n + 3) // 4 ELSE 0 END::BIGINT AS batch, CASE WHEN n > 4 THEN 0 ELSE n END AS held, n, first FROM s WHERE unit = 1
        UNION ALL SELECT s.user_id, s.unit, b, CASE WHEN s.n > 4 THEN b + (s.n + 3) // 4 ELSE b END, CASE WHEN s.n > 4 THEN 0 WHEN b = p.batch THEN p.held + s.n ELSE s.n END, s.n, s.first
        FROM p JOIN s ON s.user_id = p.user_id AND s.unit = p.unit + 1, LATERAL (SELECT CASE WHEN p.held > 0 AND p.held + s.n > 4 THEN p.batch + 1 ELSE p.batch END AS b))
  SELECT u.user_id, u.event_id, (p.starts + CASE WHEN p.n > 4 THEN (u.r - p.first) // 4 ELSE 0 END)::BIGINT AS batch FROM u JOIN p USING (user_id, unit)""")
def e12_capped_units(spark, sf_dir):
    """A user's events in batches of four; runs of one kind stay together, longer runs are cut."""
    kind = F.when(F.col("event_type").isin("click", "view", "error"), "x").otherwise(F.col("event_type"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", kind.alias("kind"))
    return chains.pack_units(e, ["user_id"], ["ts", "event_id"], "kind", 4).select("user_id", "event_id", "batch")


_ME = "(?:^|[^a-z])(?:on|la|die|in)(?:[^a-z]|$)"


@query(f"""WITH c AS (SELECT doc_id, text, regexp_extract(text, '^[A-Z][a-z]+') AS h FROM documents), s AS (SELECT *, list_filter(string_split_regex(text, '[.!?…]+'), lambda x: trim(x) <> '') AS s FROM c),
  r AS (SELECT doc_id, h, len(list_filter(s, lambda x: regexp_matches(x, '{_ME}'))) / greatest(1, len(s)) AS rate, CASE WHEN h <> '' THEN ((length(text) - length(replace(text, h, ''))) // length(h))::INTEGER END AS told FROM s)
  SELECT doc_id, h AS heading, round(rate, 6) AS rate, told FROM r WHERE rate >= 0.3 AND told <= 2""")
def e23_point_of_view(spark, sf_dir):
    """Documents as chapters headed by their first word, four short words as the first person."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract("text", "^[A-Z][a-z]+", 0).alias("heading"))
    got = dialogue.point_of_view(d, "heading", "text", _ME)
    return got.select("doc_id", "heading", F.round("first_person_rate", 6).alias("rate"), F.col("told_about").alias("told"))


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS a, CASE WHEN p_partkey % 2 = 0 THEN upper(lead(p_name) OVER (ORDER BY p_partkey)) ELSE lead(p_name) OVER (ORDER BY p_partkey) || ' ' || p_brand END AS b FROM part), q AS (SELECT * FROM p WHERE b IS NOT NULL),
  w AS (SELECT k, a, b, [x for x in string_split(a, ' ') if x <> ''] AS v, [x for x in string_split(b, ' ') if x <> ''] AS w FROM (SELECT k, a, b FROM q UNION ALL SELECT k, lower(a), lower(b) FROM q)),
  n AS (SELECT *, list_distinct(v || w) AS names FROM w), c AS (SELECT *, array_to_string([chr(65 + list_position(names, x)::INTEGER) for x in v], '') AS cv, array_to_string([chr(65 + list_position(names, x)::INTEGER) for x in w], '') AS cw FROM n)
  SELECT k AS p_partkey, round(max(greatest(0, 1 - levenshtein(a, b) / greatest(1, length(a)))), 6) AS similarity, round(min(levenshtein(cv, cw) / greatest(1, len(v))), 6) AS wer FROM c GROUP BY k""")
def f26_best_of_two(spark, sf_dir):
    """Part names against the next part's, in capitals or with a brand."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    pairs = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next")), "p_partkey")
    heard = F.when(F.col("p_partkey") % 2 == 0, F.upper("next")).otherwise(F.concat_ws(" ", "next", "p_brand"))
    x = ps.best_of_two(F.col("p_name"), heard)
    return pairs.select("p_partkey", F.round(x["similarity"], 6).alias("similarity"), F.round(x["wer"], 6).alias("wer"))


@query("""SELECT page_id, array_to_string([CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 12, '0') ELSE x END for x in regexp_extract_all(lower(url), '[0-9]+|[^0-9]+')], '') AS key FROM pages""")
def src4_natural_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.natural_key(F.col("url")).alias("key"))


@query(r"""WITH d AS (SELECT doc_id, text, list_distinct(regexp_extract_all(text, '[a-z,;] ([A-Z][a-z]{3,})', 1)) AS names FROM documents), w AS (SELECT doc_id, names, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS w FROM d WHERE len(names) > 0),
  t AS (SELECT doc_id, names, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM w), c AS (SELECT *, coalesce(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM t)
  SELECT doc_id, begins::INTEGER AS start, (begins + length(w))::INTEGER AS "end", w AS alias FROM c WHERE list_contains(names, w)""")
def f34_own_names(spark, sf_dir):
    """Where a document mentions the names that stand inside its own sentences."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z,;] ([A-Z][a-z]{3,})"), F.lit(1))).alias("names")).where("size(names) > 0")
    return d.select("doc_id", F.explode(ps.mention_spans(F.col("text"), F.col("names"), case=True)).alias("m")).select("doc_id", "m.start", "m.end", "m.alias")


@query("""WITH c AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL) SELECT conv_id, role FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, role) = 1""")
def a11_top_role(spark, sf_dir):
    """The role with most turns of each conversation, ties to the smaller name."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    return c.groupBy("conv_id").agg(F.min_by("role", F.struct((-F.col("n")).alias("n"), "role")).alias("role"))


@query("""WITH l AS (SELECT l_partkey, l_orderkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC) = 1)
  SELECT l_partkey, round(sum(l_quantity), 2) AS qty, count(*) AS orders_n FROM l GROUP BY l_partkey""")
def a22_latest_lines(spark, sf_dir):
    """What the last line of each part and order asks for, summed by part."""
    last = F.max_by("l_quantity", F.struct("l_linenumber", "l_quantity")).alias("q")
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey").agg(last)
    return li.groupBy("l_partkey").agg(F.round(F.sum("q"), 2).alias("qty"), F.count("*").alias("orders_n"))


_CUT = "'-' || array_to_string(m, '-')"
for _a, _b in [("-tch", "t-ch"), *((f"-{c}{c}", f"{c}-{c}") for c in "kpts"), *((f"-m{c}", f"m-{c}") for c in "bpm")]:
    _CUT = f"replace({_CUT}, '{_a}', '{_b}')"


@query(rf"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\b[A-Za-z]{{3,12}}\b')) AS name FROM documents), t AS (SELECT name, regexp_extract_all(lower(name), '{rd.romaji_pattern().replace("'", "''")}') AS m FROM w),
  c AS (SELECT name, array_to_string(m, '') = lower(name) AND regexp_full_match(name, '[A-Z]?[a-z]+') AS good, regexp_replace(regexp_replace({_CUT}, '-n(-|$)', 'n\1', 'g'), '-n(-|$)', 'n\1', 'g') AS s FROM t)
  SELECT name, CASE WHEN good AND starts_with(s, '-') THEN CASE WHEN regexp_matches(name, '^[A-Z]') THEN upper(s[2]) || s[3:] ELSE s[2:] END END AS syllables FROM c""")
def f31_romaji(spark, sf_dir):
    """Words of the documents as if they were romanised names."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9_])[A-Za-z]{3,12}(?![A-Za-z0-9_])"), F.lit(0))).alias("name")).distinct()
    return w.select("name", rd.romaji_syllables(F.col("name")).alias("syllables"))
