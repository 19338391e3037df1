"""Queries for votes, scores, percentiles and splits."""

from pyspark.sql import functions as F

from versehall.operators import evaluation as ev
from versehall.operators.ranking import ranked
from versehall.plans.registry import plain, query, table
from versehall.sources import books

plain("a13_percentiles", "SELECT round(median(value), 6) AS med, round(min(value), 6) AS low, round(max(value) - min(value), 6) AS spread, round(percentile_cont(0.05) WITHIN GROUP (ORDER BY value), 6) AS p05, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 6) AS p95 FROM events")
plain("a20_agreement", "SELECT count(*) AS n, round(avg((quality = toxic)::INT), 6) AS same, round(avg((quality = 1 OR toxic = 1)::INT), 6) AS either FROM labels")


@query("SELECT doc_id, dense_rank() OVER (PARTITION BY lang ORDER BY source)::BIGINT AS fold FROM documents")
def e14_leave_one_out(spark, sf_dir):
    """Ranks of the sources of each language, a row a source, joined to the documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    folds = ranked(d.select("lang", "source").distinct(), [F.asc("source")], "fold", ["lang"]).select(F.col("lang").alias("l"), F.col("source").alias("s"), "fold")
    folds = F.broadcast(folds) if folds.count() <= 100_000 else folds
    return d.join(folds, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "fold")



@query("""WITH p AS (SELECT source, text, doc_id || '=' || sha256(text) AS line, substr(md5(doc_id::VARCHAR), 1, 3) AS part FROM documents),
  h AS (SELECT source, part, count(*) AS docs, sum(len(regexp_extract_all(text, '\\S+'))) AS words, sum(length(text)) AS chars, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM p GROUP BY source, part)
  SELECT source, sum(docs)::BIGINT AS files, sum(words)::BIGINT AS words, sum(chars)::BIGINT AS chars, sha256(string_agg(part || '=' || digest, chr(10) ORDER BY part)) AS digest FROM h GROUP BY source""")
def a31_corpus_stats(spark, sf_dir):
    """Documents, words, characters and one digest of each source, as its manifest has them."""
    return books.manifest(table(spark, sf_dir, "documents"), "source", F.col("doc_id").cast("string"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, max(count(*)) OVER (PARTITION BY user_id) AS top FROM events GROUP BY 1, 2)
  SELECT user_id, CASE WHEN count(*) = 1 THEN min(event_type) ELSE 'unknown' END AS event_type FROM c WHERE n = top GROUP BY user_id""")
def a7_mode_vote(spark, sf_dir):
    return ev.mode_vote(table(spark, sf_dir, "events"), ["user_id"], "event_type", "unknown")


@query("""SELECT user_id, count(*) FILTER (WHERE value > 40) AS yes, count(*) FILTER (WHERE value <= 40) AS no,
  CASE WHEN count(*) FILTER (WHERE value > 40) >= 5 AND count(*) FILTER (WHERE value > 40) >= 3 * count(*) FILTER (WHERE value <= 40) THEN 'high'
       WHEN count(*) FILTER (WHERE value <= 40) >= 5 AND count(*) FILTER (WHERE value <= 40) >= 3 * count(*) FILTER (WHERE value > 40) THEN 'low' END AS verdict FROM events GROUP BY user_id""")
def a8_evidence_vote(spark, sf_dir):
    return ev.evidence_vote(table(spark, sf_dir, "events"), ["user_id"], F.col("value") > 40, F.col("value") <= 40, ("high", "low"))


@query("""WITH c AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS n, max(count(*)) OVER (PARTITION BY o_custkey) AS top FROM orders GROUP BY 1, 2),
  m AS (SELECT o_custkey, CASE WHEN count(*) = 1 THEN min(p) ELSE 'unknown' END AS plural FROM c WHERE n = top GROUP BY 1),
  f AS (SELECT o_custkey, max(CASE WHEN o_totalprice > 450000 THEN o_orderpriority END) AS locked, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS one,
        max(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END) AS evidence FROM orders GROUP BY 1)
  SELECT o_custkey, coalesce(locked, one, evidence, plural, 'unknown') AS o_orderpriority FROM f JOIN m USING (o_custkey)""")
def a9_layered(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    return ev.layered(o, ["o_custkey"], F.when(F.col("o_totalprice") > 450000, p), "o_orderpriority", F.when(F.col("o_orderstatus") == "P", p))


@query("""SELECT event_type, round(median(value), 6) AS med, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type""")
def a14_group_percentiles(spark, sf_dir):
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("med"), q(0.05).alias("p05"), q(0.95).alias("p95"))


@query("""WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS a, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS b FROM labels)
  SELECT a AS only_a, b AS only_b, round(CASE WHEN a + b = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(a + b + 1.0) - lgamma(k + 1.0) - lgamma(a + b - k + 1.0) - (a + b) * ln(2.0))) FROM range(0, least(a, b) + 1) t(k))) END, 9) AS p FROM c""")
def a17_mcnemar(spark, sf_dir):
    out = ev.mcnemar(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1)
    return out.select("only_a", "only_b", F.round("p", 9).alias("p"))


@query("""WITH i AS (SELECT event_id, event_type AS p, user_id % 7 AS g FROM events), c AS (SELECT p, g, count(*) AS n FROM i GROUP BY 1, 2),
  d AS (SELECT n, sum(n) OVER (PARTITION BY p) AS np, sum(n) OVER (PARTITION BY g) AS ng FROM c),
  r AS (SELECT sum(n * n / np) / sum(n) AS pr, sum(n * n / ng) / sum(n) AS re FROM d)
  SELECT round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1 FROM r""")
def a18_bcubed(spark, sf_dir):
    out = ev.bcubed(table(spark, sf_dir, "events").withColumn("g", F.col("user_id") % 7), "event_id", "event_type", "g")
    return out.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""SELECT doc_id, round(100 * (45 * CASE WHEN quality = 1 THEN 1.0 WHEN n_chars % 2 = 0 THEN 0.5 ELSE 0 END + 15 * CASE WHEN toxic = 0 THEN 1.0 ELSE 0 END) / 60, 6) AS score
  FROM labels JOIN documents USING (doc_id)""")
def a19_partial_credit(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    answer = lambda name, credit: F.struct(F.lit(name).alias("name"), F.lit(credit).alias("credit"))
    half = F.when(F.col("n_chars") % 2 == 0, F.array(answer(1, 1.0), answer(0, 0.5))).otherwise(F.array(answer(1, 1.0)))
    gold = both.select("doc_id", half.alias("quality"), F.array(answer(0, 1.0)).alias("toxic"))
    out = ev.partial_credit(gold, table(spark, sf_dir, "labels"), ["doc_id"], {"quality": 45.0, "toxic": 15.0})
    return out.select("doc_id", F.round("score", 6).alias("score"))


@query("""WITH m AS (SELECT user_id, event_type AS label, sum(value) / 3 AS p FROM events GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, label) AS n FROM m) SELECT user_id, label, round(p, 4) AS p FROM r WHERE n = 1""")
def a21_ensemble(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("label"), F.col("value").alias("p"))
    return ev.ensemble(p, ["user_id"], 3).select("user_id", "label", F.round("p", 4).alias("p"))


@query("""SELECT try_cast(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events WHERE json_valid(props) AND json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1""")
def a32_json_tally(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select((k % 10).alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))


@query("""SELECT label, count(*) AS n, round(avg(CASE WHEN embedding[1] > 0 THEN embedding[1]::DOUBLE END), 6) AS mean, round(stddev_pop(embedding[2]::DOUBLE), 6) AS sd FROM embeddings GROUP BY label""")
def a33_nan_mean(spark, sf_dir):
    x = F.when(F.col("embedding")[0] > 0, F.col("embedding")[0].cast("double")).otherwise(F.lit(float("nan")))
    y = F.col("embedding")[1].cast("double")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.when(~F.isnan(x), x)), 6).alias("mean"), F.round(F.stddev_pop(y), 6).alias("sd"))


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER () AS n, toxic AS bad FROM labels JOIN documents USING (doc_id)), c AS (SELECT unnest([0, 5, 10, 20, 50]) AS cut)
  SELECT cut::INTEGER AS cut, round(1 - sum(CASE WHEN r > floor(n * cut / 100) THEN bad ELSE 0 END) / max(n), 6) AS accuracy FROM r, c GROUP BY cut""")
def s14_review_curve(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    out = ev.review_curve(both, "n_chars", F.col("toxic") == 1, "doc_id", [0, 5, 10, 20, 50])
    return out.select("cut", F.round("accuracy", 6).alias("accuracy"))


@query("""WITH x AS (SELECT source, doc_id % 6 + 1 AS times, n_chars % 2 = 0 AS ja, n_chars % 3 = 0 AS ko, n_chars % 5 = 0 AS hon FROM documents),
  s AS (SELECT source, sum(times) AS total, sum(CASE WHEN ja THEN times ELSE 0 END) / sum(times) AS ja, sum(CASE WHEN ko THEN times ELSE 0 END) / sum(times) AS ko, sum(CASE WHEN ko AND NOT ja THEN times ELSE 0 END) / sum(times) AS ko_only,
    count(*) FILTER (WHERE ja) AS ja_names, count(*) FILTER (WHERE ko) AS ko_names, sum(CASE WHEN ja AND hon THEN times ELSE 0 END) AS hon, count(*) FILTER (WHERE ja AND hon) AS hon_names FROM x GROUP BY source)
  SELECT source, round(ja, 6) AS ja, round(ko, 6) AS ko, CASE WHEN total < 30 THEN NULL WHEN ja_names >= 4 AND ja >= 0.7 THEN 'ja' WHEN hon >= 5 AND hon_names >= 2 AND ja_names >= 4 AND ja >= 0.5 THEN 'ja'
    WHEN ko_names >= 4 AND ko >= 0.3 AND ko_only >= 0.15 THEN 'ko' END AS origin FROM s""")
def a30_origins(spark, sf_dir):
    """Documents stand for names, their lengths for what readings they have."""
    n = F.col("n_chars")
    d = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 6 + 1).alias("times"), (n % 2 == 0).alias("ja"), (n % 3 == 0).alias("ko"), (n % 5 == 0).alias("suffixed"))
    out = ev.origins(d, "source", "times", least=30, few=4, ja_share=0.7, honorific=(5, 2, 0.5), ko_share=0.3, ko_only_share=0.15)
    return out.select("source", F.round("ja", 6).alias("ja"), F.round("ko", 6).alias("ko"), "origin")


@query("""WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER (PARTITION BY toxic) AS n FROM labels JOIN documents USING (doc_id))
  SELECT doc_id, toxic FROM r WHERE r <= floor(n * 0.4)""")
def s15_keep_share(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return ev.keep_top_share(both, ["toxic"], F.col("n_chars"), ["doc_id"], 0.4).select("doc_id", "toxic")


@query("""WITH b AS (SELECT doc_id % 5 AS fold, n_chars / 1000.0 AS s, quality = 1 AS y FROM labels JOIN documents USING (doc_id)), g AS (SELECT unnest([0.5, 1.0, 2.0, 4.0, 8.0]) AS threshold),
  o AS (SELECT fold, threshold, count(*) FILTER (WHERE (s >= threshold) = y) AS n FROM b, g GROUP BY 1, 2), r AS (SELECT fold, threshold, sum(n) OVER (PARTITION BY threshold) - n AS rest FROM o),
  k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY rest DESC, threshold) AS p FROM r) SELECT fold, threshold::DOUBLE AS threshold, rest::BIGINT AS right_elsewhere FROM k WHERE p = 1""")
def e26_threshold(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("fold", F.col("doc_id") % 5)
    return ev.leave_one_out_threshold(both, "fold", F.col("n_chars") / 1000, F.col("quality") == 1, [0.5, 1.0, 2.0, 4.0, 8.0])


@query("""WITH s AS (SELECT doc_id, text, CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split FROM documents),
  a AS (SELECT text FROM s GROUP BY text HAVING count(DISTINCT split) > 1) SELECT doc_id, split FROM s WHERE text NOT IN (SELECT text FROM a)""")
def e15_split(spark, sf_dir):
    k = F.col("doc_id") % 10
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content"))
    return ev.split_without_straddling(docs, "doc_id", F.when(k == 0, "test").when(k == 1, "dev").otherwise("train"), "content").select("doc_id", "split")
