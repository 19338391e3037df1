"""Queries through files: the tables are written by the sinks and read back by the sources, in this
application's folder."""

from pyspark.sql import functions as F

from versehall.operators import merge
from versehall.plans.registry import query, table
from versehall.sources import books
from versehall.staging import own_path


@query("SELECT source, sum(length(text) + 1)::BIGINT AS chars, count(*) AS docs FROM documents GROUP BY source")
def src3_text_books(spark, sf_dir):
    """A folder of text files a source; every document ends with a mark and a line end."""
    path = own_path(spark, "books")
    table(spark, sf_dir, "documents").select("source", F.concat("text", F.lit("‡")).alias("value")).write.partitionBy("source").text(path)
    files = books.read_books(spark, f"{path}/*/*", "*.txt")
    docs = F.regexp_count("text", F.lit("‡"))
    own = files.select(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"), "text", docs.alias("n"))
    return own.groupBy("source").agg(F.sum(F.length("text") - F.col("n")).cast("long").alias("chars"), F.sum("n").cast("long").alias("docs"))


@query("SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split, md5(text) AS digest FROM documents")
def src13_snk2_jsonl(spark, sf_dir):
    """Splits written as JSON lines and read back with their folder as a column."""
    path, k = own_path(spark, "splits"), F.col("doc_id") % 10
    books.write_splits(table(spark, sf_dir, "documents").select("doc_id", "text", F.when(k == 0, "test").when(k == 1, "dev").otherwise("train").alias("split")), path)
    parts = [books.read_jsonl(spark, f"{path}/split={s}", "doc_id long, text string").withColumn("split", F.lit(s)) for s in ("test", "dev", "train")]
    return parts[0].union(parts[1]).union(parts[2]).select("doc_id", "split", F.md5("text").alias("digest"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_name IN (SELECT s_name FROM supplier WHERE s_suppkey IN (3, 5, 8))")
def src15_shards(spark, sf_dir):
    path, s = own_path(spark, "shards"), table(spark, sf_dir, "supplier")
    books.write_shards(s.select("s_suppkey", "s_name"), "s_name", path)
    wanted = [r["s_name"] for r in s.where("s_suppkey IN (3, 5, 8)").select("s_name").collect()]  # three rows
    return books.read_shards(spark, path, "s_name", wanted).select("s_suppkey", "s_name")


@query("""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'heading' WHEN doc_id % 9 = 1 THEN 'narration' ELSE 'speech' END AS kind, CASE WHEN doc_id % 9 > 1 THEN 'Old ' || CASE quality WHEN 1 THEN 'Anna' ELSE 'Ben' END END AS speaker,
  CASE WHEN doc_id % 9 > 1 THEN 1.0::DOUBLE END AS credit, CASE WHEN doc_id % 9 > 1 THEN 1 END AS low, CASE WHEN doc_id % 9 > 1 THEN 1 + toxic END AS high FROM labels""")
def src14_gold_lines(spark, sf_dir):
    """Gold lines of both forms, made of labels and parsed again."""
    k, name = F.col("doc_id") % 9, F.when(F.col("quality") == 1, "Anna").otherwise("Ben")
    high = F.when(F.col("toxic") == 1, "1-2").otherwise("1")
    long_ = F.format_string("%s  speech,aside Old %s calm %s slow low f", F.col("doc_id").cast("string"), name, high)
    line = F.when(k == 0, F.concat(F.col("doc_id").cast("string"), F.lit(" H"))).when(k == 1, F.concat(F.col("doc_id").cast("string"), F.lit(" N"))).otherwise(long_)
    g = table(spark, sf_dir, "labels").select(books.parse_gold(line).alias("g"))
    one = F.get(F.col("g.speakers"), F.lit(0))
    return g.select(F.col("g.seq").alias("doc_id"), F.get(F.col("g.kinds"), F.lit(0)).alias("kind"), one["name"].alias("speaker"), one["credit"].alias("credit"), "g.low", "g.high")


@query("SELECT source, CASE WHEN count(*) FILTER (WHERE doc_id % 50 > 0) = 0 THEN 'gone' ELSE 'changed' END AS state FROM documents GROUP BY source HAVING count(*) FILTER (WHERE doc_id % 50 = 0) > 0")
def snk4_drift(spark, sf_dir):
    """Manifests of all documents and of those without every fiftieth."""
    docs = table(spark, sf_dir, "documents")
    one = lambda d: books.manifest(d, "source", F.col("doc_id").cast("string"))
    return books.drift(one(docs), one(docs.where("doc_id % 50 > 0")), "source")


@query("""WITH k AS (SELECT event_type, 'model ' || chr(64 + row_number() OVER (ORDER BY sha1('seed' || event_type))::INTEGER) AS label FROM (SELECT DISTINCT event_type FROM events) x)
  SELECT label, count(*) AS n, round(avg(value), 6) AS mean FROM events JOIN k USING (event_type) GROUP BY label""")
def snk3_blinded(spark, sf_dir):
    rows, _ = books.blinded_report(table(spark, sf_dir, "events").select("event_type", "value"), "event_type", "seed")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE o_orderpriority END AS state, o_orderstatus FROM orders")
def snk6_ledger(spark, sf_dir):
    """A ledger partitioned by status, of which one partition is replaced as a whole."""
    path, o = own_path(spark, "ledger"), table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("state"), "o_orderstatus")
    merge.replace_partitions(o, path, "o_orderstatus")
    merge.replace_partitions(o.where("o_orderstatus = 'F'").withColumn("state", F.lit("closed")), path, "o_orderstatus")
    return spark.read.schema("o_orderkey long, state string, o_orderstatus string").parquet(path)


@query("SELECT page_id, n_p::BIGINT AS paragraphs FROM (SELECT page_id, len(regexp_extract_all(html, '<p[\\s>]')) AS n_p FROM pages) x")
def src12_web_paragraphs(spark, sf_dir):
    """Paragraphs of pages with a hidden one put into each, which must not count."""
    html = F.regexp_replace("html", "</body>", '<p style="display:none">decoy</p></body>')
    return books.web_paragraphs(table(spark, sf_dir, "pages").withColumn("html", html), "page_id", "html").groupBy("page_id").agg(F.count("*").alias("paragraphs"))


@query("SELECT s_suppkey, s_acctbal + 1 AS s_acctbal FROM supplier")
def snk1_replaced(spark, sf_dir):
    """A table replaced by rows read from itself."""
    path = own_path(spark, "table")
    merge.replace_table(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), path)
    merge.replace_table(spark.read.schema("s_suppkey long, s_acctbal double").parquet(path).withColumn("s_acctbal", F.col("s_acctbal") + 1), path)
    return spark.read.schema("s_suppkey long, s_acctbal double").parquet(path)
