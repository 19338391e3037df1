"""Queries of the order-dependent operators; SQL where a window expresses them, else tests."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from versehall.functions import readings
from versehall.operators import sequential as sq
from versehall.operators.intervals import micros
from versehall.plans.registry import query, table
from versehall.staging import stage


@query()
def f14_pack_sentences(spark, sf_dir):
    return sq.explode_text(table(spark, sf_dir, "documents"), "doc_id", "text", sq.pack_sentences, "piece string")


@query()
def f15_split_clauses(spark, sf_dir):
    return sq.explode_text(table(spark, sf_dir, "documents"), "doc_id", "text", sq.split_clauses, "piece string")


@query()
def f16_segments(spark, sf_dir):
    return sq.explode_text(table(spark, sf_dir, "documents"), "doc_id", "text", sq.segment, "paragraph int, kind string, piece string, break_ms int")


@query()
def e12_first_fit(spark, sf_dir):
    """Segments of a document in batches of 1,500 characters; those of a paragraph, and all from where a
    quotation opens to where it ends, stay together."""
    parts = sq.explode_text(table(spark, sf_dir, "documents"), "doc_id", "text", sq.segment, "paragraph int, kind string, piece string, break_ms int")
    units = sq.cohesive(parts, ["doc_id"], ["pos"], "paragraph", "piece").select("doc_id", "pos", "unit", "size")
    return sq.first_fit_rows(units, ["doc_id"], ["pos"], "unit", "size", 1500, "batch").select("doc_id", "pos", "batch")


@query()
def e13_balanced(spark, sf_dir):
    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(batch=sq.balanced(rows["value"], 250.0))[["user_id", "event_id", "batch"]]

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return sq.grouped(e, ["user_id"], ["ts", "event_id"], cut, "user_id long, event_id long, batch int")


@query()
def e16_scenes(spark, sf_dir):
    """A user's events as lines that last until the next one, their value and type as mood."""
    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        at = rows["s"].to_numpy()
        seconds = np.append(np.diff(at), 30.0)
        mood = np.column_stack([rows["value"].to_numpy() / 50, (rows["event_type"] == "click").to_numpy(float)])
        return rows.assign(scene=sq.scenes(at, seconds, mood, (rows["event_type"] == "purchase").to_numpy(), smooth=8e4, hold=4e4, least=6e4, most=9e5))[["user_id", "event_id", "scene"]]

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", (micros("ts") / 1e6).alias("s"))
    return sq.grouped(e, ["user_id"], ["s", "event_id"], cut, "user_id long, event_id long, scene int")


@query()
def m7_viterbi(spark, sf_dir):
    stay = np.log(np.array([[[0.6, 0.4], [0.2, 0.8]], [[0.7, 0.3], [0.3, 0.7]]]))

    def decode(rows: pd.DataFrame) -> pd.DataFrame:
        p = np.clip(rows["value"].to_numpy() / 100, 0.01, 0.99)
        return rows.assign(label=sq.viterbi(np.log(np.column_stack([1 - p, p])), stay))[["user_id", "event_id", "label"]]

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return sq.grouped(e, ["user_id"], ["ts", "event_id"], decode, "user_id long, event_id long, label int")


@query()
def e9_keep_pins(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("voice"), F.col("l_partkey").cast("string").alias("name"))
    pins = own.agg(F.sum("l_quantity").alias("exposure"), F.count("*").alias("lines"), F.collect_set(F.col("l_shipdate").cast("date").cast("string").substr(1, 7)).alias("chapters"))
    return pins.groupBy("voice").applyInPandas(sq.keep_pins, "voice long, name string")


@query()
def e14_lpt(spark, sf_dir):
    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(fold=rows["source"].map(sq.lpt(dict(zip(rows["source"], rows["size"])), 4)))[["lang", "source", "fold"]]

    groups = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("size"))
    return groups.groupBy("lang").applyInPandas(deal, "lang string, source string, fold int")


@query()
def f35_word_times(spark, sf_dir):
    """Words of a turn whose every second one has been timed."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("line"), "text")
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    timed = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("text"), (i * 300).alias("start"), (i * 300 + 250).alias("end"))), lambda x: F.pmod(x["start"], F.lit(600)) == 0)
    return readings.word_times(c.select("line", "text", (F.size(w) * 300).alias("ms"), timed.alias("pieces")), "line", "text", "ms", "pieces")


@query()
def m8_alignment(spark, sf_dir):
    """The vectors of a label as frames over four labels and a blank."""
    z = F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double") * 9)
    logs = F.transform(z, lambda x: x - F.log(F.aggregate(z, F.lit(0.0), lambda s, y: s + F.exp(y))))
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("unit"), "vec_id", logs.alias("logs"), F.array(*[F.lit(x) for x in (1, 2, 2, 4)]).alias("labels"))
    return readings.align_frames(e, "unit", "vec_id", "logs", "labels")


@query()
def m8_utterances(spark, sf_dir):
    """As `m8_alignment`, with fifty vectors as the frames of an utterance, so that units grow in number and not in size."""
    z = F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double") * 9)
    logs = F.transform(z, lambda x: x - F.log(F.aggregate(z, F.lit(0.0), lambda s, y: s + F.exp(y))))
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 50).cast("long").alias("unit"), "vec_id", logs.alias("logs"), F.array(*[F.lit(x) for x in (1, 2, 2, 4)]).alias("labels"))
    return readings.align_frames(e, "unit", "vec_id", "logs", "labels")


@query()
def a26_colours(spark, sf_dir):
    """Parts that one supplier sends in one order must not share a colour."""
    w = Window.partitionBy("l_orderkey", "l_suppkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    li = li.withColumn("several", F.min("l_partkey").over(w) < F.max("l_partkey").over(w)).where("several").drop("several").distinct()
    li = stage(li, "sent-together")
    other = li.withColumnRenamed("l_partkey", "other")
    return sq.colours(li.join(other, ["l_orderkey", "l_suppkey"]).where("l_partkey < other"), "l_partkey", "other")


@query()
def f30_anchors(spark, sf_dir):
    """The first words of a turn against those of the next, the longest of them being a name of two forms."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    words = lambda c: F.slice(F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda x: x != ""), 1, 12)
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("line"), words("text").alias("own"), words(F.coalesce(F.lead("text").over(w), "text")).alias("heard"))
    longest = F.array_max(F.transform("own", lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"]
    forms = F.array(F.array(longest), F.array(F.substring(longest, 1, 2)))
    units = F.transform("own", lambda x: F.struct(x.alias("word"), F.when(x == longest, forms).alias("forms")))
    return readings.align_anchors(c.select("line", units.alias("units"), "heard"), "line", "units", "heard")
