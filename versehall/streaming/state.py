"""Streaming forms of the batch operators: the same results as rows arrive, with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def throughput(stream: DataFrame, ts: str, late: str = "10 minutes", window: str = "30 minutes", slide: str = "5 minutes", least: int = 12) -> DataFrame:
    """W15 over sliding windows: rows a second over at least a minute, null under `least` rows. Late rows count until the
    watermark passes their window."""
    w = F.window(ts, window, slide)
    out = stream.withWatermark(ts, late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    span = F.unix_micros("last") - F.unix_micros("first")
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", F.when(F.col("n") >= least, F.col("n") * 1e6 / F.greatest(span, F.lit(60_000_000))).alias("rate"))


def sessions_once(stream: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """L3: the first arrival of each session id within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def listening_sessions(stream: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a user's rows no more than `gap` apart."""
    s = F.session_window(ts, gap)
    out = stream.withWatermark(ts, late).groupBy(F.col(user), s.alias("s")).agg(F.count("*").alias("n"))
    return out.select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
