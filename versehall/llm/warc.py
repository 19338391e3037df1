"""WARC archives written and read back in Spark, records found by boundary-chain verification.

Writing: rows become response or revisit records; the text sink writes them with the record end as
its line separator, so every part file is an archive.

Reading: the text source cuts the files at the magic line, wherever it stands, in splits of any
size. Each task takes every cut as a candidate record and emits where its successor would have to
begin (header length plus Content-Length). Within a split the chains are followed at once, which
leaves for each candidate its exit into a later split; over the splits, pointer jumping from the
file start doubles the reach of every round. Only records that can be reached from offset 0 are
kept: a magic line inside a payload starts a chain of its own, which nothing reaches. A header may be
of any length; one that is torn over splits (it holds the magic line itself, at the end of an
address, say) takes its missing fields from the splits it runs through. A chain that does not end
exactly at the end of its file is an error, so no record is ever lost in silence.

Defined cases: null html is an empty payload; null ids make a record without page id; payloads that
hold magic lines, whole records, or run over several splits come back whole; rows that repeat the
smallest page_id of a payload are all responses (a record cannot refer to itself), other repeated
rows are each a revisit; a cut-off or damaged archive raises ValueError, with `strict` off the
records before the damage are given; an empty table writes no records and reads none; other columns
play no part.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from versehall.llm.common import attach, forget, ship, stage

# Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
DEAD = -(1 << 40)  # no offset
LEAST_REVISIT = 100  # bytes; shorter payloads are always responses


def record_ids(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(digest, first): of payload digests that occur more than once, the smallest page_id."""
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    big = pages.where(F.octet_length(F.coalesce("html", F.lit(""))) >= least)
    return big.groupBy(digest.alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")


def record_text(page_id: Column, url: Column, payload: Column, digest: Column, refers: Column) -> Column:
    """One record without its end mark."""
    revisit = refers.isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(payload)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "%0A")
    return F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.when(page_id.isNotNull(), line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">")))).otherwise(F.lit("")),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        line("WARC-Payload-Length", F.octet_length(payload)),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers.cast("string"), F.lit(">")))).otherwise(F.lit("")),
        line("Content-Length", F.octet_length(body)),
        F.lit("\r\n"),
        body,
    )


def write(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Write an archive per partition. Only digests that repeat are joined; html is not shuffled
    unless those are too many to broadcast (then rows are dealt out by digest and a salt)."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    rows = attach(rows, stage(record_ids(pages, least), "payloads"), "digest", F.col("page_id"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    text = record_text(F.col("page_id"), F.col("url"), F.col("payload"), F.col("digest"), refers)
    rows.select(text.alias("value")).write.option("lineSep", END).text(path)


#: Header fields that are read, and the columns they fill.
FIELDS = {
    b"warc-type": "record_type", b"warc-record-id": "record_id", b"warc-refers-to": "refers", b"warc-payload-length": "length",
    b"warc-payload-digest": "digest", b"content-length": "content",
}
NAMES = list(FIELDS.values())
CANDIDATE = "file string, block long, rel long, next long, exit long, " + ", ".join(f"{n} string" for n in NAMES) + ", body_rel long, found string, block_bytes long"
#: Marks the row of a split, about a header that runs into it: the fields up to its first blank line, and where that ends.
LEAD = 2 * DEAD
HASHED = 4  # times its bytes that a split hashes at most; verified payloads beyond are read again


def _fields(lines: bytes, later: dict[str, str]) -> dict[str, str]:
    """The fields of header lines; those of the lines behind them (`later`) win."""
    out = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        known = FIELDS.get(name.strip().lower()) if colon else None
        if known:
            out[known] = value.strip().decode("utf-8", "replace")
    return out | later


def split_rows(file: str, block: int, values: list[bytes]) -> list[dict]:
    """Candidates of one split from its lines: a row for every magic line and one for the split.

    Magic lines that one blank line closes share the tail of their headers, which is therefore read
    once, from the last of them to the first."""
    magic = MAGIC.encode()
    data = magic.join(values)
    starts = np.cumsum([0] + [len(v) + len(magic) for v in values])  # the separator ends a line
    total = int(starts[-1])
    blank = [m.start() for m in re.finditer(rb"(?=\r\n\r\n)", data)]
    rows, fields, upto, closed = [], {}, 0, -1
    # a file's first line is what stands before its first magic
    for at in reversed([x for x in starts[:-1].tolist() if block or x]):
        k = bisect_left(blank, at)
        end = blank[k] if k < len(blank) else None
        if end != closed:
            fields, upto, closed = {}, len(data) if end is None else end, end
        fields, upto = _fields(data[at:upto], fields), at
        row = {"rel": at - len(magic), "next": None, "body_rel": None, "found": None} | fields
        if end is not None:
            if not fields.get("content", "").isdigit():
                continue
            body, size = end + len(END), int(fields["content"])
            row |= {"body_rel": body, "next": body + size + len(END)}
        rows.append(row)
    exits: dict[int, int] = {}
    for r in rows:  # chains within the split, from its end
        after = r["next"]
        if after is None:  # its header goes on: the chain is followed once its end is known
            exits[r["rel"]] = r["rel"]
            continue
        # starts past the last magic of the split belong to a later one
        r["exit"] = exits[r["rel"]] = exits.get(after, after if after >= total - len(magic) else DEAD)
    left = HASHED * len(data)
    for r in reversed(rows):
        low, high = r["body_rel"], r["next"] and r["next"] - len(END)
        if low is not None and high <= len(data) and high - low <= left:
            r["found"] = hashlib.sha256(memoryview(data)[low:high]).hexdigest()
            left -= high - low
    # a header that runs into this split: the magic before it ends with the first half of a blank line
    if data.startswith(b"\r\n"):
        lead, goes = {}, 2
    else:
        lead, goes = _fields(data[: blank[0] if blank else len(data)], {}), blank[0] + len(END) if blank else None
    rows.append(lead | {"rel": LEAD, "body_rel": goes})
    return [{"file": file, "block": block, "block_bytes": total} | r for r in rows]


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for every magic line: its offset in its split (rel), the successor's (next), the first
    one at or past the split's end (exit), header fields and, if the split holds the payload, its
    digest (found); and a row for every split (rel far below zero), about a header that runs into it.

    All offsets count from the split's first whole line; `block_bytes` is the length of its lines."""
    ship(spark)
    lines = spark.read.option("lineSep", MAGIC).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in CANDIDATE.split(", "))])

    def finish(key: tuple, values: list[bytes]) -> pa.RecordBatch:
        # the lines of one split, of spark.sql.files.maxPartitionBytes
        return pa.RecordBatch.from_pylist(split_rows(*key, values), schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for file, block, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (file, block) != key:
                    if held:
                        yield finish(key, held)
                    key, held = (file, block), []
                held.append(value)
        if held:
            yield finish(key, held)

    return lines.mapInArrow(run, CANDIDATE)


def placed_candidates(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates with offsets in their file (off, to, body, after), torn headers completed; and the
    splits (file, block, bytes, base)."""
    rel = F.col("rel")
    own = found.where(rel == LEAD)
    order = Window.partitionBy("file").orderBy("block")
    blocks = own.select("file", "block", F.col("block_bytes").alias("bytes"), F.coalesce(F.sum("block_bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), *NAMES, F.col("body_rel").alias("closes"))
    # splits up to and with one that has a blank line are one region: a header that is open before it ends there
    region = F.coalesce(F.count("closes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("region", region)
    rest = Window.partitionBy("file", "region").orderBy("block").rowsBetween(0, Window.unboundedFollowing)
    ahead = [F.last(n, ignorenulls=True).over(rest).alias(f"a_{n}") for n in NAMES] + [F.last(F.col("base") + F.col("closes"), ignorenulls=True).over(rest).alias("a_body")]
    blocks = blocks.select("file", "block", "bytes", "base", *ahead)
    blocks = stage(blocks.select("file", "block", "bytes", "base", *[F.lead(c).over(order).alias(c) for c in [f"a_{n}" for n in NAMES] + ["a_body"]]), "blocks")
    torn = F.col("body_rel").isNull()
    out = found.where(rel != LEAD).join(blocks, ["file", "block"])
    fields = [F.when(torn, F.coalesce(F.col(f"a_{n}"), F.col(n))).otherwise(F.col(n)).alias(n) for n in NAMES]
    out = out.select("file", "block", "base", rel, "next", "exit", "found", *fields, torn.alias("torn"), F.when(torn, F.col("a_body")).otherwise(F.col("base") + F.col("body_rel")).alias("body"))
    out = out.where(F.col("body").isNotNull() & F.col("content").rlike("^[0-9]{1,18}$"))
    after = F.col("body") + F.col("content").cast("long") + len(END)
    to = F.when(F.col("torn"), after).when(F.col("exit") != DEAD, F.col("base") + F.col("exit"))
    return out.select("*", (F.col("base") + rel).alias("off"), after.alias("after"), to.alias("to")), blocks.select("file", "block", "bytes", "base")


def reach(spots: DataFrame) -> DataFrame:
    """(file, off) of the offsets that chains from each file's start enter splits at, by pointer
    jumping over rows (file, off, to): each round doubles how many splits a pointer crosses."""
    entered = spots.select("file", F.col("to").alias("off")).where("off IS NOT NULL").union(spots.select("file", F.lit(0).cast("long"))).distinct()
    jump = stage(spots.join(entered, ["file", "off"], "left_semi"), "jumps")
    seen = stage(spots.select("file").distinct().withColumn("off", F.lit(0).cast("long")), "entered")
    while True:
        step = seen.join(jump, ["file", "off"]).select("file", F.col("to").alias("off")).where("off IS NOT NULL")
        fresh = stage(step.join(seen, ["file", "off"], "left_anti").distinct(), "entered")
        if fresh.isEmpty():
            return seen
        seen = stage(seen.union(fresh), "entered")
        on = jump.select(F.col("file").alias("f"), F.col("off").alias("o"), F.col("to").alias("t"))
        jump = stage(jump.join(on, (F.col("file") == F.col("f")) & (F.col("to") == F.col("o")), "left").select("file", "off", F.col("t").alias("to")), "jumps")


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Verified records of all archives under `path`: file, off, record_type, page_id, refers_to,
    payload_bytes, payload_digest."""
    found = stage(candidates(spark, path), "candidates")
    placed, blocks = placed_candidates(found)
    placed = stage(placed, "placed")
    forget(found)
    entries = reach(placed.select("file", "off", "to")).withColumn("enters", F.lit(True))
    slim = placed.select("file", "block", "off", "after").join(entries, ["file", "off"], "left")

    def follow(rows):
        """The records of one split that the chain entering it passes."""
        rows = rows.sort_values("off", ignore_index=True)
        at, on, keep = dict(zip(rows["off"], rows.index)), set(rows["off"][rows["enters"].notna()]), []
        for off, after in zip(rows["off"], rows["after"]):
            if off in on:
                keep.append(at[off])
                on.add(after)
        return rows.loc[keep, ["file", "off"]]

    real = slim.groupBy("file", "block").applyInPandas(follow, "file string, off long")
    records = stage(placed.join(real, ["file", "off"], "left_semi"), "records")
    # the chain of every file must end where the file does; its last line has no separator behind it
    ends = records.groupBy("file").agg(F.max("after").alias("after"))
    sizes = blocks.groupBy("file").agg((F.max(F.col("base") + F.col("bytes")) - len(MAGIC)).alias("file_bytes"))
    if strict:
        bad = sizes.join(ends, "file", "left").where(~F.col("file_bytes").eqNullSafe(F.col("after")))
        if (first := bad.orderBy("file").first()) is not None:
            raise ValueError(f"{first['file']}: no record begins at byte {first['after'] or 0} of {first['file_bytes']}")
    else:
        records = records.join(sizes, "file").where("after <= file_bytes").drop("file_bytes")
    records = with_split_payloads(spark, path, records, blocks)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    length = F.coalesce(F.col("length").try_cast("long"), F.col("content").cast("long"))
    digest = F.when(F.col("record_type") == "revisit", F.regexp_replace("digest", "^sha256:", "")).otherwise(F.col("found"))
    return records.select("file", "off", "record_type", number("record_id").alias("page_id"), number("refers").alias("refers_to"), length.alias("payload_bytes"), digest.alias("payload_digest"))


def with_split_payloads(spark: SparkSession, path: str, records: DataFrame, blocks: DataFrame) -> DataFrame:
    """Fill in the digests (found) of payloads that no split holds whole. The splits they touch are
    read again."""
    size = F.col("content").cast("long")
    torn = stage(records.where("found IS NULL").select("file", "off", F.col("body").alias("low"), (F.col("body") + size).alias("high")), "torn")
    n = torn.count()
    if not n:
        return records
    empty = hashlib.sha256(b"").hexdigest()
    spans = torn.join(blocks, "file").where("low < high AND base < high AND base + bytes > low").select("file", "block", "base", "off", "low", "high")
    spans = F.broadcast(spans) if n <= 10_000 else spans
    lines = spark.read.option("lineSep", MAGIC).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.concat(F.col("value").cast("binary"), F.lit(MAGIC).cast("binary")).alias("value"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, 0
        for batch in batches:
            starts = []
            for file, block, value in zip(*(batch.column(i) for i in range(3))):
                if (file.as_py(), block.as_py()) != key:
                    key, at = (file.as_py(), block.as_py()), 0
                starts.append(at)
                at += len(value.as_buffer())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64())], ["file", "block", "value", "start"])

    lines = lines.mapInArrow(place, "file string, block long, value binary, start long")
    start = F.col("base") + F.col("start")
    cut = lines.join(spans, ["file", "block"]).where(start < F.col("high")).where(start + F.octet_length("value") > F.col("low"))
    skip = F.greatest(F.col("low") - start, F.lit(0))
    part = F.substring(F.col("value"), (skip + 1).cast("int"), (F.least(F.col("high"), start + F.octet_length("value")) - start - skip).cast("int"))
    cut = cut.select("file", "off", (F.col("high") - F.col("low")).alias("want"), start.alias("start"), part.alias("part"))

    def whole(rows):
        data = b"".join(rows.sort_values("start")["part"])
        ok = len(data) == rows["want"].iloc[0]
        return rows.iloc[:1][["file", "off"]].assign(d=hashlib.sha256(data).hexdigest() if ok else None)

    mended = cut.groupBy("file", "off").applyInPandas(whole, "file string, off long, d string").where("d IS NOT NULL")
    found = F.coalesce("found", "d", F.when(size == 0, F.lit(empty)))
    return records.join(mended, ["file", "off"], "left").withColumn("found", found).where("found IS NOT NULL").drop("d")
