"""Token counts by overlap resynchronisation, for a sentencepiece BPE model.

A text of ordinary length is encoded whole. A huge one is cut into chunks that each run on over the
start of the next; all chunks are encoded apart, dealt out over the cluster, with the offsets of
their tokens. Two neighbours are spliced at the first token that both have at the same place. Such a
token proves the splice: a sequence is the encoding of its text exactly if every two neighbouring
tokens are the encoding of their joined text (the first merge across a border of the sequence would
already happen between the two alone). Left of the shared token all pairs come from the left chunk's
encoding, right of it all from the right one's, so the joined sequence is the whole text's encoding.
Where two neighbours share no token the overlap is widened eightfold, up to the whole right chunk;
then the two become one chunk. In the end a text without any common boundary is encoded whole.

Defined cases: null text is the empty text (0 bytes, 0 tokens); repeated rows give repeated results;
an empty table an empty result. Columns in `keep` pass untouched; they may not have an output's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versehall.llm.common import forget, in_arrow, ship, stage, unused

CHUNK = 1 << 14  # characters; a text of more than two chunks is cut
OVERLAP = 256  # characters at first
LIMIT = 4096
SLICE = 8 << 20  # bytes of chunks in one Arrow batch

_SPEC = "array<struct<start:long,stop:long,over:long,head:long>>"
_PARTS = "row long, start long, stop long, over long, head long, n long, first map<long,int>, last map<long,int>"
_models: dict[bytes, object] = {}


def _model(proto: bytes):
    """The processor of a model, made once a worker."""
    known = _models.get(proto)
    if known is None:
        import sentencepiece

        _models.clear()
        known = _models[proto] = sentencepiece.SentencePieceProcessor(model_proto=proto)
    return known


def _marks(ids: list[int], offsets: list[tuple[int, int]], low: int, high: int) -> dict[int, int]:
    """Tokens that begin in [low, high) of a chunk: (place, id, width) in one number -> their index.
    Tokens of no width (bytes before a character's last) have no place of their own and are left out."""
    return {(a - low) << 28 | i << 8 | min(b - a, 255): k for k, (i, (a, b)) in enumerate(zip(ids, offsets)) if low <= a < high and b > a}


def _cut(texts: DataFrame) -> DataFrame:
    """Rows (row, text, specs) -> one row a chunk, with the chunk's own text and its overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "start", "stop", "over", "head", "text"]
        kinds = [pa.int64()] * 5 + [pa.string()]
        for batch in batches:
            for at in range(batch.num_rows):
                row, text, specs = (batch.column(i)[at].as_py() for i in range(3))
                held, size = [], 0
                for s in specs:
                    part = text[s["start"] : s["stop"] + s["over"]]
                    held.append((row, s["start"], s["stop"], s["over"], s["head"], part))
                    size += 4 * len(part)
                    if size > SLICE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

    return texts.select("row", "text", "specs").mapInArrow(run, "row long, start long, stop long, over long, head long, text string")


def _encode(chunks: DataFrame, model) -> DataFrame:
    """Chunks dealt out and encoded: their number of tokens and the tokens in both overlaps."""

    def rows(part: dict) -> dict:
        sp = _model(model.value)
        out = {k: part[k] for k in ("row", "start", "stop", "over", "head")} | {"n": [], "first": [], "last": []}
        for text, start, stop, head in zip(part["text"], part["start"], part["stop"], part["head"]):
            got = sp.encode(text, return_type="offset_mapping")
            ids, offsets = got["ids"], got["offsets"]
            out["n"].append(len(ids))
            out["first"].append(list(_marks(ids, offsets, 0, head).items()))
            out["last"].append(list(_marks(ids, offsets, stop - start, len(text)).items()))
        return out

    return in_arrow(chunks.repartition("row", "start"), rows, _PARTS, max_rows=64)


def _seams(parts: DataFrame) -> DataFrame:
    """Every chunk with the seam behind it: left and right (the shared token's index in both), fail."""
    w = Window.partitionBy("row").orderBy("start")
    near = parts.withColumn("__first", F.lead("first").over(w)).withColumn("__size", F.lead("stop").over(w) - F.lead("start").over(w))
    shared = F.array_min(F.array_intersect(F.map_keys("last"), F.map_keys("__first")))
    near = near.withColumn("__shared", F.when(F.col("__size").isNotNull(), shared))
    left, right = F.try_element_at("last", F.col("__shared")), F.try_element_at("__first", F.col("__shared"))
    return near.withColumn("left", left).withColumn("right", right).withColumn("fail", F.col("__size").isNotNull() & F.col("__shared").isNull())


def _widen(seams: DataFrame) -> DataFrame:
    """The next round's chunks: failed overlaps eightfold, those over the whole next chunk joined
    with it. `redo` marks chunks to encode anew; the others keep what they have."""
    w = Window.partitionBy("row").orderBy("start")
    join = F.col("fail") & (F.col("over") >= F.col("__size"))
    s = seams.withColumn("__join", join).withColumn("__isle", F.sum(F.when(F.lag("__join").over(w), 0).otherwise(1)).over(w))
    s = s.withColumn("__wide", F.col("fail") & ~F.col("__join"))
    s = s.withColumn("over", F.when(F.col("__wide"), F.least(F.col("over") * 8, F.col("__size"))).otherwise(F.col("over")))
    last = lambda c: F.max_by(c, "start").alias(c)
    made = s.groupBy("row", "__isle").agg(
        F.min("start").alias("begin"), F.max("stop").alias("stop"), last("over"), last("__wide"), F.min_by("head", "start").alias("head"),
        F.min_by("n", "start").alias("n"), F.min_by("first", "start").alias("first"), F.min_by("last", "start").alias("last"), (F.count("*") > 1).alias("__many"),
    )
    made = made.withColumnRenamed("begin", "start")
    before = F.lag("over").over(w)
    made = made.withColumn("__was", F.col("head")).withColumn("head", F.coalesce(before, F.lit(0)).cast("long"))
    return made.select("row", "start", "stop", "over", "head", "n", "first", "last", (F.col("__many") | F.col("__wide") | (F.col("head") != F.col("__was"))).alias("redo"))


def _huge(docs: DataFrame, model, chunk: int, overlap: int) -> DataFrame:
    """(row, n_tokens) of staged huge texts (row, text)."""
    size = F.length("text")
    pieces = F.ceil(size / chunk).cast("long")

    def spec(k):
        start, stop = k * chunk, F.least((k + 1) * chunk, size).cast("long")
        return F.struct(start.alias("start"), stop.alias("stop"), F.least(F.lit(overlap), size - stop).cast("long").alias("over"), F.when(k == 0, 0).otherwise(F.least(F.lit(overlap), size - start)).cast("long").alias("head"))

    first = docs.withColumn("specs", F.transform(F.sequence(F.lit(0).cast("long"), pieces - 1), spec).cast(_SPEC))
    parts = stage(_encode(_cut(first), model), "token-parts")
    while True:
        seams = _seams(parts)
        if not seams.where("fail").limit(1).count():
            break
        state = stage(_widen(seams), "token-state")
        specs = state.where("redo").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "over", "head"))).cast(_SPEC).alias("specs"))
        again = _encode(_cut(docs.join(specs, "row")), model)
        fresh = stage(state.where("NOT redo").drop("redo").unionByName(again), "token-parts")
        forget(parts, state)
        parts = fresh
    return seams.groupBy("row").agg(F.sum(F.coalesce(F.col("left") - F.col("right"), F.col("n"))).cast("long").alias("n_tokens"))


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT, keep: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The kept columns, n_bytes (UTF-8), n_tokens of the whole `text` and over_limit.

    The model (its size is fixed) is read on the driver and broadcast. Ordinary texts are a narrow
    map; only texts of more than two chunks are staged and dealt out again, chunk by chunk."""
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must be positive and at most a chunk")
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    text, size = unused(docs, "text_", "bytes_")
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias(text)).withColumn(size, F.octet_length(text).cast("long"))
    huge = F.length(text) > 2 * chunk
    kinds = dict(docs.dtypes)

    def whole(part: dict) -> dict:
        found = _model(model.value).encode(part[text], num_threads=1, return_type="numpy") if part[text] else []
        return {k: part[k] for k in keep} | {"n_bytes": part[size], "n_tokens": [len(x) for x in found]}

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["n_bytes long, n_tokens long"])
    short = in_arrow(rows.where(~huge), whole, schema)
    row = unused(docs, "row_")[0]
    long = stage(rows.where(huge).withColumn(row, F.monotonically_increasing_id()), "token-huge")
    counts = _huge(long.select(F.col(row).alias("row"), F.col(text).alias("text")), model, chunk, overlap)
    counted = long.drop(text).join(counts.withColumnRenamed("row", row), row).select(*keep, F.col(size).alias("n_bytes"), "n_tokens")
    return short.union(counted).withColumn("over_limit", F.col("n_tokens") > limit)
