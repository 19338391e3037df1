"""The prefix trie of a table of conversations, without walking a tree.

Every distinct sequence of first turns is a node; conversations that begin with it are its members,
and the smallest of them owns it. Who owns a prefix owns all its longer ones, so a conversation's
own nodes are a chain from its first owned depth to its last turn, and these chains form the tree.

* A turn is known by a digest, a prefix by the exclusive or of hashes of (place, turn) in two lanes
  of 64 bits, so that prefixes are running sums, taken in blocks of a long conversation.
* The first owned depth is searched for by halving steps in batched joins against the minima of the
  prefixes. A search that starts at 0 and tries steps 2^k, 2^(k-1), ... meets in the round of step s
  only odd multiples of s, so each round joins with its own class of depths: all rounds together
  shuffle every prefix once, not once a round.
* Chains are summed bottom-up by doubling: in round k every chain gives the sums of its descendants
  nearer than 2^k to its 2^k-th ancestor, at the depth where its line leaves that ancestor.

Defined cases: rows without an id belong to no conversation and take no part; null role or text is
empty; rows of equal turn stand in order of the MD5 of role and text; a null turn comes first;
repeated rows are turns of their own; a text of any length is hashed whole; other columns play no
part; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versehall.llm.common import attach, forget, ship, stage
from versehall.llm.source_mix import n_words

BLOCK_BITS = 12  # turns, or ids of ending conversations, that are put together in one place


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, i from 1, digest, words) of rows (conv_id, turn, role, text). Staged.

    Rows are dealt out by ranges of (conversation, turn), so that a conversation with a third of all
    rows is numbered by many tasks; only digests travel. At most one conversation runs on into each
    range, which bounds the broadcast table of offsets."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), n_words(text).alias("words"))
    order = ["conv", "turn", "digest"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "words", F.monotonically_increasing_id().alias("at"))
    ranged = stage(ranged.withColumn("range", F.shiftright("at", 33)), "turn-ranges")
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranged.groupBy("conv", "range").agg(F.count("*").alias("n")).select("conv", "range", before.alias("before")).where("before > 0")
    own = F.row_number().over(Window.partitionBy("conv", "range").orderBy("at"))
    placed = ranged.withColumn("own", own).join(F.broadcast(offsets), ["conv", "range"], "left")
    out = stage(placed.select("conv", (F.col("own") + F.coalesce("before", F.lit(0))).cast("long").alias("i"), "digest", "words"), "turns")
    forget(ranged)
    return out


def lengths(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv").agg(F.max("i").alias("n"))


def grafted(rows: DataFrame, group: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from the first conversation of their group: the first h
    turns of conversation c - c % group (h = crc32 of c, modulo most + 1), then c's own after its
    first h. Gives the turns and (conv, n) of every conversation, also of those left without turns."""
    n = lengths(rows)
    base, h = F.col("conv") - F.col("conv") % group, F.crc32(F.col("conv").cast("string")) % (most + 1)
    firsts = rows.where((F.col("conv") % group == 0) & (F.col("i") <= most))
    bases = n.where(F.col("conv") % group == 0).select(F.col("conv").alias("base"), F.least("n", F.lit(most)).alias("there"))
    every = stage(attach(n.withColumn("base", base).withColumn("h", h), bases, "base", F.col("conv")), "grafts")
    every = every.withColumn("from_base", F.least("h", F.coalesce("there", F.lit(0))).cast("long"))
    head = every.select("conv", "base", "from_base").join(firsts.select(F.col("conv").alias("base"), "i", "digest", "words"), "base").where("i <= from_base")
    own = attach(rows.withColumn("base", base).withColumn("h", h).where("i > h"), bases, "base", F.xxhash64("conv", "i"))
    own = own.withColumn("i", (F.col("i") - F.col("h") + F.least("h", F.coalesce("there", F.lit(0)))).cast("long"))
    kept = F.col("from_base") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return head.select("conv", "i", "digest", "words").union(own.select("conv", "i", "digest", "words")), every.select("conv", kept.cast("long").alias("n"))


def _running(rows: DataFrame, at: str, columns: dict[str, Column], how, longest: int) -> DataFrame:
    """`rows` with the running sums (`how` is sum or bit_xor) of `columns` along `at` (from 0 or 1)
    in each conversation. Sums run within blocks; where there is more than one, blocks' totals are
    summed in turn and laid under them."""
    block = F.shiftright(at, BLOCK_BITS)
    w = Window.partitionBy("conv", "block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("block", block).withColumns({f"_{k}": c for k, c in columns.items()})
    rows = rows.withColumns({k: how(f"_{k}").over(w) for k in columns})
    if longest >> BLOCK_BITS:
        rows = stage(rows, "blocks")
        b = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        totals = rows.groupBy("conv", "block").agg(*[how(f"_{k}").alias(f"_{k}") for k in columns])
        under = totals.select("conv", "block", *[how(f"_{k}").over(b).alias(f"under_{k}") for k in columns]).where("block > 0")
        under = rows.where("block > 0").join(under.hint("merge"), ["conv", "block"])
        both = {k: F.col(k) + F.col(f"under_{k}") if how is F.sum else F.col(k).bitwiseXOR(F.col(f"under_{k}")) for k in columns}
        first = rows.where("block = 0")
        rows = first.union(under.withColumns(both).select(*first.columns))
    return rows.drop("block", *[f"_{k}" for k in columns])


def _owners(prefixes: DataFrame, convs: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """The nodes (conv, depth, n_convs, words) below the root, and every conversation with `pos`, its
    deepest prefix that another one owns (0: none but the root), and `up`, who owns that."""
    state = stage(convs.select("conv", "n", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("long").alias("up")), "search")
    nodes, step = [], 1 << max(0, longest.bit_length() - 1)
    while step and longest:
        mine = prefixes.where(F.col("cls") == step)
        minima = stage(mine.groupBy("i", "a", "b").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.min("words").alias("words")), "minima")
        nodes.append(minima.select(F.col("owner").alias("conv"), F.col("i").alias("depth"), "n_convs", "words"))
        fits = F.col("pos") + step <= F.col("n")
        probe = state.where(fits).withColumn("i", F.col("pos") + step).join(mine.select("conv", "i", "a", "b"), ["conv", "i"])
        found = probe.join(minima.hint("merge"), ["i", "a", "b"])
        other = F.col("owner") < F.col("conv")
        moved = found.select("conv", "n", F.when(other, F.col("i")).otherwise(F.col("pos")).alias("pos"), F.when(other, F.col("owner")).otherwise(F.col("up")).alias("up"))
        after = stage(moved.union(state.where(~fits)), "search")
        forget(state)
        state, step = after, step >> 1
    out = nodes[0] if nodes else prefixes.select("conv", F.col("i").alias("depth"), F.lit(1).cast("long").alias("n_convs"), "words")
    for more in nodes[1:]:
        out = out.union(more)
    return out, state


def _attached(chains: DataFrame) -> DataFrame:
    """(conv, depth, saved, leaves): the sums of all chains that hang from that node of that chain,
    at any distance, from chains (conv, parent, at, saved, leaves)."""
    none = chains.select(F.col("parent").alias("conv"), F.col("at").alias("depth"), "saved", "leaves").where("false")
    state, given = stage(chains, "chains"), [none]
    while state.where("parent IS NOT NULL").limit(1).count():
        hung = state.where("parent IS NOT NULL")
        given.append(hung.groupBy(F.col("parent").alias("conv"), F.col("at").alias("depth")).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")))
        got = hung.groupBy(F.col("parent").alias("conv")).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("more_leaves"))
        above = state.select(F.col("conv").alias("parent"), F.col("parent").alias("over"), F.col("at").alias("over_at")).where("over IS NOT NULL")
        up = hung.select("conv", "parent").join(above.hint("merge"), "parent").select("conv", "over", "over_at")
        grown = state.drop("parent", "at").join(got, "conv", "left").join(up, "conv", "left")
        grown = grown.select("conv", F.col("over").alias("parent"), F.col("over_at").alias("at"), (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"))
        state = stage(grown, "chains")
    every = given[0]
    for more in given[1:]:
        every = every.union(more)
    return every.groupBy("conv", "depth").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))


def _digests(ends: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256) from rows (conv, depth, member). Ids are joined in blocks of their
    range, at most 4096 each; a node's blocks then run through one digest as a stream, in order, with
    nothing held but the digest's own state."""
    ship(ends.sparkSession)
    text = F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda m: m.cast("string")), ",")
    parts = ends.groupBy("conv", "depth", F.shiftright("member", BLOCK_BITS).alias("block")).agg(text.alias("ids"))
    parts = parts.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "block").select("conv", "depth", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0][i] for r in rows], pa.int64()) for i in (0, 1)] + [pa.array([r[1].hexdigest() for r in rows])], ["conv", "depth", "ends_sha256"])

        key, digest, done = None, None, []
        for batch in batches:
            for conv, depth, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if (conv, depth) == key:
                    digest.update(b"," + ids.encode())
                else:
                    key, digest = (conv, depth), hashlib.sha256(ids.encode())
                    done.append((key, digest))
            if len(done) > 4096:
                yield out(done[:-1])
                done = done[-1:]
        if done:
            yield out(done)

    return parts.mapInArrow(run, "conv long, depth long, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node, from turns (conv, i from 1 without gaps, digest, words) and conversations
    (conv, n turns): conv_id (the owner), depth, parent_conv_id (null: root), n_convs, n_children,
    n_leaves, saved_tokens (over the subtree, (n_convs - 1) times the words of a node's last turn) and
    ends_sha256 (of the ids of the members that end there, ascending, joined by commas)."""
    convs = stage(convs, "convs")
    first, total, longest = convs.agg(F.min("conv"), F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    lane = {k: F.xxhash64(F.lit(s), "i", "digest") for s, k in enumerate("ab")}
    prefixes = _running(rows, "i", lane, F.bit_xor, longest).select("conv", "i", "a", "b", "words")
    # sorted by class, so that a round's filter skips the row groups of the others
    prefixes = stage(prefixes.withColumn("cls", F.col("i").bitwiseAND(-F.col("i"))).sortWithinPartitions("cls"), "prefixes")
    below, state = _owners(prefixes, convs, longest)

    root = rows.sparkSession.range(1 if total else 0).select(F.lit(first).cast("long").alias("conv"), F.lit(0).cast("long").alias("depth"), F.lit(total).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("words"))
    nodes = stage(below.union(root), "nodes")
    is_first = F.col("conv") == F.lit(first)
    chains = state.where((F.col("pos") < F.col("n")) | is_first)
    chains = stage(chains.select("conv", "n", F.when(is_first, 0).otherwise(F.col("pos") + 1).cast("long").alias("top"),
                                 F.when(~is_first, F.coalesce("up", F.lit(first))).cast("long").alias("parent"), F.when(~is_first, F.col("pos")).alias("at")), "own-chains")
    kids = stage(chains.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv"), F.col("at").alias("depth")).agg(F.count("*").alias("kids")), "kids")
    saved = nodes.groupBy("conv").agg(F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    leaf = chains.join(kids.select("conv", F.col("depth").alias("n"), "kids"), ["conv", "n"], "left").join(saved, "conv")
    sums = _attached(leaf.select("conv", "parent", "at", "saved", F.col("kids").isNull().cast("long").alias("leaves")))

    end_of = F.when(F.col("pos") < F.col("n"), F.col("conv")).when(F.col("pos") > 0, F.col("up")).otherwise(F.lit(first))
    ends = _digests(state.select(end_of.cast("long").alias("conv"), F.col("n").alias("depth"), F.col("conv").alias("member")))
    at = ["conv", "depth"]
    every = nodes.join(chains.select("conv", "n", "top", "parent").hint("merge"), "conv").join(kids, at, "left").join(sums, at, "left").join(ends, at, "left")
    children = F.coalesce("kids", F.lit(0)) + (F.col("depth") < F.col("n")).cast("long")
    every = every.withColumn("n_children", children).withColumn("up", F.col("n") - F.col("depth"))
    own = {"n_leaves": F.coalesce("leaves", F.lit(0)) + (F.col("n_children") == 0).cast("long"), "saved_tokens": F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")}
    every = _running(every, "up", own, F.sum, longest)
    return every.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
