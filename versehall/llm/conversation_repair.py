"""Conversations repaired at the least cost, by dynamic programming over time-major tensors.

A conversation shall read `(s?(ua)+)?` in its roles' initials. Keeping a row costs 0, giving it the
role user or assistant 3, deleting it 4 (the only way with blank and repeated rows), inserting an
empty user or assistant turn 3; a truncated row that stays costs 3 more. Of the cheapest edits those
whose initials (K, R, D, I) are least in ASCII order are taken. In every state of the pattern only
one role can be inserted or given, so the initials say all.

Conversations are sorted by length and dealt with in tensors of shape (turn, conversation, state):
costs to the end are filled backwards for all conversations at once and stored, then all edits are
traced forwards, turn by turn. A conversation's rows are cut at fixed blocks of 4096 rows of the
sorted table. One that lies in several blocks is not put together: every block gives its 4 x 4 costs
from state to state, the blocks' costs to the end follow from these, and then the state in which
each block is entered; the edits are traced block by block. The repaired texts run through one
digest per conversation as a stream, in order.

Defined cases: null role or text is empty; rows of equal turn stand in order of the MD5 of role and
text, a null turn first; rows without an id are one conversation of the null id; a role that begins
with none of s, u, a (also an empty one) cannot be kept; a text of any length is read whole; other
columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versehall.llm.common import ship, stage

BLOCK_BITS = 12
CELLS = 1 << 18  # turns x conversations in one tensor
SPACE = " \t\n\x0b\x0c\r"
GIVE, DROP, ADD, CUT_OFF = 3, 4, 3, 3
INF = np.int64(1) << 40
#: states: nothing yet, behind s, behind u, behind a; the state behind an inserted or given role
NEXT = np.array([2, 2, 3, 2])
#: the state behind a kept row by state and role (s, u, a, other); -1: not allowed
KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: costs from the last row to the end, with the turns that are then inserted
END = [0, 6, 3, 0]
END_ADDS = ["", "ua", "a", ""]
LEGAL = {(0, 1), (1, 2), (2, 1)}

_FOUND = "key string, block long, cost long, audit string, illegal long, opens int, closes int, tail string, edits array<struct<turn:long,digest:string,op:string>>"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with seeded faults, for trials: nulls become one space, and the CRC-32 of `conv_id:turn`
    modulo 20 drops a row (0), empties its text (1), takes its .!? away (2), repeats it (3) or makes
    its role user (4)."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(s("conv_id"), F.lit(":"), s("turn"))) % 20
    rows = conversations.select("conv_id", "turn", s("role").alias("role"), s("text").alias("text"), k.alias("k")).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("k") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("twice", F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


# -- the tensors ------------------------------------------------------------------------------


class Tensor:
    """Costs to the end of blocks of rows, each with its codes (role + 4 x must go + 8 x cut off), the
    costs beyond it by state, all turn by turn. Blocks are sorted by length, longest first, so that
    those still running at a turn are the first ones."""

    def __init__(self, codes: list[list[int]], beyond: np.ndarray):
        self.order = np.argsort([-len(c) for c in codes], kind="stable")
        self.size = np.array([len(codes[i]) for i in self.order])
        steps = int(self.size[0])
        self.alive = [int(np.searchsorted(-self.size, -t, "left")) for t in range(steps)]
        code = np.zeros((steps, len(codes)), np.int8)
        for j, i in enumerate(self.order):
            code[: len(codes[i]), j] = codes[i]
        self.role, self.must, self.extra = code & 3, (code & 4) > 0, np.where(code & 8, CUT_OFF, 0)
        self.cost = np.empty((steps + 1, len(codes), 4), np.int64)
        self.cost[:] = beyond[self.order]
        for t in range(steps - 1, -1, -1):
            n = self.alive[t]
            after = self.cost[t + 1, :n]
            best = after + DROP
            for stays in (self._kept(t, n, after), self._given(t, n, after)):
                np.minimum(best, stays, out=best)
            once = np.minimum(best, best[:, NEXT] + ADD)
            self.cost[t, :n] = np.minimum(best, once[:, NEXT] + ADD)

    def _kept(self, t: int, n: int, after: np.ndarray) -> np.ndarray:
        to = KEEP[:, self.role[t, :n]].T
        cost = np.take_along_axis(after, np.maximum(to, 0), 1) + self.extra[t, :n, None]
        return np.where((to < 0) | self.must[t, :n, None], INF, cost)

    def _given(self, t: int, n: int, after: np.ndarray) -> np.ndarray:
        return np.where(self.must[t, :n, None], INF, after[:, NEXT] + GIVE + self.extra[t, :n, None])

    def trace(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The least of the cheapest edits from the given states: letters (turn, slot, block) as
        bytes (0: none), the state before each turn's last letter, and the states at the ends."""
        steps, q = len(self.alive), np.array(entry)[self.order]
        made, state = np.zeros((steps, 3, len(q)), np.uint8), np.zeros((steps, len(q)), np.int8)
        for t in range(steps):
            n = self.alive[t]
            rows, s = np.arange(n), q[:n].copy()
            here, after = self.cost[t, :n], self.cost[t + 1, :n]
            for slot in (0, 1):
                adds = (here[rows, s] != after[rows, s] + DROP) & (here[rows, s] == here[rows, NEXT[s]] + ADD)
                made[t, slot, :n][adds] = ord("I")
                s = np.where(adds, NEXT[s], s)
            drop = here[rows, s] == after[rows, s] + DROP
            keep = ~drop & (here[rows, s] == self._kept(t, n, after)[rows, s])
            made[t, 2, :n] = np.where(drop, ord("D"), np.where(keep, ord("K"), ord("R")))
            state[t, :n] = s
            q[:n] = np.where(drop, s, np.where(keep, KEEP[s, self.role[t, :n]], NEXT[s]))
        return made, state, q


def _tensors(sizes: list[int]) -> Iterator[list[int]]:
    """Indices of blocks, sorted by length and put together up to CELLS turns x blocks."""
    group: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if group and (len(group) + 1) * sizes[group[0]] > CELLS:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def _solved(blocks: DataFrame, want: str) -> DataFrame:
    """Blocks (key, block, rows, beyond, entry, closing) through the tensors. `want`: matrix (costs
    from state to state), exits (the end state from each state) or edits."""
    ship(blocks.sparkSession)
    schema = _FOUND if want == "edits" else f"key string, block long, {want} array<long>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def record(t: Tensor, j: int, r: dict, traced: tuple) -> dict:
        made, state, ends = traced
        n, rows = int(t.size[j]), r["rows"]
        audit = made[:n, :, j].tobytes().replace(b"\0", b"").decode()
        last, adds = made[:n, 2, j], (made[:n, :2, j] > 0).sum(axis=1)
        edits = []
        for k in np.flatnonzero(last != ord("D")):
            q, more = int(state[k, j]), int(adds[k])
            # the roles inserted before end where this row begins: u before a state behind u, and so on
            ins = {0: "", 1: "ua"[q - 2] if q > 1 else "", 2: "au" if q == 2 else "ua"}[more]
            op = "K" if last[k] == ord("K") else "ua"[NEXT[q] - 2].upper()
            edits.append({"turn": rows[k]["turn"], "digest": rows[k]["digest"], "op": ins + op})
        roles = t.role[:n, j].tolist()
        tail = END_ADDS[ends[j]] if r["closing"] else ""
        return {
            "key": r["key"], "block": r["block"], "cost": int(t.cost[0, j, r["entry"]] - (0 if r["closing"] else r["beyond"][ends[j]])), "audit": audit + "I" * len(tail),
            "illegal": sum(p not in LEGAL for p in zip(roles, roles[1:])), "opens": roles[0], "closes": roles[-1], "tail": tail, "edits": edits,
        }

    def solve(rows: list[dict]) -> Iterator[dict]:
        for group in _tensors([len(r["rows"]) for r in rows]):
            mine = [rows[i] for i in group]
            codes = [[x["code"] for x in r["rows"]] for r in mine]
            if want == "matrix":
                costs = []
                for to in range(4):
                    t = Tensor(codes, np.where(np.arange(4) == to, 0, INF)[None].repeat(len(mine), 0))
                    back = np.argsort(t.order)
                    costs.append(t.cost[0][back])
                for r, m in zip(mine, np.stack(costs, 2).reshape(len(mine), 16)):
                    yield {"key": r["key"], "block": r["block"], "matrix": np.minimum(m, INF).tolist()}
                continue
            t = Tensor(codes, np.array([r["beyond"] for r in mine]))
            if want == "exits":
                ends = np.stack([t.trace(np.full(len(mine), q))[2] for q in range(4)], 1)
                for j, i in enumerate(t.order):
                    yield {"key": mine[i]["key"], "block": mine[i]["block"], "exits": ends[j].tolist()}
                continue
            traced = t.trace(np.array([r["entry"] for r in mine]))
            for j, i in enumerate(t.order):
                yield record(t, j, mine[i], traced)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells = [], 0
            for row in (r for at in range(0, batch.num_rows, 256) for r in batch.slice(at, 256).to_pylist()):
                rows.append(row)
                cells += len(row["rows"])
                if cells > CELLS // 4:
                    yield pa.RecordBatch.from_pylist(list(solve(rows)), out)
                    rows, cells = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(list(solve(rows)), out)

    return blocks.select("key", "block", "rows", "beyond", "entry", "closing").mapInArrow(run, schema)


# -- tables -----------------------------------------------------------------------------------


def _one(rows: DataFrame, kind: str, each) -> DataFrame:
    """(key, block, `kind`) for each key's blocks in order, by a function of their numbers."""
    ship(rows.sparkSession)
    grouped = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "given"))).alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = [x["block"] for x in r["list"]]
                made = each([x["given"] for x in r["list"]])
                yield pa.RecordBatch.from_arrays([pa.array([r["key"]] * len(at)), pa.array(at, pa.int64()), pa.array(made, pa.list_(pa.int64()))], ["key", "block", kind])

    return grouped.mapInArrow(run, f"key string, block long, `{kind}` array<long>")


def _beyond(matrices: list[list[int]]) -> list[list[int]]:
    """The costs from the end of each block to the end of the conversation."""
    out, cur = [], np.array(END, np.int64)
    for m in reversed(matrices):
        out.append(cur.tolist())
        cur = np.minimum((np.array(m).reshape(4, 4) + cur).min(axis=1), INF)
    return out[::-1]


def _entries(exits: list[list[int]]) -> list[list[int]]:
    """The state in which each block is entered."""
    out, q = [], 0
    for x in exits:
        out.append([q])
        q = x[q]
    return out


def _edits(blocks: DataFrame) -> DataFrame:
    """The edits of all blocks: conversations in one block at once, the others over their blocks."""
    span = blocks.groupBy("key").agg(F.max("block").alias("final"), F.count("*").alias("blocks")).where("blocks > 1")
    end, none = F.array(*[F.lit(x).cast("long") for x in END]), F.lit(0)
    if not span.limit(1).count():
        return _solved(blocks.withColumn("beyond", end).withColumn("entry", none).withColumn("closing", F.lit(True)), "edits")
    span = stage(span, "spans")
    alone = blocks.join(span.hint("merge"), "key", "left_anti").withColumn("beyond", end).withColumn("entry", none).withColumn("closing", F.lit(True))
    some = stage(blocks.join(span.hint("merge"), "key").withColumn("closing", F.col("block") == F.col("final")).drop("blocks", "final"), "long-blocks")
    made = _solved(some.withColumn("beyond", end).withColumn("entry", none), "matrix")
    beyond = stage(_one(made.withColumnRenamed("matrix", "given"), "beyond", _beyond), "beyond")
    some = some.join(beyond.hint("merge"), ["key", "block"])
    made = _solved(some.withColumn("entry", none), "exits")
    entry = _one(made.withColumnRenamed("exits", "given"), "entry", _entries).withColumn("entry", F.element_at("entry", 1).cast("int"))
    some = some.join(stage(entry, "entries").hint("merge"), ["key", "block"])
    return _solved(alone, "edits").union(_solved(some, "edits"))


def _digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(key, repaired_sha256) of rows (key, turn, digest, role, text) and the edits of the blocks. Both are
    dealt out by conversation and sorted, an edit before its row; texts are shuffled this once and
    streamed, so that a conversation of any size takes no more memory than a row."""
    edits = found.select("key", F.explode("edits").alias("e")).select("key", F.lit(0).alias("late"), "e.turn", "e.digest", F.lit(0).alias("tag"), "e.op", F.lit("").alias("role"), F.lit("").alias("text"))
    tails = found.where("tail <> ''").select("key", F.lit(1).alias("late"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("digest"), F.lit(0).alias("tag"), F.col("tail").alias("op"), F.lit("").alias("role"), F.lit("").alias("text"))
    texts = rows.select("key", F.lit(0).alias("late"), "turn", "digest", F.lit(1).alias("tag"), F.lit("").alias("op"), "role", "text")
    every = texts.union(edits).union(tails).repartition("key").sortWithinPartitions("key", "late", F.col("turn").asc_nulls_first(), "digest", "tag")
    names = {"u": b"user:", "a": b"assistant:"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, begun, waits, done = None, None, False, None, []

        def line(*parts: bytes) -> None:
            nonlocal begun
            if begun:
                digest.update(b"\n")
            begun = True
            for p in parts:
                digest.update(p)

        def out(upto: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in upto], pa.string()), pa.array([d.hexdigest() for _, d in upto], pa.string())], ["key", "repaired_sha256"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for k, late, turn, dig, tag, op, role, text in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns]):
                    if k != key:
                        key, digest, begun, waits = k, hashlib.sha256(), False, None
                        done.append((key, digest))
                    if late:
                        for x in op:
                            line(names[x])
                    elif not tag:
                        waits = (turn, dig, op)
                    elif waits and waits[:2] == (turn, dig):
                        *adds, last = waits[2]
                        for x in adds:
                            line(names[x])
                        line(role.encode() + b":" if last == "K" else names[last.lower()], text.encode())
                        waits = None
            if len(done) > 4096:
                yield out(done[:-1])
                done = done[-1:]
        if done:
            yield out(done)

    return every.mapInArrow(run, "key string, repaired_sha256 string")


def repair(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row a conversation (of `ids`, a table with conv_id, if given: also those without rows): gaps in its turns,
    faults by kind (each row's first of blank, duplicate, truncated), illegal neighbours, the cost and
    initials of the cheapest edits and the digest of the repaired conversation."""
    kind = dict(conversations.dtypes)["conv_id"]
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select(key.alias("key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    shown: Column = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = code + F.when(shown == "", 4).when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), 8).otherwise(0)
    order = ["key", "turn", "digest"]
    narrow = rows.select(*order, code.cast("int").alias("code")).repartitionByRange(*order).sortWithinPartitions(*order)
    narrow = stage(narrow.withColumn("at", F.monotonically_increasing_id()), "repair-rows")
    firsts = narrow.groupBy("key", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("is_first"))
    # a row joins by its own place, so that no conversation and no often repeated row is a hot key
    seen = narrow.join(firsts, "at", "left").withColumn("again", F.col("is_first").isNull())
    blank, cut = F.col("code").bitwiseAND(4) > 0, F.col("code").bitwiseAND(8) > 0
    fault = F.when(blank, "blank").when(F.col("again"), "duplicate").when(cut, "truncated")
    seen = stage(seen.withColumn("fault", fault).select("key", "turn", "digest", "at", (F.col("code").bitwiseAND(3) + F.when(blank | F.col("again"), 4).when(cut, 8).otherwise(0)).alias("code"), "fault"), "repair-faults")
    cells = F.array_sort(F.collect_list(F.struct("at", "turn", "digest", "code")))
    blocks = stage(seen.groupBy("key", F.shiftright("at", BLOCK_BITS).alias("block")).agg(cells.alias("rows")), "repair-blocks")
    found = stage(_edits(blocks), "repair-edits")

    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = seen.groupBy("key").agg(F.coalesce(gaps, F.lit(0)).alias("gaps"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    parts = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "opens", "closes", "illegal", "cost", "audit"))).alias("p"))
    legal = lambda x, y: F.concat_ws(",", x.cast("string"), y.cast("string")).isin("0,1", "1,2", "2,1")
    between = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p")), lambda x, y: F.when(legal(x["closes"], y["opens"]), 0).otherwise(1).cast("long"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
    parts = parts.select("key", (total(F.transform("p", lambda x: x["illegal"])) + total(between)).alias("illegal"), total(F.transform("p", lambda x: x["cost"])).alias("cost"), F.array_join(F.transform("p", lambda x: x["audit"]), "").alias("audit"))
    every = (conversations if ids is None else ids).select(key.alias("key")).distinct()
    every = every.join(counts, "key", "left").join(parts, "key", "left").join(_digests(rows, found), "key", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    sha = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return every.select(F.when(F.col("key") != "", F.col("key")).cast(kind).alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), sha)
