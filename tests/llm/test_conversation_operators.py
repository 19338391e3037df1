"""The prefix trie and the repair of conversations against plain loops."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from versehall.llm import conversation_repair, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, n long, i long, conv long, block long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table_of(spark, rows):
    """Conversations with extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)


def conversations(seed, convs, most, words=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 4 * convs), convs):
        for t in range(rng.randint(1, most)):
            rows.append((c, rng.choice([t, t, t, t, None]), rng.choice(["user", "assistant", "system", None, "tool", ""]), rng.choice(["", None, "Yes.", "Go on", "Stop!", " \t"]) if rng.random() < 0.5 else f"w{rng.randint(1, words)} x."))
    rows += [(None, 1, "user", "lost"), (None, None, None, None)]
    return rows + rng.sample(rows, len(rows) // 10)


# -- prefix trie ------------------------------------------------------------------------------


def in_order(rows, filled):
    """Each conversation's (role, text) in order."""
    out = defaultdict(list)
    for c, t, role, text in rows:
        role, text = (filled if x is None else x for x in (role, text))
        out[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [x[3:] for x in sorted(v)] for c, v in out.items()}


def trie_by_loops(rows):
    own = in_order([r for r in rows if r[0] is not None], "")
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(m != n and m[: len(n)] == n for m in below) for n in below)
        saved = sum((len(members[n]) - 1) * len(WORD.findall(n[-1][1])) for n in below if n)
        ends = ",".join(str(c) for c in sorted(c for c in who if len(built[c]) == len(node)))
        out[min(who), len(node)] = (min(members[node[:-1]]) if node else None, len(who), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def nodes_of(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


@pytest.mark.parametrize("seed, convs, most, bits", [(1, 60, 6, 12), (2, 25, 14, 1), (3, 2, 1, 12)])
def test_trie_against_loops(spark, monkeypatch, seed, convs, most, bits):
    """With blocks of two turns every conversation takes the way of the very long ones."""
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", bits)
    rows = conversations(seed, convs, most)
    got = prefix_trie.trie(*prefix_trie.grafted(prefix_trie.turns(table_of(spark, rows))))
    assert got.count() == got.select("conv_id", "depth").distinct().count()
    assert nodes_of(got) == trie_by_loops(rows)


def test_trie_of_copies_and_nothing(spark):
    same = [(c, t, "user", f"turn {t}") for c in range(0, 400, 20) for t in range(3)]
    table = table_of(spark, same)
    got = nodes_of(prefix_trie.trie(*prefix_trie.grafted(prefix_trie.turns(table))))
    assert got == trie_by_loops(same) and len(got) == 4
    empty = prefix_trie.trie(*prefix_trie.grafted(prefix_trie.turns(table.limit(0))))
    assert empty.count() == 0 and empty.columns[0] == "conv_id"


def test_deep_nesting_needs_few_rounds(spark):
    """A comb: each conversation leaves the one before one turn later, so chains hang 40 deep."""
    rows = [(c, t, "user", f"t{min(t, c)}-{c if t > c else 0}") for c in range(40) for t in range(c + 2)]
    plain = prefix_trie.turns(table_of(spark, rows))
    got = prefix_trie.trie(plain, prefix_trie.lengths(plain))
    root = got.where("depth = 0").first()
    assert root.n_leaves == 40 and root.n_convs == 40
    assert got.agg(F.sum("n_children")).first()[0] == got.count() - 1


# -- repair -----------------------------------------------------------------------------------


def damaged_by_loops(rows):
    out = []
    for c, t, role, text in rows:
        c_, t_, role, text = (" " if x is None else x for x in (c, t, role, text))
        k = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (0 if not k else 2 if k == 3 else 1)
    return out


def cheapest(rows, faults):
    """(cost, initials, repaired lines) by trying every edit in every state, least first."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}
    best = {(len(rows), q): x for q, x in {"": (0, "", ()), "s": (6, "II", ("user:", "assistant:")), "u": (3, "I", ("assistant:",)), "a": (0, "", ())}.items()}
    for t in range(len(rows) - 1, -1, -1):
        (role, text), extra = rows[t], 3 * (faults[t] == "truncated")
        plain = {}
        for q in after:
            ways = [(4, "D", (), (t + 1, q))]
            if faults[t] not in ("blank", "duplicate"):
                if role[:1] in after[q]:
                    ways.append((extra, "K", (f"{role}:{text}",), (t + 1, role[:1])))
                ways += [(3 + extra, "R", (f"{name[r]}:{text}",), (t + 1, r)) for r in after[q] if r in name]
            plain[q] = min((cost + best[to][0], letter + best[to][1], line + best[to][2]) for cost, letter, line, to in ways)
        for q in after:
            best[t, q] = plain[q]
        for _ in range(3):
            for q in after:
                for r in set(after[q]) & set(name):
                    cost, letters, lines = best[t, r]
                    best[t, q] = min(best[t, q], (cost + 3, "I" + letters, (name[r] + ":", *lines)))
    return best[0, ""]


def repair_by_loops(rows, ids, filled):
    out = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in ids}
    times = defaultdict(set)
    for c, t, *_ in rows:
        times[c] |= {t} - {None}
    for c, turns in in_order(rows, filled).items():
        seen, faults = set(), []
        for x in turns:
            shown = WORD.findall(x[1])
            faults.append("blank" if not shown else "duplicate" if x in seen else "truncated" if shown[-1][-1] not in ".!?" else "")
            seen.add(x)
        odd = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest(turns, faults)
        gaps = max(times[c]) - min(times[c]) + 1 - len(times[c]) if times[c] else 0
        out[c] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], odd, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(df):
    got = df.collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


@pytest.mark.parametrize("seed, convs, most, bits", [(1, 80, 7, 12), (2, 30, 30, 2), (3, 6, 60, 1)])
def test_repair_against_loops(spark, monkeypatch, seed, convs, most, bits):
    """With blocks of two or four rows nearly every conversation lies in several."""
    monkeypatch.setattr(conversation_repair, "BLOCK_BITS", bits)
    rows = conversations(seed, convs, most, words=40)
    table = table_of(spark, rows)
    want = repair_by_loops(damaged_by_loops(rows), {r[0] for r in rows}, " ")
    assert repaired(conversation_repair.repair(conversation_repair.damaged(table), table)) == want
    plain = repair_by_loops(rows, {r[0] for r in rows}, "")
    assert repaired(conversation_repair.repair(table)) == plain


def test_repair_of_nothing_and_small_tensors(spark, monkeypatch):
    table = table_of(spark, conversations(9, 20, 5))
    assert conversation_repair.repair(table.limit(0)).count() == 0
    gone = conversation_repair.repair(table.limit(0), table)
    assert {(r.cost, r.audit) for r in gone.collect()} == {(0, "")} and gone.count() == table.select("conv_id").distinct().count()
    monkeypatch.setattr(conversation_repair, "CELLS", 8)
    assert list(map(sorted, conversation_repair._tensors([2, 9, 3, 2, 1]))) == [[1], [0, 2], [3, 4]]


def test_long_texts_and_roles(spark):
    long = "word " * 200_000 + "end."
    rows = [(1, 0, "system", "Be kind."), (1, 1, "useful", long), (1, 2, "assistant", "Yes"), (1, 3, "tool", long + "!"), (1, 4, "", "No role.")]
    assert repaired(conversation_repair.repair(table_of(spark, rows))) == repair_by_loops(rows, {1}, "")
