"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of parts of two kinds: an embedding of the word and the mean embedding of
its character 3- and 4-grams (both hashed). A forward and a backward GRU read windows of WINDOW
words, attention pools their states, and a logistic unit scores the window. Windows overlap by half
and cover the whole text; the document's score is a logistic function of its highest window and the
number of windows.

Training is multiple-instance: first every window bears its document's label, then toxic documents
are represented by their highest windows. It sees at most MAX_DOCS labelled documents a class, whole:
all their windows, in order of a hash of their ids as long as these come to at most MAX_WINDOWS a class (a document of more
than an eighth of that is passed over). That bound of the sample is what may reach the driver.

Defined cases: null and empty texts score as one window without words; texts of any length are scored
whole, in windows; repeated rows get equal scores; all columns of the documents are kept whatever
their names (the score replaces a column of its name); equal windows tie without effect; labels of unknown or null
documents are ignored, a document labelled more than once counts as toxic if any label says so;
without both classes among the labels every document gets the rate of label 1 (0 without labels);
an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versehall.llm.common import in_arrow, stage, unused

WINDOW = 32
MAX_DOCS = 2000
MAX_WINDOWS = 1 << 16  # of the rows of a label together
WORD_ROWS, CHAR_ROWS = 1 << 14, 1 << 15
WORD_DIM, CHAR_DIM, HIDDEN = 8, 12, 8
GRAMS = (3, 4)
MIN_DOCS = 3  # training documents a word or n-gram bucket must occur in to get an embedding
KNOWN_WORDS = 150_000
GATED = 1 << 14  # words whose n-grams are looked up at once
BLOCK = 1024
_TOKEN = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def word_inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket of each word; buckets of all character n-grams; where each word's begin."""
    ids = np.fromiter((zlib.crc32(w.encode()) % WORD_ROWS for w in words), np.int64, len(words))
    padded = [f"\x02{w}\x03" for w in words]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    code = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters from here to the word's end
    grams, owners = [], []
    h = np.full(len(code), 1469598103, np.uint64)
    for n in range(1, max(GRAMS) + 1):
        at = len(code) - n + 1
        if at <= 0:
            break
        h = h[:at] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
        if n in GRAMS:
            ok = left[:at] >= n
            x = h[ok] + np.uint64(n)
            grams.append(((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % CHAR_ROWS)
            owners.append(owner[:at][ok])
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids, grams[order], np.searchsorted(owners[order], np.arange(len(words)))


@dataclass
class Net:
    """Parameters; gates of both directions lie side by side as (z, r, n) x (forward, backward)."""

    word: np.ndarray
    char: np.ndarray
    wx: np.ndarray  # (WORD_DIM + CHAR_DIM, 6 H)
    wh: np.ndarray  # (2 H, 6 H), zero between the directions
    b: np.ndarray
    att: np.ndarray  # (2 H,)
    out: np.ndarray  # (2 H + 1,), the last is the bias
    fit: tuple[float, float, float] = (1.0, 0.0, 0.0)  # of the highest logit, log windows, 1

    @classmethod
    def fresh(cls, seed: int) -> Net:
        r, h, d = np.random.default_rng(seed), HIDDEN, WORD_DIM + CHAR_DIM
        f = lambda *s, k=1.0: (r.standard_normal(s) * k).astype(np.float32)
        return cls(np.zeros((WORD_ROWS, WORD_DIM), np.float32), np.zeros((CHAR_ROWS, CHAR_DIM), np.float32), f(d, 6 * h, k=0.4), f(2 * h, 6 * h, k=0.3) * cls.apart(), np.zeros(6 * h, np.float32), f(2 * h, k=0.1), f(2 * h + 1, k=0.3))

    @staticmethod
    def apart() -> np.ndarray:
        one = np.kron(np.eye(2), np.ones((HIDDEN, HIDDEN)))
        return np.tile(one, 3).astype(np.float32)

    def vectors(self, words: list[str]) -> np.ndarray:
        ids, grams, starts = word_inputs(words)
        n = np.diff(np.append(starts, len(grams)))
        chars = np.add.reduceat(self.char[grams], starts, axis=0) / n[:, None]
        return np.concatenate([self.word[ids], chars], axis=1)

    def gates(self, vectors: np.ndarray) -> np.ndarray:
        """Input part of the gates of distinct words: (2, n, 3 H), forward's and backward's."""
        both = (vectors @ self.wx + self.b).astype(np.float32).reshape(-1, 3, 2, HIDDEN)
        return np.ascontiguousarray(both.transpose(2, 0, 1, 3)).reshape(2, -1, 3 * HIDDEN)

    def run(self, table: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows: `index` (n, T) into `table` (2, words, 3 H), `mask` (n, T) 1 for words."""
        n, steps = index.shape
        h2, h = 2 * HIDDEN, HIDDEN
        state = np.zeros((n, h2), np.float32)
        states = np.empty((steps, n, h2), np.float32)
        ahead, back = table
        x = np.empty((n, 3, 2, h), np.float32)
        whole = mask.all()
        for t in range(steps):
            x[:, :, 0] = ahead[index[:, t]].reshape(n, 3, h)
            x[:, :, 1] = back[index[:, steps - 1 - t]].reshape(n, 3, h)
            flat = x.reshape(n, 6 * h)
            u = state @ self.wh
            zr = _sigmoid(flat[:, : 2 * h2] + u[:, : 2 * h2])
            z, r = zr[:, :h2], zr[:, h2:]
            new = np.tanh(flat[:, 2 * h2 :] + r * u[:, 2 * h2 :])
            if keep is not None:
                keep.append((state, z, r, new, u[:, 2 * h2 :]))
            state = new + z * (state - new)
            if not whole:
                state[:, :h] *= mask[:, t, None]
                state[:, h:] *= mask[:, steps - 1 - t, None]
            states[t, :, :h] = state[:, :h]
            states[steps - 1 - t, :, h:] = state[:, h:]
        score = (states @ self.att).T
        score = np.where(mask > 0, score, np.float32(-1e9))
        a = np.exp(score - score.max(1, keepdims=True)) * mask
        a /= np.maximum(a.sum(1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,tnh->nh", a, states)
        if keep is not None:
            keep.append((states, a, pooled))
        return pooled @ self.out[:-1] + self.out[-1]


def _windows(n: int, step: int) -> list[int]:
    """Starts of the windows that cover n words."""
    return list(range(0, max(1, n - WINDOW + step), step)) if n > WINDOW else [0]


def fit(windows: list[str], owner: np.ndarray, labels: np.ndarray, seed: int = 7, steps: tuple[int, ...] = (250, 120, 120, 120)) -> Net:
    """Train on windows (words joined by spaces) of documents `owner`, ascending, with `labels`."""
    net, rng = Net.fresh(seed), np.random.default_rng(seed)
    vocab = {"\x00": 0}  # row 0 stands where a window has no word
    index = np.zeros((len(windows), WINDOW), np.int64)
    mask = np.zeros((len(windows), WINDOW), np.float32)
    for i, w in enumerate(map(str.split, windows)):
        index[i, : len(w)] = [vocab.setdefault(x, len(vocab)) for x in w]
        mask[i, : len(w)] = 1
    words = list(vocab)
    ids, grams, starts = word_inputs(words)
    counts = np.diff(np.append(starts, len(grams)))
    names = ("word", "char", "wx", "wh", "b", "att", "out")
    live_word, live_char = _common(index, owner, ids, grams, starts, counts)
    moments = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in names}
    apart, h, h2, made = Net.apart(), HIDDEN, 2 * HIDDEN, 0
    toxic = labels[owner] > 0
    chosen = np.flatnonzero(toxic)
    clean = hard = np.flatnonzero(~toxic)
    for phase, n_steps in enumerate(steps):
        if phase:  # toxic documents by their highest windows, clean ones half by theirs where those look toxic
            logit = score_windows(net, gate_table(net, words), index, mask)
            best = np.full(len(labels), -np.inf)
            np.maximum.at(best, owner, logit)
            chosen = np.flatnonzero(toxic & (logit >= np.minimum(best[owner], 1.5)))
            hard = np.flatnonzero(~toxic & (logit >= np.maximum(best[owner], -2.0)))
        for _ in range(n_steps):
            pick = np.concatenate([rng.choice(chosen, 64), rng.choice(clean, 48), rng.choice(hard if len(hard) else clean, 48)])
            y = toxic[pick].astype(np.float32)
            m = mask[pick] * (rng.random((len(pick), WINDOW)) > 0.05)
            used, at = np.unique(index[pick], return_inverse=True)
            at = at.reshape(len(pick), WINDOW)
            span = np.concatenate([np.arange(starts[u], starts[u] + counts[u]) for u in used])
            g, gn = grams[span], counts[used]
            g0 = np.concatenate([[0], np.cumsum(gn)[:-1]])
            vec = np.concatenate([net.word[ids[used]], np.add.reduceat(net.char[g], g0, axis=0) / gn[:, None]], axis=1)
            kept: list = []
            logit = net.run(net.gates(vec), at, m.astype(np.float32), kept)
            states, a, pooled = kept.pop()
            # backward
            d = (1 / (1 + np.exp(-logit)) - y) / len(pick)
            grad = {"out": np.append(pooled.T @ d, d.sum())}
            dp = d[:, None] * net.out[:-1]
            ds = a.T[:, :, None] * dp[None]
            da = np.einsum("nh,tnh->nt", dp, states)
            da = a * (da - (a * da).sum(1, keepdims=True))
            ds += da.T[:, :, None] * net.att
            grad["att"] = np.einsum("nt,tnh->h", da, states)
            dstate = np.zeros((len(pick), h2), np.float32)
            dwh, dgate = np.zeros_like(net.wh), np.zeros((len(used), 6 * h), np.float32)
            flow = np.zeros((WINDOW, len(pick), 3, 2, h), np.float32)
            for t in range(WINDOW - 1, -1, -1):
                prev, z, r, new, un = kept[t]
                dstate[:, :h] += ds[t, :, :h]
                dstate[:, h:] += ds[WINDOW - 1 - t, :, h:]
                dstate[:, :h] *= m[:, t, None]
                dstate[:, h:] *= m[:, WINDOW - 1 - t, None]
                dn = dstate * (1 - z) * (1 - new * new)
                dz = dstate * (prev - new) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                dwh += prev.T @ du
                dstate = dstate * z + du @ net.wh.T
                flow[t] = np.concatenate([dz, dr, dn], axis=1).reshape(-1, 3, 2, h)
            ahead = flow[:, :, :, 0].transpose(1, 0, 2, 3)
            back = flow[::-1, :, :, 1].transpose(1, 0, 2, 3)
            both = np.stack([ahead, back], axis=3).reshape(-1, 6 * h)
            order = np.argsort(at.ravel(), kind="stable")
            first = np.searchsorted(at.ravel()[order], np.arange(len(used)))
            dgate = np.add.reduceat(both[order], first, axis=0)
            grad |= {"wh": dwh * apart, "b": dgate.sum(0), "wx": vec.T @ dgate}
            dvec = dgate @ net.wx.T
            grad["word"] = _scatter(ids[used], dvec[:, :WORD_DIM], WORD_ROWS) * live_word
            grad["char"] = _scatter(g, np.repeat(dvec[:, WORD_DIM:] / gn[:, None], gn, axis=0), CHAR_ROWS) * live_char
            made += 1
            for k in names:
                p, (m1, m2) = getattr(net, k), moments[k]
                gk = grad[k].astype(np.float32)
                m1 += 0.1 * (gk - m1)
                if k in ("word", "char"):
                    # one scale for all rows: buckets of rare words must not move as far as the common ones
                    m2 += 0.01 * (float((gk * gk).sum(1).max()) - m2)
                    p -= np.float32(0.1) * (m1 / (1 - 0.9**made)) / (np.sqrt(m2 / (1 - 0.99**made)) + np.float32(1e-9))
                    continue
                m2 += 0.01 * (gk * gk - m2)
                p -= np.float32(0.01) * (m1 / (1 - 0.9**made)) / (np.sqrt(m2 / (1 - 0.99**made)) + np.float32(1e-6))
    return net


def gate_table(net: Net, words: list[str]) -> np.ndarray:
    """The gate inputs of all words, some thousand at a time: a word's n-grams take far more room than its gates."""
    return np.concatenate([net.gates(net.vectors(words[i : i + GATED])) for i in range(0, len(words), GATED)], axis=1)


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.column_stack([np.bincount(rows, v, n) for v in values.T]).astype(np.float32)


def _common(index: np.ndarray, owner: np.ndarray, ids: np.ndarray, grams: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """1 for the word and n-gram buckets that occur in at least MIN_DOCS documents, as columns."""
    n_word, n_char = np.zeros(WORD_ROWS, np.int64), np.zeros(CHAR_ROWS, np.int64)
    for i in range(0, len(index), 2048):  # owners ascend: cut where one ends, to count each document once
        a, b = (np.searchsorted(owner, owner[j]) if j < len(owner) else len(owner) for j in (i, i + 2048))
        seen = np.unique(np.stack([np.repeat(owner[a:b], index.shape[1]), index[a:b].ravel()]), axis=1)
        size = counts[seen[1]]
        chars = grams[np.repeat(starts[seen[1]] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        for docs, buckets, total in ((seen[0], ids[seen[1]], n_word), (np.repeat(seen[0], size), chars, n_char)):
            total += np.bincount(np.unique(docs * np.int64(len(total)) + buckets) % len(total), minlength=len(total))
    return tuple((x >= MIN_DOCS).astype(np.float32)[:, None] for x in (n_word, n_char))


def score_windows(net: Net, table: np.ndarray, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([net.run(table, index[i : i + BLOCK], mask[i : i + BLOCK]) for i in range(0, len(index), BLOCK)])


class Scorer:
    """Scores whole texts; keeps the gate inputs of the words met so far, up to KNOWN_WORDS."""

    def __init__(self, net: Net):
        self.net = net
        self.known: dict[str, int] = {}
        self.table = np.empty((2, 1 << 12, 3 * HIDDEN), np.float32)

    def _rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known, fresh = self.known, []
        for words in texts:
            for w in words:
                if w not in known:
                    known[w] = len(known)
                    fresh.append(w)
        room = self.table.shape[1]
        if len(known) > room:
            more = np.empty((2, max(len(known), 2 * room), 3 * HIDDEN), np.float32)
            more[:, :room] = self.table
            self.table = more
        at = len(known) - len(fresh)
        for i in range(0, len(fresh), 1 << 15):
            some = fresh[i : i + (1 << 15)]
            self.table[:, at + i : at + i + len(some)] = self.net.gates(self.net.vectors(some))
        return [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in texts]

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Highest window logit and number of windows of each text."""
        if not texts:
            return np.empty(0), np.empty(0, np.int64)
        rows = self._rows([words_of(t) for t in texts])
        starts = [_windows(len(r), WINDOW // 2) for r in rows]
        n = np.fromiter(map(len, starts), np.int64, len(rows))
        best = np.full(len(rows), -np.inf)
        flat = np.concatenate([*rows, np.zeros(WINDOW, np.int64)])
        base = np.cumsum([0, *map(len, rows)])
        owner = np.repeat(np.arange(len(rows)), n)
        first = np.concatenate([np.asarray(s) + b for s, b in zip(starts, base)])
        size = np.minimum(base[1:][owner] - first, WINDOW)
        for i in range(0, len(first), 16 * BLOCK):
            part = slice(i, i + 16 * BLOCK)
            mask = (np.arange(WINDOW) < size[part, None]).astype(np.float32)
            index = np.where(mask > 0, flat[np.minimum(first[part, None] + np.arange(WINDOW), len(flat) - 1)], 0)
            # full windows first, so that only the last blocks pay for masks
            order = np.argsort(-size[part], kind="stable")
            np.maximum.at(best, owner[part][order], score_windows(self.net, self.table, index[order], mask[order]))
        return best, n


_scorers: dict[str, Scorer] = {}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _scored(docs: DataFrame, net: Net, logit: str = "__logit", windows: str = "__windows") -> DataFrame:
    """docs with the highest logit and the number of windows; the network (under 3 MB) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    token = uuid.uuid4().hex
    kinds = dict(docs.dtypes)

    def rows(part: dict) -> dict:
        scorer = _scorers.get(token)
        if scorer is None:
            _scorers.clear()
            scorer = _scorers[token] = Scorer(shared.value)
        best, n = scorer.logits(part["text"])
        return part | {logit: best, windows: n}

    return in_arrow(docs, rows, ", ".join(f"`{c}` {kinds[c]}" for c in docs.columns) + f", `{logit}` double, `{windows}` long")


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_windows: int = MAX_WINDOWS) -> tuple[Net | None, float]:
    """A calibrated network from the rows that are not held out, and the rate of label 1."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    ones, every = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    rate = ones / every if every else 0.0
    if not 0 < ones < every:
        return None, rate
    pick = lambda y: known.where(F.col("toxic") == y).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_docs)
    sample = F.broadcast(pick(0).union(pick(1)))  # at most 2 * max_docs rows of two numbers
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id")
    text = text.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # of rows that repeat an id one

    def cut(part: dict) -> dict:
        out = []
        for i, text in zip(part["doc_id"], part["text"]):
            words = words_of(text)
            starts = _windows(len(words), WINDOW)
            out.append([" ".join(words[s : s + WINDOW]) for s in starts])
        return {"doc_id": part["doc_id"], "toxic": part["toxic"], "w": out}

    windows = stage(in_arrow(text, cut, "doc_id long, toxic int, w array<string>"), "toxic-windows")
    order = F.md5(F.col("doc_id").cast("string"))
    sizes = sorted(map(tuple, windows.select(order.alias("h"), "doc_id", "toxic", F.size("w").alias("n")).collect()))  # at most 2 * max_docs rows of numbers
    taken, held = [], {0: 0, 1: 0}
    for _, doc_id, toxic, n in sizes:
        if n <= max_windows // 8 and held[toxic] + n <= max_windows:
            held[toxic] += n
            taken.append(doc_id)
    if len(taken) < len(sizes):
        windows = windows.where(F.col("doc_id").isin(taken))
        text = text.where(F.col("doc_id").isin(taken))
    got = windows.collect()
    got.sort(key=lambda r: (r["doc_id"], r["w"]))
    y = np.array([r["toxic"] for r in got])
    if not len(y) or y.min() == y.max():
        return None, rate
    owner, own = np.repeat(np.arange(len(got)), [len(r["w"]) for r in got]), [w for r in got for w in r["w"]]
    del got
    with np.errstate(over="ignore"):
        net = fit(own, owner, y)
    net.fit = _calibrate(*np.array(_scored(text, net).select("__logit", "__windows", "toxic").orderBy("doc_id").collect(), float).T, rate)
    return net, rate


def _calibrate(logit: np.ndarray, windows: np.ndarray, y: np.ndarray, rate: float) -> tuple[float, float, float]:
    """Logistic regression on (logit, log windows, 1), classes weighted to the rate; Newton steps."""
    x = np.column_stack([logit, np.log(windows), np.ones(len(y))])
    w = np.where(y > 0, rate / max(y.mean(), 1e-9), (1 - rate) / max(1 - y.mean(), 1e-9))
    prior = np.array([1.0, 0.0, 0.0])
    stiff = np.array([1.0, 4.0, 0.1])

    def loss(v: np.ndarray) -> float:
        return float((w * (np.logaddexp(0, x @ v) - y * (x @ v))).sum() + (stiff * (v - prior) ** 2).sum() / 2)

    beta = prior
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + stiff * (beta - prior)
        step = np.linalg.solve((x.T * (w * p * (1 - p))) @ x + np.diag(stiff), grad)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
    return tuple(float(b) for b in beta)


def score(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, name: str = "toxicity") -> DataFrame:
    """`docs` (all columns) with `name`, a probability; trained on labels of `train_docs`."""
    net, rate = train(docs if train_docs is None else train_docs, labels)
    if net is None:
        return docs.withColumn(name, F.lit(float(rate)))
    a, b, c = net.fit
    docs = docs.drop(name)
    logit, windows = unused(docs, "logit", "windows")
    x = F.lit(a) * F.col(logit) + F.lit(b) * F.log(windows) + F.lit(c)
    return _scored(docs, net, logit, windows).select(*[F.col(f"`{k}`") for k in docs.columns], (1 / (1 + F.exp(-x))).alias(name))
