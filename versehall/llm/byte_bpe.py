"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end its encoding: the one
that fits the encoding of the prefix before it. Storing that last token per prefix makes appending
exact (continue the table) and an edit local (keep the table up to the edit, rebuild from there).

Defined cases: null text is the empty text (no tokens, digests of nothing); very long texts are
cut into pieces as a stream; repeated rows give repeated results; an empty table an empty result;
columns to keep pass untouched whatever their names, but one that has the name of a result is refused.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versehall.llm.common import in_arrow, unused

CACHED_PIECES = 450_000
CACHED_PAIRS = 400_000
STREAM_OVER = 1 << 20  # characters; longer texts are cut into pieces lazily
STREAM_STEP = 1 << 16  # pieces held at once for such texts


def parse_ranks(lines: Iterable[str]) -> dict[bytes, int]:
    """Ranks from lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PrefixCoder:
    """Encoder, decoder and incremental tables for one vocabulary and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.size_of = {i: len(t) for t, i in ranks.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.split = regex.compile(pattern)
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._left: dict[int, tuple[tuple[int, int], ...]] = {}
        self._right: dict[int, tuple[tuple[int, int], ...]] = {}
        self.never = max(ranks.values()) + 1
        #: tokens that merging their own bytes gives; the others only occur as whole pieces
        self.usable = {t: i for t, i in ranks.items() if len(t) == 1 or len(self._merge(t)) == 1}

    # -- validity, straight from the definition of the merges --------------------------------

    def _merge(self, data: bytes) -> list[bytes]:
        """Reference merges of a short byte string: lowest rank first, leftmost on ties."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, token: int, right: bool) -> tuple[tuple[int, int], ...]:
        """The token's edge parts from the token down to a byte, each with the rank of the merge
        that uses it up (for the token itself: none)."""
        cache = self._right if right else self._left
        known = cache.get(token)
        if known is None:
            data = self.bytes_of[token]
            known = ((token, self.never),)
            if len(data) > 1:
                cut = self._cut(data)
                part = self.ranks[data[cut:] if right else data[:cut]]
                known += ((part, token), *self._spine(part, right)[1:])
            cache[token] = known
        return known

    def _cut(self, data: bytes) -> int:
        """Where the last merge of a token's bytes joins its two parts."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            r, i = min((self.ranks.get(parts[i] + parts[i + 1], self.never), i) for i in range(len(parts) - 1))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return len(parts[0])

    def _fits(self, left: int, right: int) -> bool:
        """Whether `left` followed by `right` is the encoding of their joined bytes.

        Merges run in order of rank. An edge part x of the left token and an edge part y of the
        right one stand side by side from the later of their own ranks until one is used up; they
        would merge across the border if the rank of xy comes before that (on a tie the merge
        further left goes first)."""
        a, b = self._spine(left, True), self._spine(right, False)
        bytes_of, get = self.bytes_of, self.ranks.get
        i, j = len(a) - 1, len(b) - 1
        while True:
            (x, x_end), (y, y_end) = a[i], b[j]
            r = get(bytes_of[x] + bytes_of[y])
            if r is not None and r < x_end and r <= y_end:
                return False
            if not i and not j:
                return True
            if x_end <= y_end and i:
                i -= 1
            else:
                j -= 1

    # -- the table of last tokens -------------------------------------------------------------

    def extend(self, data: bytes, last: list[int], start: int = 0) -> list[int]:
        """Fill `last` (last[i]: the only valid last token of data[:i + 1]) from `start` on.

        Just one token fits, so the order of trying is free: where the prefix before began its
        last token, then later places, then earlier ones."""
        del last[start:]
        get, pairs, size = self.usable.get, self._pairs, self.size_of
        at = start - size[last[-1]] if last else 0
        for end in range(start + 1, len(data) + 1):
            begin, low = at, at - 1
            while True:
                token = get(data[begin:end])
                if token is not None:
                    if not begin:
                        break
                    pair = (last[begin - 1], token)
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) >= CACHED_PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = self._fits(*pair)
                    if fits:
                        break
                if at <= begin < end - 1:
                    begin += 1
                elif low >= 0:
                    begin, low = low, low - 1
                else:
                    raise ValueError(f"the vocabulary does not cover byte {data[end - 1]!r}")
            last.append(token)
            at = begin
        return last

    def unwind(self, last: list[int]) -> list[int]:
        """Token ids along the table, back from its end."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= self.size_of[last[at - 1]]
        return out[::-1]

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one match of the pattern; a piece that is itself a token stays whole."""
        ids = self._pieces.get(piece)
        if ids is None:
            data = piece.encode()
            whole = self.ranks.get(data)
            ids = (whole,) if whole is not None else tuple(self.unwind(self.extend(data, [])))
            if len(self._pieces) >= CACHED_PIECES:
                self._pieces.clear()
            self._pieces[piece] = ids
        return ids

    # -- texts --------------------------------------------------------------------------------

    def parts(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, all at once or, for a very long one, as a stream."""
        if len(text) <= STREAM_OVER:
            yield self.split.findall(text)
            return
        found = (m.group() for m in self.split.finditer(text))
        while some := list(itertools.islice(found, STREAM_STEP)):
            yield some

    def ids(self, pieces: list[str]) -> list[int]:
        known, one = self._pieces, self.piece
        return list(itertools.chain.from_iterable([known.get(p) or one(p) for p in pieces]))

    def encode(self, text: str) -> list[int]:
        return [i for some in self.parts(text) for i in self.ids(some)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Draft:
    """A text under edit with its tokens. Every piece keeps its table of last tokens: a piece that grows
    goes on with it, and one that is edited keeps it up to the first byte that changed.

    The split is resumed some pieces before the edit: a match is taken to be settled by its own
    characters, the white space behind it and LOOK more, which holds for the patterns of the public
    byte-level vocabularies. A pattern that looks back or further ahead is refused where that can be
    seen in it."""

    LOOK = 8

    def __init__(self, coder: PrefixCoder, text: str = ""):
        if re.search(r"\(\?<[=!]|\(\?=.*[+*]", coder.split.pattern):
            raise ValueError("a draft needs a pattern without lookbehind or unbounded lookahead")
        self.coder, self.text = coder, text
        self.pieces = [m.group() for m in coder.split.finditer(text)]
        self.starts = np.cumsum([0, *map(len, self.pieces)])[:-1]
        self.tables = [coder.extend(p.encode(), []) for p in self.pieces]
        self.filled = sum(map(len, self.tables))  # table entries that the last change worked out

    @property
    def ids(self) -> list[int]:
        return [i for p, t in zip(self.pieces, self.tables) for i in self._tokens(p, t)]

    def _tokens(self, piece: str, table: list[int]) -> list[int]:
        whole = self.coder.ranks.get(piece.encode())
        return self.coder.unwind(table) if whole is None else [whole]

    def append(self, more: str) -> int:
        """Add to the end; gives the number of pieces encoded anew."""
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace text[start:end]; pieces before the edit and those from where the split falls into
        step with the old one again stay as they are. Gives the number of pieces encoded anew."""
        old, shift = self.text, len(new) - (end - start)
        k = max(0, int(np.searchsorted(self.starts, start, "right")) - 1)
        while k and (self.starts[k] > start - self.LOOK or old[self.starts[k] : start].isspace()):
            k -= 1
        self.text = old[:start] + new + old[end:]
        j = int(np.searchsorted(self.starts, end))  # old pieces from the edit's end on
        pieces, tables, fresh, i, self.filled = [], [], 0, k, 0
        at = int(self.starts[k]) if len(self.starts) else 0
        for m in self.coder.split.finditer(self.text, at):
            while j < len(self.starts) and self.starts[j] + shift < m.start():
                j += 1
            if j < len(self.starts) and self.starts[j] + shift == m.start() >= start + len(new):
                break
            while i < len(self.starts) and self.starts[i] < m.start():
                i += 1
            known = i < len(self.starts) and self.starts[i] == m.start() <= start
            piece, table = m.group(), self.tables[i] if known else []
            if not known or piece != self.pieces[i]:
                data, was = piece.encode(), self.pieces[i].encode() if known else b""
                same = next((n for n, (x, y) in enumerate(zip(data, was)) if x != y), min(len(data), len(was)))
                table = self.coder.extend(data, table[:same], same)
                self.filled += len(data) - same
                fresh += 1
            pieces.append(piece)
            tables.append(table)
        else:
            j = len(self.starts)
        # moves of memory only: nothing behind the edit is looked at
        self.starts = np.concatenate([self.starts[:k], at + np.cumsum([0, *map(len, pieces)])[:-1], self.starts[j:] + shift]).astype(np.int64)
        self.pieces[k:j], self.tables[k:j] = pieces, tables
        return fresh


_coders: dict[tuple[int, str], PrefixCoder] = {}


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, keep_ids: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode and decode the whole `text` of every row: the kept columns, n_tokens, ids_sha256 (of
    the decimal ids joined by commas), decoded_sha256, with `keep_ids` also ids array<int>.

    The vocabulary file is read on the driver and broadcast (its size is fixed); each Python worker
    builds its tables once. Narrow: no shuffle."""
    made = {"n_tokens", "ids_sha256", "decoded_sha256"} | ({"ids"} if keep_ids else set())
    if made & {k.lower() for k in keep}:
        raise ValueError(f"columns to keep may not be named {sorted(made)}")
    text_ = unused(docs, "__text")[0]
    with open(rank_path, encoding="ascii") as f:
        shared = docs.sparkSession.sparkContext.broadcast(parse_ranks(f))
    token = (hash(rank_path), pattern)

    def rows(part: dict) -> dict:
        coder = _coders.get(token)
        if coder is None:
            coder = _coders[token] = PrefixCoder(shared.value, pattern)
        out: dict = {k: part[k] for k in keep} | {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        if keep_ids:
            out["ids"] = []
        for text in part[text_]:
            n, named, decoded, every = 0, hashlib.sha256(), hashlib.sha256(), []
            for pieces in coder.parts(text or ""):
                ids = coder.ids(pieces)
                named.update(("," * bool(n and ids) + ",".join(map(coder.text_of.__getitem__, ids))).encode())
                decoded.update(coder.decode(ids))
                n += len(ids)
                if keep_ids:
                    every += ids
            out["n_tokens"].append(n)
            out["ids_sha256"].append(named.hexdigest())
            out["decoded_sha256"].append(decoded.hexdigest())
            if keep_ids:
                out["ids"].append(every)
        return out

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["n_tokens long, ids_sha256 string, decoded_sha256 string"] + ["ids array<int>"] * keep_ids)
    return in_arrow(docs.select(*keep, F.col("text").alias(text_)), rows, schema)
