"""Byte-level BPE: encoding by merge replay per run of texts, and decoding.

A batch of documents is cut into pieces by the vocabulary's pattern and every
distinct piece is encoded once.  The batch's pieces form one run of symbols with
neighbour links; an inverted index holds, for every pair that a merge joins, the
positions where it stands.  Merges are taken in rank order, lowest first, each at
all its positions; only the two touched neighbours of a position are looked at
again.  Where a merge brings about a pair of no higher rank in the same piece, the
rest of that piece's positions wait for it, so the result is that of merging each
piece's lowest-ranked, leftmost pair until none is left.

Documents stay in their tasks: nothing is shuffled.  A task holds one batch of
documents and a table of pieces of bounded size.

Defined cases: a null text is encoded as the empty text, which has no ids; other
columns, repeated rows and empty tables pass through.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellum.llm.common import with_made

# Symbols in one replay and pieces remembered by a task: bounds of memory, not of input.
REPLAY_SYMBOLS = 200_000
REMEMBERED = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder for one rank table and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)])
        # Every pair of tokens that makes up a token: first << 32 | second -> its rank.
        self.joined = {ranks[b[:i]] << 32 | ranks[b[i:]]: r for b, r in ranks.items()
                       for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks}
        self.first = np.full(1 << 16, -1)
        for i in range(1 << 16):
            self.first[i] = ranks.get(bytes([i >> 8, i & 255]), -1)
        self.known: dict[str, bytes] = {}

    def _index(self, raw: np.ndarray, last: np.ndarray) -> dict[int, list[int]]:
        """Rank -> positions of the pairs of neighbouring bytes that it joins."""
        rank = np.append(self.first[raw[:-1].astype(int) << 8 | raw[1:]], -1)
        rank[last] = -1
        places = np.flatnonzero(rank >= 0)
        places = places[np.argsort(rank[places], kind="stable")]
        found, begins = np.unique(rank[places], return_index=True)
        cut = [*begins.tolist(), len(places)]
        places = places.tolist()
        return {r: places[cut[k]:cut[k + 1]] for k, r in enumerate(found.tolist())}

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece, all merges replayed over all pieces together."""
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n = len(raw)
        index = self._index(raw, ends - 1)
        # A neighbour of -1 is the end of the piece; sym holds -1 where a symbol went into its left one.
        sym, nxt, prv = self.single[raw], np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1] = -1
        prv[ends - sizes] = -1
        sym, nxt, prv, bounds = sym.tolist(), nxt.tolist(), prv.tolist(), ends.tolist()
        joined = self.joined.get
        order = sorted(index)
        while order:
            r = heappop(order)
            places = index.pop(r)
            places.sort()
            at = 0
            while at < len(places):
                i = places[at]
                at += 1
                j = nxt[i]
                if j < 0 or sym[i] < 0 or joined(sym[i] << 32 | sym[j]) != r:
                    continue  # a merge since then took one of the two
                sym[i], sym[j] = r, -1
                h, k = prv[i], nxt[j]
                nxt[i] = k
                wait = False
                if h >= 0:
                    q = joined(sym[h] << 32 | r)
                    if q is not None:
                        wait = q <= r
                        if q in index:
                            index[q].append(h)
                        else:
                            index[q] = [h]
                            heappush(order, q)
                if k >= 0:
                    prv[k] = i
                    q = joined(r << 32 | sym[k])
                    if q is not None:
                        wait |= q <= r
                        if q in index:
                            index[q].append(i)
                        else:
                            index[q] = [i]
                            heappush(order, q)
                if wait:
                    end = bounds[bisect_right(bounds, i)]
                    rest = at
                    while rest < len(places) and places[rest] < end:
                        rest += 1
                    if rest > at:
                        if r not in index:
                            index[r] = []
                            heappush(order, r)
                        index[r] += places[at:rest]
                        at = rest
        sym = np.array(sym)
        packed = sym[sym >= 0].astype("<u4").tobytes()
        cut = [0, *(4 * np.cumsum(sym >= 0)[ends - 1]).tolist()]
        return [packed[a:b] for a, b in zip(cut, cut[1:])]

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode the pieces that aren't remembered yet."""
        ranks, known = self.ranks, self.known
        names, raws, held = [], [], 0
        for text in pieces:
            raw = text.encode("utf-8", "surrogatepass")
            whole = ranks.get(raw)
            if whole is not None:
                known[text] = whole.to_bytes(4, "little")
                continue
            names.append(text)
            raws.append(raw)
            held += len(raw)
            if held >= REPLAY_SYMBOLS:
                known.update(zip(names, self.replay(raws)))
                names, raws, held = [], [], 0
        if raws:
            known.update(zip(names, self.replay(raws)))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > self.remembered:
            self.known.clear()
        cut = [self.split(t) for t in texts]
        known = self.known
        self.learn({p for pieces in cut for p in pieces if p not in known})
        get = known.__getitem__
        for pieces in cut:
            yield b"".join(map(get, pieces))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def _codec(tokens: bytes, pattern: str, remembered: int) -> Codec:
    return Codec({base64.b64decode(a): int(b) for a, b in (x.split() for x in tokens.splitlines())}, pattern, remembered)


def encode(docs: DataFrame, tokens: bytes, pattern: str, text: str = "text", *, ids: str | None = None,
           n_tokens: str | None = None, ids_sha256: str | None = None, decoded_sha256: str | None = None,
           remembered: int = REMEMBERED) -> DataFrame:
    """``docs`` without ``text`` and with those of the four columns that get a
    name: the ids (array of int), their number, and the digests of the packed ids and of
    the bytes they decode to.  ``tokens`` is the rank file's content, of fixed size;
    ``remembered`` is how many pieces a task may remember, about 200 bytes each.
    """
    kinds = ((ids, T.ArrayType(T.IntegerType())), (n_tokens, T.LongType()), (ids_sha256, T.StringType()),
             (decoded_sha256, T.StringType()))
    added = T.StructType([T.StructField(name, kind) for name, kind in kinds if name])
    held = docs.sparkSession.sparkContext.broadcast(tokens)

    def make(texts: list[str | None]) -> list[list]:
        codec = _codec(held.value, pattern, remembered)
        packed = list(codec.encode([t or "" for t in texts]))
        made = []
        if ids:
            made.append([np.frombuffer(p, dtype="<u4").astype("int32") for p in packed])
        if n_tokens:
            made.append([len(p) // 4 for p in packed])
        if ids_sha256:
            made.append([hashlib.sha256(p).hexdigest() for p in packed])
        if decoded_sha256:
            made.append([hashlib.sha256(codec.decode(p)).hexdigest() for p in packed])
        return made

    return with_made(docs, text, added, make)
