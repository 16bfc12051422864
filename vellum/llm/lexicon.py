"""Chunks of texts, and a table of chunks that a task has met.

A chunk boundary is a space after a character that isn't white space.  No token of
the vocabularies used here reaches over one: byte-level pieces hold a space only
at their start or within white space, sentence pieces likewise.  So a text's
tokens are its chunks' tokens in a row, and each distinct chunk has to be
tokenised once per task, not once per place.  A chunk is named without the
space that begins it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

# White space of any library in use: a space after one of these is no boundary.
BLANK = "\x01-\x20\x85\xA0\u1680\u180E\u2000-\u200B\u2028\u2029\u202F\u205F\u3000\uFEFF"
_ODD = f"(^|[{BLANK}]) "
_SPLIT = regex.compile(f"(?<=[^{BLANK}]) ").split

# Chunks and pieces of chunks a task remembers: bounds of memory, not of input.
REMEMBERED = 600_000
REMEMBERED_PIECES = 100_000


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every (start, length), in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct chunks, the code of each chunk of the texts in a row, number of
    chunks of each text); a null text has none, an empty one an empty chunk."""
    # a slice's rows are copied: the split doesn't respect its offset
    texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    odd = pc.fill_null(pc.match_substring_regex(texts, _ODD), False)
    rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    plain = pc.split_pattern(pc.if_else(odd, pa.scalar(None, pa.large_string()), texts), " ")
    starts, lengths = plain.offsets.to_numpy()[:-1].astype(np.int64), np.diff(plain.offsets.to_numpy()).astype(np.int64)
    values = plain.values
    if len(rows):
        cut = [_SPLIT(t) for t in texts.take(pa.array(rows)).to_pylist()]
        sizes = np.array([len(c) for c in cut], dtype=np.int64)
        lengths[rows] = sizes
        starts[rows] = len(values) + np.cumsum(sizes) - sizes
        values = pa.concat_arrays([values, pa.array([w for c in cut for w in c], type=pa.large_string())])
    coded = values.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)[ragged(starts, lengths)], lengths


def first_chunks(texts: list[str]) -> tuple[list[str], list[str | None]]:
    """Each text's first chunk, and what follows its boundary (None: nothing does)."""
    cut = [_SPLIT(t, maxsplit=1) for t in texts]
    return [c[0] for c in cut], [c[1] if len(c) > 1 else None for c in cut]


class Lexicon:
    """What ``make`` gives for chunks, remembered by two hashes of the chunk (96 bits): arrays
    (one value a chunk), pairs (values in a row, number of values by chunk) and lists (one item a chunk)."""

    def __init__(self, make: Callable[[list[str]], dict], remembered: int = REMEMBERED):
        self.make, self.remembered = make, remembered
        self._clear()

    def _clear(self) -> None:
        self.first, self.second = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32)  # sorted by the first
        self.code = np.zeros(0, dtype=np.int32)
        self.n = 0
        self.fixed: dict[str, np.ndarray] = {}
        self.rows: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.lists: dict[str, list] = {}

    def codes(self, words: pa.Array) -> np.ndarray:
        """The number of each of the (distinct) words in this table."""
        words = words.to_numpy(zero_copy_only=False)
        if not len(words):
            return np.zeros(0, dtype=np.int64)
        one = pd.util.hash_array(words, hash_key="chunks of a text", categorize=False)
        two = pd.util.hash_array(words, hash_key="texts into chunk", categorize=False).astype(np.uint32)
        out, known = self._find(one, two)
        new = np.flatnonzero(~known)
        if self.n + len(new) > self.remembered:
            self._clear()
            out, known = self._find(one, two)
            new = np.flatnonzero(~known)
        if len(new):
            out[new] = np.arange(self.n, self.n + len(new))
            self._learn(words[new].tolist())
            # words whose first hash somebody has already are made anew whenever they come
            order = new[np.unique(one[new], return_index=True)[1]]
            at = np.searchsorted(self.first, one[order])
            free = at == np.searchsorted(self.first, one[order], "right")
            order, at = order[free], at[free]
            self.first, self.second = np.insert(self.first, at, one[order]), np.insert(self.second, at, two[order])
            self.code = np.insert(self.code, at, out[order].astype(np.int32))
            self.n += len(new)
        return out

    def _find(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.first):
            return np.zeros(len(one), dtype=np.int64), np.zeros(len(one), dtype=bool)
        at = np.minimum(np.searchsorted(self.first, one), len(self.first) - 1)
        return self.code[at].astype(np.int64), (self.first[at] == one) & (self.second[at] == two)

    def _learn(self, words: list[str]) -> None:
        for name, made in self.make(words).items():
            if isinstance(made, list):
                self.lists.setdefault(name, []).extend(made)
            elif isinstance(made, tuple):
                flat, sizes = made[0], made[1].astype(np.int32)
                held = self.rows.get(name)
                starts = np.cumsum(sizes) - sizes + (len(held[0]) if held else 0)
                if held:
                    flat, starts, sizes = (np.concatenate(x) for x in zip(held, (flat, starts, sizes)))
                self.rows[name] = (flat, starts, sizes)
            else:
                self.fixed[name] = np.concatenate([self.fixed[name], made]) if name in self.fixed else made

    def row_values(self, name: str, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values in a row, number of values) of the chunks with these numbers."""
        if name not in self.rows:
            return np.zeros(0, dtype=np.int64), np.zeros(len(codes), dtype=np.int64)
        flat, starts, sizes = self.rows[name]
        sizes = sizes[codes].astype(np.int64)
        return flat[ragged(starts[codes], sizes)], sizes


# The printable characters that stand for bytes in a byte-level vocabulary: those of
# Latin-1 that print stand for themselves, the others follow from 256 on.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_characters() -> list[str]:
    """The character that stands for each byte."""
    others = iter(range(256, 512))
    prints = set(_PRINTS)
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class ByteBpe:
    """The tokenizers library's encoder of one byte-level vocabulary, chunk by chunk.

    Chunks of Latin letters, digits and signs are cut by the vocabulary's pattern and
    each piece goes through the library's BPE model; all others, and those that
    may hold a special token, go through the library as they are."""

    def __init__(self, content: str, pattern: str, special: bool):
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = not special
        self.tokenize = self.tokenizer.model.tokenize
        characters = byte_characters()
        self.table = dict(enumerate(characters))
        self.split = regex.compile(pattern).findall
        added = [t["content"] for t in json.loads(content)["added_tokens"]] if special else []
        self.added = re.compile("|".join(map(re.escape, added))).search if added else None
        byte_of = {c: b for b, c in enumerate(characters)}
        size = self.tokenizer.get_vocab_size()
        tokens = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.bytes_of = [bytes(map(byte_of.__getitem__, t)) if all(c in byte_of for c in t) else t.encode() for t in tokens]
        self.pieces: dict[str, list[int]] = {}

    def _piece(self, piece: str) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.table))]
            if len(self.pieces) >= REMEMBERED_PIECES:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if max(text) >= "ɐ" or self.added and self.added(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if text[text[0] == " ":].isalpha():  # one piece
            return self._piece(text)
        pieces = self.split(text)
        return self._piece(text) if len(pieces) == 1 else [i for p in pieces for i in self._piece(p)]
