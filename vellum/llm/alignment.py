"""Alignment of two tokenizers over a corpus, by deduplication of exact texts.

1. Texts are shuffled whole and counted, so each distinct text is tokenised and
   aligned once, by a byte-level BPE (A, of space + text) and a sentence-piece
   model (B, which adds the space itself).
2. A task works on runs of texts.  Each of a run's distinct chunks (see
   ``lexicon``) is aligned once: offsets where tokens of both end cut groups;
   every stretch between two neighbouring ends of either is one link, an A token
   and a B token whose byte ranges overlap.  The run keeps its texts as chunk
   numbers, its chunks as links, and the number of documents by linked pair:
   distinct pairs of each text, weighted by how many documents have that text.
3. Runs' numbers are added up over the corpus, and the highest of each A id found.
4. Corpus counts go back to the runs that hold a pair, are added up per chunk and
   then per text, and the texts' measures are joined to the ids by the text's hash.

A pair is shuffled once a run, not once a document.  A text that a third of all rows
hold is one row after the map-side combine of step 1, and is broadcast in the
join of step 4 (``with_group``: fewer than a thousand such texts).

Defined cases: null and empty texts, and texts that a tokenizer doesn't give back
byte by byte, have no tokens: all measures 0 and an empty ``groups_sha256``.
Rows are never merged: repeated ids and null ids keep a row each.  A text longer
than a run is a run of its own.  Other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import runs, saved, with_group
from vellum.llm.lexicon import ByteBpe, Lexicon, chunks, ragged
from vellum.session import ship_code

RUN_BYTES = 1 << 22
# Chunks a task remembers, about 250 bytes each: a bound of memory, not of input.
REMEMBERED = 350_000
# A pair is A's id times this plus B's id.
B_IDS = 1 << 16

MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_RUNS = ("run long, sha binary, n_docs long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, words binary, "
         "links binary, sizes binary, pairs array<long>, weights array<long>")


class Pair:
    """Both tokenizers, and the alignment of chunks."""

    def __init__(self, byte_level: str, pattern: str, pieces: bytes):
        self.a = ByteBpe(byte_level, pattern, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.space = self.b.piece_to_id("▁")
        self.a_sizes = np.array([len(x) for x in self.a.bytes_of])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        # "id,", "id|" and "id;" of every id
        self.names = np.array([f"{i}{c}" for i in range(max(len(self.a_sizes), len(names))) for c in ",|;"], dtype=object)
        if max(len(self.a_sizes), len(names)) > B_IDS:
            raise ValueError(f"vocabularies of more than {B_IDS} ids don't fit into the 32 bits of a pair")
        self.lexicon = Lexicon(self.align, REMEMBERED)

    def align(self, words: list[str]) -> dict:
        """Counts, links and group strings of chunks."""
        whole = [" " + w for w in words]
        a = [self.a.encode(w) for w in whole]
        b = self.b.encode(words, num_threads=1)
        for i, w in enumerate(words):
            if not w:
                b[i] = [self.space]
        expected = [w.encode() for w in whole]
        good = np.array([b"".join([self.a.bytes_of[t] for t in x]) == e and b"".join([self.b_bytes[t] for t in y]) == e
                         for x, y, e in zip(a, b, expected)], dtype=bool)
        n_a, n_b = (np.array([len(x) if g else 0 for x, g in zip(side, good)], dtype=np.int64) for side in (a, b))
        ids_a, ids_b = (np.array([t for x, g in zip(side, good) if g for t in x], dtype=np.int64) for side in (a, b))
        ends_a, ends_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        ends = np.union1d(ends_a, ends_b)
        common = ends_a[np.isin(ends_a, ends_b, assume_unique=True)]
        word_ends = np.cumsum([len(e) if g else 0 for e, g in zip(expected, good)])
        at = lambda x: np.diff(np.searchsorted(x, word_ends, "right"), prepend=0)
        links = ids_a[np.searchsorted(ends_a, ends)] * B_IDS + ids_b[np.searchsorted(ends_b, ends)]
        return {"good": good, "n_a": n_a, "n_b": n_b, "n_groups": at(common), "links": (links.astype(np.uint32), at(ends)),
                "groups": self._groups(ids_a, ids_b, ends_a, ends_b, common, n_a + n_b)}

    def _groups(self, ids_a, ids_b, ends_a, ends_b, common, sizes) -> list[str]:
        """Each chunk's groups as text: A ids, a bar, B ids; groups apart by semicolons."""
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        place_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, "left")
        place_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
        last_a, last_b = np.isin(ends_a, common), np.isin(ends_b, common)
        named = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        named[place_a] = ids_a * 3 + last_a
        named[place_b] = ids_b * 3 + 2 * last_b
        parts = self.names[named].tolist()
        cut = np.cumsum(sizes).tolist()
        return ["".join(parts[i:j])[:-1] for i, j in zip([0, *cut], cut)]


@lru_cache(maxsize=1)
def _pair(byte_level: str, pattern: str, pieces: bytes) -> Pair:
    return Pair(byte_level, pattern, pieces)


def _measured(pair: Pair, texts: pa.Array, docs: np.ndarray, run: int) -> pa.RecordBatch:
    """A run's rows: one for each text, and one for the run."""
    words, at, lengths = chunks(texts)
    codes = pair.lexicon.codes(words)
    held = pair.lexicon
    n = len(texts)
    text_of = np.repeat(np.arange(n), lengths)
    bad = np.bincount(text_of, weights=~held.fixed["good"][codes][at], minlength=n) > 0 if len(at) else np.ones(n, dtype=bool)
    strings = list(map(held.lists["groups"].__getitem__, codes.tolist())) if len(codes) else []
    links, sizes = held.row_values("links", codes)
    per_text = lambda by_word: np.where(bad, 0, np.bincount(text_of, weights=by_word[at], minlength=n)).astype(np.int64)
    fixed = lambda name: held.fixed[name][codes] if len(codes) else codes
    cut = [0, *np.cumsum(lengths).tolist()]
    listed = at.tolist()
    digests = ["" if x else hashlib.sha256(";".join(map(strings.__getitem__, listed[i:j])).encode()).hexdigest()
               for x, i, j in zip(bad.tolist(), cut, cut[1:])]
    shas = [hashlib.sha256(t.encode()).digest() for t in texts.to_pylist()]
    packed = [b"" if x else at[i:j].astype("<i4").tobytes() for x, i, j in zip(bad.tolist(), cut, cut[1:])]
    starts = np.cumsum(sizes) - sizes
    kept = ~bad[text_of]
    linked = links[ragged(starts[at[kept]], sizes[at[kept]])].astype(np.int64)
    seen = np.unique(np.repeat(text_of[kept], sizes[at[kept]]) << 32 | linked)
    pairs, which = np.unique(seen & 0xFFFFFFFF, return_inverse=True)
    weights = np.bincount(which, weights=docs[seen >> 32], minlength=len(pairs)).astype(np.int64)
    none = [None]
    columns = [[run] * (n + 1), shas + none, docs.tolist() + none, per_text(fixed("n_a")).tolist() + none, per_text(fixed("n_b")).tolist() + none,
               per_text(fixed("n_groups")).tolist() + none, per_text(sizes).tolist() + none, digests + none,
               packed + none, none * n + [links.astype("<u4").tobytes()], none * n + [sizes.astype("<i4").tobytes()]]
    lists = [pa.array(none * n + [x], type=pa.list_(pa.int64())) for x in (pairs, weights)]
    kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(columns, kinds)] + lists,
                                      names=[x.split()[0] for x in _RUNS.split(", ")])


def aligned_runs(docs: DataFrame, byte_level: str, pattern: str, pieces: bytes, text: str = "text", run_bytes: int = RUN_BYTES) -> DataFrame:
    """Distinct non-empty texts, aligned, with a row more for every run (``sha`` null)."""
    spark = docs.sparkSession
    ship_code(spark)
    held = spark.sparkContext.broadcast((byte_level, pattern, pieces))
    distinct = (docs.select(F.col(f"`{text}`").alias("text")).filter("text is not null and text <> ''")
                .groupBy("text").agg(F.count(F.lit(1)).alias("n_docs")))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*held.value)
        run = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, n in runs(batch.column(0), run_bytes):
                part = batch.slice(start, n)
                yield _measured(pair, part.column(0), part.column(1).to_numpy(), run)
                run += 1

    return saved(distinct.mapInArrow(make, _RUNS), "align-runs")


def pair_counts(by_run: DataFrame) -> DataFrame:
    """(a_id, b_id, n_docs, best): the documents that hold each linked pair, and
    whether no other pair of its A id has more."""
    summed = (by_run.filter("sha is null").select(F.inline(F.arrays_zip("pairs", "weights")))
              .groupBy("pairs").agg(F.sum("weights").alias("n_docs")))
    summed = saved(summed.select(F.expr(f"pairs div {B_IDS}").alias("a_id"), F.expr(f"pairs % {B_IDS}").alias("b_id"), "n_docs"), "align-pairs")
    best = summed.groupBy("a_id").agg(F.max("n_docs").alias("most"))
    return summed.join(best, "a_id").select("a_id", "b_id", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def _summed(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The texts of one run with the sums over their links."""
    left = left.combine_chunks()
    of_run = left.filter(pa.compute.is_null(left.column("sha")))
    texts = left.filter(pa.compute.is_valid(left.column("sha")))
    order = np.argsort(right.column("pair").to_numpy(), kind="stable")
    pairs, count, best = (right.column(c).to_numpy()[order] for c in ("pair", "n_docs", "best"))
    links = np.frombuffer(of_run.column("links")[0].as_py(), dtype="<u4")
    sizes = np.frombuffer(of_run.column("sizes")[0].as_py(), dtype="<i4")
    word_of = np.repeat(np.arange(len(sizes)), sizes)
    # A chunk whose texts all have no tokens counts no pairs; none of them asks for its sums.
    found = np.minimum(np.searchsorted(pairs, links), max(len(pairs) - 1, 0))
    total = lambda x: np.bincount(word_of, weights=x[found], minlength=len(sizes)).astype(np.int64) if len(pairs) else np.zeros(len(sizes), dtype=np.int64)
    counts, bests = total(count), total(best)
    words = [np.frombuffer(w, dtype="<i4") for w in texts.column("words").to_pylist()]
    made = {"n_best": [int(bests[w].sum()) for w in words], "count_sum": [int(counts[w].sum()) for w in words]}
    for name, values in made.items():
        texts = texts.append_column(name, pa.array(values, type=pa.int64()))
    return texts.select(["sha", "n_docs", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def text_measures(by_run: DataFrame, counts: DataFrame) -> DataFrame:
    """A row for each distinct text: its hash, its documents and its measures."""
    wanted = by_run.filter("sha is null").select(F.col("run").alias("of_run"), F.explode("pairs").alias("pair"))
    known = counts.select((F.col("a_id") * B_IDS + F.col("b_id")).alias("pair"), "n_docs", F.col("best").cast("long").alias("best"))
    back = wanted.join(known, "pair").select("of_run", "pair", "n_docs", "best")
    texts = by_run.select("run", "sha", "n_docs", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "words", "links", "sizes")
    return texts.groupBy("run").cogroup(back.groupBy("of_run")).applyInArrow(
        _summed, "sha binary, n_docs long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align(docs: DataFrame, byte_level: str, pattern: str, pieces: bytes, doc_id: str = "doc_id", text: str = "text",
          run_bytes: int = RUN_BYTES) -> DataFrame:
    """One row per input row: ``doc_id``, the measures and ``groups_sha256``.

    ``byte_level`` is the content of A's tokenizer file, ``pieces`` B's model, both
    of fixed size; ``pattern`` is how A cuts texts.
    """
    by_run = aligned_runs(docs, byte_level, pattern, pieces, text, run_bytes)
    measures = saved(text_measures(by_run, pair_counts(by_run)).withColumnRenamed("n_docs", "text_docs"), "align-texts")
    whole = F.col(f"`{text}`")
    keyed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.when(whole != "", F.unhex(F.sha2(whole, 256))).alias("sha"))
    total = keyed.count()
    found = with_group(keyed.filter("sha is not null"), measures, "sha", "text_docs", total).drop("sha", "text_docs")
    zero = [F.lit(0).cast("long").alias(m) for m in MEASURES]
    none = keyed.filter("sha is null").select("doc_id", *zero, F.lit("").alias("groups_sha256"))
    return found.select("doc_id", *MEASURES, "groups_sha256").unionByName(none)
