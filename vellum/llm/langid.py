"""Language identification by word-first backoff.

A word that the model knows is scored by its relative frequency in each language
(minus its decimal logarithm; a fixed penalty where a language lacks it).  For an
unseen word the longest character n-grams that any language knows stand in, then
shorter ones, down to single letters; the word's score is the mean over its known
n-grams.  A text's score in a language is the mean over all its words; the lowest wins.
A word is a run of letters and the marks on them, so scripts that write vowels as
marks keep their words whole.

The model is fitted with Spark on labelled rows.  ``FIT_ROWS`` is its documented bound: the
languages share it evenly, and one with more rows counts equal texts once
and is sampled by a seeded hash of the text.  Every word and n-gram of those
rows is in the model, also those that occur once.  Frequencies are computed in Spark; the
table, a row per word or n-gram, comes to the driver once as Arrow batches and goes
to the tasks as such; no list of rows is made of it.  Every text is scored
whole, in its task, without a shuffle.

Defined cases: a null text and a text without a letter are ``und`` with score 0.  Without
labelled rows everything is ``und``.  A text of letters that no language knows gets
the language with the most words and score 1 / (number of languages).  Equal scores go
to the first language by code point.  Rows with a null language aren't learned from.
Columns named like an added one are replaced by it in ``predict``; no other function adds any.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import fresh, saved, with_made
from vellum.llm.lexicon import Lexicon
from vellum.session import ship_code

FIT_ROWS = 8_000
LONGEST_GRAM = 5
SEED = 7
UNKNOWN = "und"
# Words remembered by a task: a bound of memory, not of input.
REMEMBERED = 100_000
# A label gives way to a prediction of at least this score (the mean word is at least 1.5 times as likely as in all other
# languages together, though the model has learned from the label as well) over at least so many words.
CERTAIN = 0.6
CERTAIN_WORDS = 20

WORD = r"\p{M}*\p{L}[\p{L}\p{M}]*"
words_of = regex.compile(WORD).findall


def grams(word: str, n: int) -> list[str]:
    """n-grams of the word between two spaces; single letters without them."""
    padded = word if n == 1 else f" {word} "
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def _sample(rows: DataFrame, fit_rows: int, seed: int) -> DataFrame:
    """About ``fit_rows`` of the rows (lang, text) at most, as many of each language."""
    slim = rows.select("lang", F.xxhash64(F.lit(seed), "text").alias("h1"), F.xxhash64(F.lit(~seed), "text").alias("h2"))
    # A row per language comes to the driver.
    sizes = slim.groupBy("lang", "h1", "h2").count().groupBy("lang").agg(F.sum("count").alias("rows"), F.count(F.lit(1)).alias("texts")).collect()
    fair = fit_rows / max(1, len(sizes))
    large = {r["lang"]: min(1.0, fair / r["texts"]) for r in sizes if r["rows"] > fair}
    if not large:
        return rows
    share = F.lit(0.0)
    for name, value in large.items():
        share = F.when(F.col("lang") == name, F.lit(value)).otherwise(share)
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "text"), 1).cast("double")
    taken = rows.filter(F.col("lang").isin(*large)).filter(place <= share * F.lit(float(1 << 63))).distinct()
    return rows.filter(~F.col("lang").isin(*large)).unionByName(taken)


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", *, fit_rows: int = FIT_ROWS,
        longest: int = LONGEST_GRAM, seed: int = SEED) -> Model:
    """Model of the rows with a text and a language, of at most about ``fit_rows`` of them."""
    ship_code(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).filter(
        "lang is not null and text is not null")

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for name, whole in zip(batch["lang"], batch["text"]):
                seen.setdefault(name, Counter()).update(words_of(whole.lower()))
            for name, counts in seen.items():
                if counts:
                    yield pd.DataFrame({"lang": name, "item": list(counts), "n": list(counts.values())})

    def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for name, word, n in zip(batch["lang"], batch["item"], batch["n"].tolist()):
                mine = seen.setdefault(name, Counter())
                for size in range(1, longest + 1):
                    for g in grams(word, size):
                        mine[g] += n
            for name, mine in seen.items():
                yield pd.DataFrame({"lang": name, "item": list(mine), "n": list(mine.values())})

    def summed(parts: DataFrame) -> DataFrame:
        return parts.groupBy("lang", "item").agg(F.sum("n").alias("n"))

    words = saved(summed(_sample(rows, fit_rows, seed).mapInPandas(count_words, "lang string, item string, n long")), "langid-words")
    parts = summed(words.mapInPandas(count_grams, "lang string, item string, n long"))
    # Frequencies are among words, and among n-grams of one length.
    counts = saved(words.withColumn("size", F.lit(0)).unionByName(parts.withColumn("size", F.length("item"))), "langid-counts")
    totals = {(r["lang"], r["size"]): r["n"] for r in counts.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({name for name, _ in totals})
    penalty = 1 + math.log10(max([*totals.values(), 1]))
    known = labelled.sparkSession.createDataFrame(
        [(name, size, langs.index(name), n) for (name, size), n in totals.items()], "of string, length int, at int, total long")
    scored = counts.join(F.broadcast(known), (F.col("lang") == F.col("of")) & (F.col("size") == F.col("length"))) \
        .select(F.col("size") == 0, "item", F.struct(F.col("at"), (F.log10(F.col("total") / F.col("n")) - penalty).cast("float").alias("gain")).alias("one"))
    table = scored.toDF("word", "item", "one").groupBy("word", "item").agg(F.sort_array(F.collect_list("one")).alias("by"))
    table = saved(table.select("word", "item", F.col("by.at").alias("at"), F.col("by.gain").alias("gain")), "langid-model").toArrow()
    fallback = max(langs, key=lambda x: (totals[x, 0], x)) if langs else UNKNOWN
    return Model(langs, fallback, penalty, longest, table)


class _Rows:
    """Row by item, for some rows of a column of strings: their 64-bit hashes in order instead of a dict of
    strings, which takes twenty times as much memory.  An item's own string decides."""

    def __init__(self, items: pa.ChunkedArray, rows: np.ndarray):
        self.items = items.combine_chunks()
        keys = np.empty(len(rows), dtype=np.uint64)
        for start in range(0, len(rows), 10_000):  # few strings at a time
            some = rows[start:start + 10_000]
            keys[start:start + len(some)] = self.hashes(self.items.take(pa.array(some)).to_pylist())
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], rows[order]

    @staticmethod
    def hashes(items: list[str]) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in items), dtype=np.uint64, count=len(items))

    def __iter__(self) -> Iterator[str]:
        return (self.items[i].as_py() for i in self.rows.tolist())

    def __contains__(self, item: str) -> bool:
        return bool(self.find([item])[0] >= 0)

    def find(self, items: list[str]) -> np.ndarray:
        """The row of each item; -1: none."""
        out = np.full(len(items), -1, dtype=np.int64)
        if not len(self.keys) or not items:
            return out
        keys = self.hashes(items)
        place = np.searchsorted(self.keys, keys)
        at = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] == keys)
        out[at] = self.rows[place[at]]
        asked = pa.array([items[i] for i in at.tolist()], type=self.items.type)
        same = pc.equal(self.items.take(pa.array(out[at])), asked).to_numpy(zero_copy_only=False)
        for i in at[~same.astype(bool)].tolist():  # another string with the same hash
            run = self.rows[self.keys == keys[i]].tolist()
            out[i] = next((r for r in run if self.items[r].as_py() == items[i]), -1)
        return out


class Model:
    """Scores per language for words and n-grams, held sparse: by item the languages
    that know it and what each gains on the penalty.  See the module's text."""

    def __init__(self, langs: list[str], fallback: str, penalty: float, longest: int, table: pa.Table):
        self.langs, self.fallback, self.penalty, self.longest = langs, fallback, penalty, longest
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        self.packed = out.getvalue().to_pybytes()
        self.tables = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None}

    def _open(self) -> None:
        """In a task: row by item, and the rows' values in a row."""
        if self.tables:
            return
        table = pa.ipc.open_stream(pa.BufferReader(self.packed)).read_all().combine_chunks()
        is_word = table.column("word").to_numpy()
        words, parts = (_Rows(table.column("item"), np.flatnonzero(is_word == kind)) for kind in (True, False))
        at = table.column("at").combine_chunks()
        sizes = np.diff(at.offsets.to_numpy()).astype(np.int64)
        self.tables = (words, parts, at.flatten().to_numpy().astype(np.int64), table.column("gain").combine_chunks().flatten().to_numpy().astype(np.float64),
                       np.cumsum(sizes) - sizes, sizes)
        self.lexicon = Lexicon(self._learn, REMEMBERED)

    def gains(self, rows: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """Sum of the gains of table rows, by ``of`` (below ``n``) and language."""
        _, _, at, gain, starts, sizes = self.tables
        k = len(self.langs)
        where = np.repeat(starts[rows] - (np.cumsum(sizes[rows]) - sizes[rows]), sizes[rows]) + np.arange(int(sizes[rows].sum()))
        return np.bincount(np.repeat(of, sizes[rows]) * k + at[where], weights=gain[where], minlength=n * k).reshape(n, k)

    def _learn(self, words: list[str]) -> dict:
        """The gains of words, all words of one backoff step together."""
        known, parts = self.tables[:2]
        total, scored = np.zeros((len(words), len(self.langs))), np.zeros(len(words))
        rows = known.find(words)
        hit = np.flatnonzero(rows >= 0)
        total += self.gains(rows[hit], hit, len(words))
        scored[hit] = 1
        todo = np.flatnonzero(rows < 0).tolist()
        for n in range(self.longest, 0, -1):
            made = [grams(words[i], n) for i in todo]
            of = np.repeat(np.array(todo, dtype=np.int64), [len(x) for x in made])
            found = parts.find([g for x in made for g in x])
            of, found = of[found >= 0], found[found >= 0]
            counts = np.bincount(of, minlength=len(words))
            if len(of):
                total += self.gains(found, of, len(words)) / np.maximum(counts, 1)[:, None]
                scored[counts > 0] = 1
            todo = [i for i in todo if not counts[i]]
        word, lang = np.nonzero(total)
        sizes = np.bincount(word, minlength=len(words))
        return {"at": (lang, sizes), "gain": (total[word, lang], sizes), "scored": scored}

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """(language, score, number of words) of each text."""
        split = [words_of(t.lower()) if t else [] for t in texts]
        if not self.langs:
            return [(UNKNOWN, 0.0, len(words)) for words in split]
        self._open()
        coded = pa.array([w for words in split for w in words], type=pa.large_string()).dictionary_encode()
        codes = self.lexicon.codes(coded.dictionary)
        each = coded.indices.to_numpy(zero_copy_only=False)
        text_of = np.repeat(np.arange(len(texts)), [len(words) for words in split])
        n, k = len(texts), len(self.langs)
        # (text, distinct word) once, with its number of places
        places, times = np.unique(text_of * max(1, len(codes)) + each, return_counts=True)
        text_of, word_of = places // max(1, len(codes)), codes[places % max(1, len(codes))] if len(codes) else codes
        at, sizes = self.lexicon.row_values("at", word_of)
        gain, _ = self.lexicon.row_values("gain", word_of)
        sums = np.bincount(np.repeat(text_of, sizes) * k + at, weights=gain * np.repeat(times, sizes), minlength=n * k).reshape(n, k)
        scored = np.bincount(text_of, weights=self.lexicon.fixed["scored"][word_of] * times, minlength=n) if len(codes) else np.zeros(n)
        means = np.round(sums / np.maximum(scored, 1)[:, None], 9)
        best = means.argmin(axis=1)
        scores = 1 / np.power(10.0, means[np.arange(n), best][:, None] - means).sum(axis=1)
        out = []
        for words, some, i, score in zip(split, scored.tolist(), best.tolist(), scores.tolist()):
            if not words:
                out.append((UNKNOWN, 0.0, 0))
            else:
                out.append((self.langs[i], score, len(words)) if some else (self.fallback, 1 / k, len(words)))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0][:2]


def predict(docs: DataFrame, model: Model, text: str = "text", *, lang: str = "lang_pred", score: str = "score", n_words: str | None = None,
            keep_text: bool = False) -> DataFrame:
    """``docs`` without ``text`` unless kept, with the predicted language and its score, the
    winner's share of the languages' mean word probabilities (0 to 1)."""
    docs = docs.drop(*[c for c in (lang, score, n_words) if c and c != text])
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [lang, score, *([n_words] if n_words else [])]
    added = T.StructType([T.StructField(n, kind) for n, kind in zip(names, (T.StringType(), T.DoubleType(), T.LongType()))])
    return with_made(docs, text, added, lambda texts: [list(x) for x in zip(*held.value.predict_all(texts))][:len(names)], keep_text)


def identify(docs: DataFrame, train: Column, lang: str = "lang", text: str = "text") -> DataFrame:
    """Fit on the rows of ``docs`` where ``train`` holds, then predict all rows."""
    return predict(docs, fit(docs.filter(train), lang, text), text)


def decided(docs: DataFrame, lang: str = "lang", text: str = "text", model: Model | None = None) -> tuple[DataFrame, str]:
    """``docs`` with its languages put right, and the name of a column that says what was decided:

    * ``no_letter``: nothing to identify; the row is rejected;
    * ``filled``: the row had no language and gets the predicted one;
    * ``corrected``: the model contradicts the row's language with a score of ``CERTAIN`` or more
      over ``CERTAIN_WORDS`` words or more; the predicted one stands;
    * ``kept``: all others, languages as they were (also a null where there is nothing to learn from).
    """
    guess, score, n, decision = fresh(docs, "guess", "score", "n_words", "decision")
    out = predict(docs, model or fit(docs, lang, text), text, lang=guess, score=score, n_words=n, keep_text=True)
    own, no_guess = F.col(f"`{lang}`"), F.col(guess) == UNKNOWN
    sure = (F.col(score) >= CERTAIN) & (F.col(n) >= CERTAIN_WORDS)
    out = out.withColumn(decision, F.when(F.col(n) == 0, "no_letter").when(no_guess, "kept").when(own.isNull(), "filled")
                         .when(sure & (own != F.col(guess)), "corrected").otherwise("kept"))
    changed = F.when(F.col(decision).isin("filled", "corrected"), F.col(guess)).otherwise(own).alias(lang)
    return out.select(*[changed if c == lang else F.col(f"`{c}`") for c in docs.columns], decision), decision


def keep_identified(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``docs`` without the rows that have no language to identify, the others' languages
    filled in or corrected by the model (see ``decided``).

    A score is a share among the learned languages, whose number is the
    table's affair, so no row goes for a low one.  Learned from the labelled rows of ``docs``
    themselves; the row travels through the same pass as its text, so nothing is joined or shuffled.
    """
    out, decision = decided(docs, lang, text)
    return out.filter(F.col(decision) != "no_letter").select(*[f"`{c}`" for c in docs.columns])


def decisions(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(decision, n): how many rows each decision takes."""
    out, decision = decided(docs, lang, text)
    return out.groupBy(F.col(decision).alias("decision")).agg(F.count(F.lit(1)).alias("n"))
