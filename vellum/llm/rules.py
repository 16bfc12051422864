"""Quality rules: a decision list learned by sequential covering.

Statistics of each whole text are taken in one pass, in its task.  Rules that reject
are learned from labelled rows: conditions ``feature >= / <= threshold`` are added one
at a time by information gain on two thirds of the rows (growing), then dropped from
the end while that serves the other third (pruning); the rows a rule covers are taken
out and the next rule is sought, until none is precise enough.  The ordered list becomes one
chain of Spark conditions.

The learner sees at most ``FIT_ROWS`` labelled rows of statistics, the first by a seeded
hash; that bounds what reaches the driver.  Everything else covers all rows.

Defined cases: a null text has no words and all counts 0.  Without labelled rows of both
kinds there are no rules and only the base test rejects.  Labels that contradict each
other for one id count as the lowest.  A null label or id is no label.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import saved, with_made

FIT_ROWS = 10_000
SEED = 11
WINDOW = 3

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
STOPS = b".,;:!?"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
words_of, has_word = WORD.findall, WORD.search

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_upper",
          "n_digits", "n_stops", "n_exclaim", "n_long_words")

# What rules may test, from the counts.
FEATURES = {
    "n_words": "n_words",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
    "exclaims_per_word": "n_exclaim / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "long_word_share": "n_long_words / greatest(n_words, 1)",
}


def repeat_words(words: list[str], window: int = WINDOW) -> tuple[int, int]:
    """Words that lie in a window found twice or more, and distinct words."""
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    if len(ids) < window + 1:
        return 0, len(known)
    base = np.int64(len(known))
    key = ids[:len(ids) - window + 1]
    for k in range(1, window):
        key = key * base + ids[k:len(ids) - window + 1 + k]
        if k + 1 < window and len(known) >= 1 << 20:  # the next product could overflow
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    often = n[at] > 1
    inside = np.zeros(len(ids), dtype=bool)
    for k in range(window):
        inside[k:len(ids) - window + 1 + k] |= often
    return int(inside.sum()), len(known)


def measure(text: str | None) -> tuple:
    """The ``COUNTS`` of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = words_of(text)
    held = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in text.split("\n") if has_word(x)]
    repeats, distinct = repeat_words(words)
    return (len(words), len(text) - held(SPACES), held(SYMBOLS), len(lines) - len(set(lines)), repeats, distinct, len(lines),
            held(UPPER), held(DIGITS), held(STOPS), raw.count(b"!"), sum(len(w) > 20 for w in words))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with the ``COUNTS`` as longs."""
    return with_made(docs, text, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]),
                     lambda texts: [list(x) for x in zip(*map(measure, texts))])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, at_least, threshold) that rejects."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        return reduce(Column.__and__, [F.expr(FEATURES[f]) >= t if up else F.expr(FEATURES[f]) <= t for f, up, t in self.tests])

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return reduce(np.logical_and, [x[f] >= t if up else x[f] <= t for f, up, t in self.tests])

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>=' if up else '<='} {t:g}" for f, up, t in self.tests)


def _best_test(values: np.ndarray, bad: np.ndarray) -> tuple[float, bool, float]:
    """(information gain, at_least, threshold) of the feature's best condition."""
    order = np.argsort(values, kind="stable")
    v, b = values[order], bad[order]
    cuts = np.flatnonzero(v[1:] > v[:-1])
    if not len(cuts):
        return 0.0, True, 0.0
    p, upto = b.sum(), np.cumsum(b)[cuts]
    best = (0.0, True, 0.0)
    for up, pos, covered in ((False, upto, cuts + 1), (True, p - upto, len(v) - cuts - 1)):
        gain = pos * (np.log2(np.maximum(pos, 1e-9) / covered) - np.log2(p / len(v)))
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = float(gain[i]), up, float((v[cuts[i]] + v[cuts[i] + 1]) / 2)
    return best


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, first: str, most: int) -> Rule | None:
    """A rule that begins with ``first``: add the condition with the largest
    gain until no good row is covered."""
    inside, tests = np.ones(len(bad), dtype=bool), []
    while len(tests) < most and (~bad & inside).any() and (bad & inside).any():
        found = [(*_best_test(x[f][inside], bad[inside]), f) for f in (x if tests else (first,))]
        gain, up, at, f = max(found, key=lambda t: t[0])
        if gain <= 0:
            break
        tests.append((f, up, at))
        inside &= Rule((tests[-1],)).holds(x)
    return Rule(tuple(tests)) if tests else None


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, least_precision: float = 0.99, good_cost: float = 20.0,
          least_rows: int = 5, most_rules: int = 16, most_tests: int = 4, seed: int = SEED) -> list[Rule]:
    """Decision list of rules that reject; what none covers is accepted.

    A rule is grown from each feature and cut to the length that serves the pruning
    rows best, where a good row rejected weighs as much as ``good_cost`` bad rows kept.
    The best of them joins the list, if it is precise on all rows that are left.
    """
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    left = np.arange(len(bad))
    while len(rules) < most_rules and bad[left].any() and not bad[left].all():
        deal = rng.permutation(left)
        cut = 2 * len(deal) // 3
        (gx, gb), (px, pb), (lx, lb) = [({f: v[rows] for f, v in x.items()}, bad[rows]) for rows in (deal[:cut], deal[cut:], left)]

        def worth(rule: Rule) -> float:
            hit = rule.holds(px)
            return (pb & hit).sum() - good_cost * (~pb & hit).sum()

        def precise(rule: Rule) -> bool:
            hit = rule.holds(lx)
            return (lb & hit).sum() >= max(least_rows, least_precision * hit.sum())

        grown = [r for r in (_grow(gx, gb, f, most_tests) for f in x) if r]
        cuts = {Rule(r.tests[:k]) for r in grown for k in range(1, len(r.tests) + 1)}
        good = [r for r in cuts if worth(r) > 0 and precise(r)]
        if not good:
            break
        rules.append(max(good, key=lambda r: (worth(r), -len(r.tests), str(r))))
        left = left[~rules[-1].holds(lx)]
    return rules


def fit(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", *, fit_rows: int = FIT_ROWS,
        seed: int = SEED, **how) -> list[Rule]:
    """Rules from the statistics of labelled rows, about ``fit_rows`` of them (a hash bound set by the number of
    labels, so each task sends its share only); label 0 is what rules reject."""
    known = labels.filter(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.min(label).alias("label"))
    known = saved(known.withColumn("place", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 1).cast("double")), "quality-labels")
    share = min(1.0, fit_rows / max(1, known.count()))
    rows = stats.select(F.col(doc_id).alias("id"), *[F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()])
    sample = rows.join(known.filter(F.col("place") <= share * float(1 << 63)), "id").select("label", "id", *FEATURES).toPandas()
    sample = sample.sort_values(["id", "label"], kind="stable").reset_index(drop=True)
    if sample.empty:
        return []
    return learn({f: sample[f].to_numpy() for f in FEATURES}, sample["label"].to_numpy() == 0, seed=seed, **how)


def verdict(rules: list[Rule]) -> Column:
    """True for what the list accepts: the ordered rules as one conditional."""
    if not rules:
        return F.lit(True)
    chain = F.when(rules[0].column(), F.lit(False))
    for r in rules[1:]:
        chain = chain.when(r.column(), F.lit(False))
    return chain.otherwise(F.lit(True))


def fired(rules: list[Rule]) -> Column:
    """Text of the first rule that covers a row, else null."""
    chain = F.lit(None).cast("string")
    for r in reversed(rules):
        chain = F.when(r.column(), F.lit(str(r))).otherwise(chain)
    return chain
