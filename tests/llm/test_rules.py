import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import rules
from vellum.llm.queries import op8_quality_rules
from tests.llm.conftest import EDGE_ROWS

words_of = re.compile(r"[^\x20\x09-\x0D]+").findall


def brute(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = words_of(text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a", "a b", "", "x\ny\nx\n \n \nx ", "#é* <$> | é\xa0é  e", "a b c d a b c e a b c"])
def test_counts(text):
    assert rules.measure(text)[:5] == brute(text)


def test_many_distinct_words_do_not_overflow(monkeypatch):
    words = [str(i) for i in range((1 << 20) + 10)] + ["1", "2", "3"]
    assert rules.repeat_words(words) == (6, (1 << 20) + 10)


def table(n, seed):
    rng = np.random.default_rng(seed)
    x = {f: rng.random(n) for f in rules.FEATURES}
    bad = ((x["upper_share"] > 0.8) & (x["n_words"] > 0.3)) | (x["digit_share"] < 0.1)
    return x, bad


def test_planted_conjunctions_are_learned():
    x, bad = table(4000, 1)
    learned = rules.learn(x, bad)
    x, bad = table(4000, 2)
    hit = np.zeros(len(bad), dtype=bool)
    for r in learned:
        hit |= r.holds(x)
    assert (hit & ~bad).mean() < 0.01 and (hit & bad).sum() > 0.9 * bad.sum()


def test_no_rules_from_one_kind_or_noise():
    x, _ = table(500, 3)
    assert rules.learn(x, np.zeros(500, dtype=bool)) == [] == rules.learn(x, np.ones(500, dtype=bool))
    assert rules.learn(x, np.random.default_rng(5).random(500) < 0.5) == []
    assert rules.learn({f: np.empty(0) for f in x}, np.empty(0, dtype=bool)) == []


def test_rules_as_columns_agree_with_rules_as_arrays(spark):
    stats = rules.statistics(spark.createDataFrame([(i, t) for i, t, *_ in EDGE_ROWS], "doc_id long, text string")).persist()
    first = rules.Rule((("n_words", True, 3.0), ("upper_share", True, 0.5)))
    second = rules.Rule((("distinct_share", False, 0.1),))
    rows = stats.select(*[F.expr(e).cast("double").alias(f) for f, e in rules.FEATURES.items()], rules.verdict([first, second]).alias("ok"),
                        rules.fired([first, second]).alias("why")).toPandas()
    x = {f: rows[f].to_numpy() for f in rules.FEATURES}
    hit = first.holds(x) | second.holds(x)
    assert (rows["ok"] == ~hit).all() and hit.sum() >= 3
    assert (rows["why"].isna() == ~hit).all()


def test_edges(spark, edge, clashing, empty):
    for docs in (edge, clashing):
        out = rules.statistics(docs)
        assert out.columns == [c for c in docs.columns if c != "text"] + list(rules.COUNTS)
        got = sorted(((r["doc_id"], *[r[c] for c in rules.COUNTS[:5]]) for r in out.collect()), key=repr)
        assert got == sorted(((i, *brute(t)) for i, t, *_ in EDGE_ROWS), key=repr)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert rules.fit(rules.statistics(edge), labels) == []
    assert rules.fit(rules.statistics(empty), labels) == []
    assert rules.statistics(empty).select(rules.base_failed(), rules.verdict([])).count() == 0


def test_whole_table_and_held_out_precision(spark):
    sf = "/root/testdata/sf0.1"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op8_quality_rules(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        counts = brute(docs[r["doc_id"]])
        assert tuple(r[1:6]) == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r["base_failed"] and r["kept"])
    # Learned on one half of the labels, judged on the other.
    stats = rules.statistics(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).persist()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    learned = rules.fit(stats, labels.filter("doc_id % 2 = 0"))
    judged = stats.join(labels.filter("doc_id % 2 = 1"), "doc_id").select("quality", rules.verdict(learned).alias("ok")).toPandas()
    assert ((judged["quality"] == 1) & ~judged["ok"]).sum() <= 0.01 * (judged["quality"] == 1).sum()
    assert ((judged["quality"] == 0) & ~judged["ok"]).sum() >= 0.9 * (judged["quality"] == 0).sum()
