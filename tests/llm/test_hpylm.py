import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.llm import hpylm
from vellum.llm.queries import op7_pitman_yor_lm
from tests.llm.conftest import EDGE_ROWS

words_of = re.compile(r"[^\x20\x09-\x0D]+").findall


def tokens(text):
    return words_of((text or "").encode().lower().decode()) + [None]


def brute(rows, held):
    counts = Counter()
    for (i, t), h in zip(rows, held):
        if not h:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, h, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n,
             sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for (i, t), h in zip(rows, held)]


def agree(rows, expected):
    key = lambda r: (repr(r[0]), r[2], r[5])
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows), key=key)
    for g, e in zip(got, sorted(expected, key=key), strict=True):
        assert g[:5] == e[:5] and g[5] == pytest.approx(e[5], rel=1e-9, abs=1e-9)


def test_symbols_after_any_context_have_probability_one():
    statistics = {b"\xfeab": 5, b"\xfea": 9, b"ab\xff": 4, b"b\xff": 2, b"a": 3, b"x": 1, b"\xfeax": 2, b"ax": 2}
    levels = hpylm.Levels(statistics)
    own, rest = hpylm.run_chain(levels, 3)
    model = hpylm.Model({g: v for k in range(hpylm.ORDER + 1) for g, v in zip(levels.grams[k], own[k])},
                        {c: v for k in range(hpylm.ORDER + 1) for c, v in zip(levels.names[k], rest[k])})
    for context in (b"", b"a", b"\xfe", b"\xfea", b"zz", b"ab", b"qab"):
        known = sum(model.symbol(context, bytes([i])) for i in range(256))
        assert known + 2 * model.symbol(context, b"no such symbol") == pytest.approx(1)


def test_seating_keeps_its_bounds_and_follows_the_parent():
    rng = np.random.default_rng(0)
    c = np.array([0, 1, 2, 50, 5000, 5000])
    p = np.array([0.1, 0.1, 0.1, 0.1, 1e-9, 0.9])
    drawn = np.stack([hpylm._seat(c, p, 1.0, 0.5, np.zeros(6), rng)[0] for _ in range(50)])
    assert (drawn <= c).all() and (drawn[:, 1:] >= 1).all() and (drawn[:, 0] == 0).all()
    assert drawn[:, 4].mean() < 2 < drawn[:, 5].mean()


def test_blocks_of_customers_seat_like_single_ones():
    """The mean number of tables from blocks against a plain loop."""
    rng, c, p, d, strength = np.random.default_rng(1), 600, 0.3, 0.5, 1.0
    loop = []
    for _ in range(300):
        t = 1
        for i in range(1, c):
            new = (strength + d * t) * p
            t += rng.random() < new / (new + i - d * t)
        loop.append(t)
    blocks = hpylm._seat(np.full(2000, c), np.full(2000, p), strength, d, np.zeros(2000), rng)[0]
    assert blocks.mean() == pytest.approx(np.mean(loop), rel=0.1)


def test_edges(edge, clashing, empty):
    held = F.col("doc_id").isin(2, 9)
    expected = brute([r[:2] for r in EDGE_ROWS], [r[0] in (2, 9) for r in EDGE_ROWS])
    for docs in (edge, clashing):
        rows = hpylm.score(docs, held).collect()
        agree(rows, expected)
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
        by = {r["doc_id"]: r["score"] for r in rows}
        assert by[3] == by[4] == by[5]  # the end alone
    assert hpylm.score(empty, held).count() == 0
    rows = hpylm.score(edge, F.lit(True)).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"]) for r in rows} == {(0, 0, 0.0)}
    assert all(math.isfinite(r["score"]) for r in rows)


def test_model_prefers_what_it_has_learned(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = op7_pitman_yor_lm(spark, sf).collect()
    agree(rows, brute(docs, [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]))
    held = [r for r in rows if r["held_out"]]
    mean = sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held)
    texts = dict(docs)
    swapped = spark.createDataFrame([(r["doc_id"], " ".join(w[::-1] for w in texts[r["doc_id"]].split())) for r in held]
                                    + [d for d in docs if d[0] not in {r["doc_id"] for r in held}], "doc_id long, text string")
    from vellum.llm.queries import fold

    other = hpylm.score(swapped, fold(7, 2)).filter("held_out").agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    # Held-out texts are far likelier than the same texts with every word reversed.
    assert mean > other + 0.5
    # And words are likelier than under the uniform base, a symbol at a time.
    chars = sum(len(w.encode()) + 1 for r in held for w in texts[r["doc_id"]].split())
    assert mean * sum(r["n_tokens"] for r in held) > -math.log10(hpylm.SYMBOLS) * chars / 1.5


def test_words_are_scored_in_their_context(spark, monkeypatch):
    """The same words in another order are less likely, in one part and in many."""
    learned = ["the cat sat on the mat and the dog sat on the rug"] * 6 + ["a dog and a cat", None, ""]
    texts = [*learned, "the cat sat on the mat", "mat the on sat cat the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = [i >= len(learned) for i in range(len(texts))]
    for part_tokens in (hpylm.PART_TOKENS, 8):
        monkeypatch.setattr(hpylm, "PART_TOKENS", part_tokens)
        rows = hpylm.score(docs, F.col("doc_id") >= len(learned)).collect()
        agree(rows, brute(list(enumerate(texts)), held))
        score = {r["doc_id"]: r["score"] for r in rows}
        assert score[len(learned)] > score[len(learned) + 1] + 3
        assert len({score[i] for i in range(6)}) == 1


def test_bigrams_of_a_run_come_in_the_same_order_for_any_order_of_its_documents():
    number, many = np.array([7, 3, 9, 4]), np.array([False, True, False, False])
    docs = [[0, 1, 2], [], [3, 1, 0, 1]]
    made = [hpylm.Bigrams(pa.array(d, type=pa.list_(pa.int32())), number, many, 5) for d in (docs, docs[::-1])]
    pairs = [list(zip(g.numbers[g.before[g.order]].tolist(), g.numbers[g.after[g.order]].tolist())) for g in made]
    assert pairs[0] == pairs[1]
    assert set(pairs[0]) == {(0, 7), (7, 3), (3, 9), (9, 0), (0, 0), (0, 4), (4, 3), (3, 7), (3, 0)}
    assert [g.sizes.tolist() for g in made] == [[4, 1, 5], [5, 1, 4]]
    for g in made:  # a context of few customers is in one part
        for u in (0, 2, 3):
            assert len(set(g.part[g.before == u].tolist())) == 1


def test_tables_of_word_contexts_keep_their_bounds_and_follow_the_word():
    u = np.repeat(np.arange(40), 3)
    n, p = np.tile([1, 300, 300], 40), np.tile([0.5, 1e-9, 0.5], 40)
    tables, mean = hpylm.seat_contexts(u, n, p, np.ones(len(u)), [1, 2])
    assert (tables >= 1).all() and (tables <= n).all() and (mean >= 1).all() and (mean <= n).all()
    assert (tables[0::3] == 1).all() and tables[1::3].mean() < 1.1 < 3 < tables[2::3].mean()
