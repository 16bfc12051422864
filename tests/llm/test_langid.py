import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.llm import langid
from vellum.llm.queries import fold, op2_language_id
from tests.llm.conftest import EDGE_ROWS, rows_of


def model_of(totals, words, parts, longest):
    """A model of hand-made counts: {item: {lang: n}}."""
    langs = sorted({name for name, _ in totals})
    penalty = 1 + math.log10(max(totals.values()))
    rows = []
    for is_word, table in ((True, words), (False, parts)):
        for item, by in table.items():
            size = 0 if is_word else len(item)
            gains = sorted((langs.index(x), math.log10(totals[x, size] / n) - penalty) for x, n in by.items())
            rows.append({"word": is_word, "item": item, "at": [i for i, _ in gains], "gain": [g for _, g in gains]})
    kinds = pa.schema([("word", pa.bool_()), ("item", pa.string()), ("at", pa.list_(pa.int32())), ("gain", pa.list_(pa.float32()))])
    return langid.Model(langs, max(langs), penalty, longest, pa.Table.from_pylist(rows, schema=kinds))


def test_words_come_before_grams():
    model = model_of({("x", 0): 10, ("y", 0): 10, ("x", 2): 10, ("y", 2): 10, ("x", 1): 10, ("y", 1): 10},
                     {"ab": {"x": 10}}, {"ab": {"y": 10}, " c": {"y": 5}, "q": {"x": 1}}, 2)
    assert model.predict("ab")[0] == "x"  # known as a word, though the n-gram speaks for y
    assert model.predict("abab")[0] == "y"  # unseen: n-grams
    assert model.predict("cz")[0] == "y"
    assert model.predict("q")[0] == "x"  # no n-gram of two known: one letter
    assert model.predict("zz") == ("y", 0.5)
    assert model.predict("12 !") == model.predict("") == model.predict(None) == ("und", 0.0)


def plain_score(model, counts, totals, text):
    """Mean negative log frequencies by language, word by word."""
    penalty, langs = model.penalty, model.langs
    sums, n = dict.fromkeys(langs, 0.0), 0
    for w in langid.words_of(text.lower()):
        steps = [[(0, w)]] + [[(k, g) for g in langid.grams(w, k)] for k in range(model.longest, 0, -1)]
        for step in steps:
            known = [(size, g) for size, g in step if any((x, size, g) in counts for x in langs)]
            if known:
                n += 1
                for x in langs:
                    cost = [math.log10(totals[x, s] / counts[x, s, g]) if (x, s, g) in counts else penalty for s, g in known]
                    sums[x] += sum(cost) / len(cost)
                break
    return {x: v / n for x, v in sums.items()} if n else None


def test_scores_match_brute_force(edge):
    model = langid.fit(edge)
    totals, counts = {}, {}
    for _, t, lang, *_ in EDGE_ROWS:
        if t is not None and lang is not None:
            for w in langid.words_of(t.lower()):
                for size, g in [(0, w), *((k, g) for k in range(1, model.longest + 1) for g in langid.grams(w, k))]:
                    totals[lang, size] = totals.get((lang, size), 0) + 1
                    counts[lang, size, g] = counts.get((lang, size, g), 0) + 1
    assert model.langs == sorted({x for x, _ in totals})
    for text in ("the harbour", "été naître", "fauxbrown nets", "zq xj", "long unheardof words", "Là où"):
        means = plain_score(model, counts, totals, text)
        best = min(model.langs, key=lambda x: round(means[x], 6))
        name, score = model.predict(text)
        assert name == best
        assert score == pytest.approx(1 / sum(10 ** (means[best] - m) for m in means.values()), rel=1e-3)


def test_scripts_with_marks_keep_their_words():
    assert langid.words_of("हिन्दी भाषा में") == ["हिन्दी", "भाषा", "में"]
    assert langid.words_of("ภาษาไทย ที่นี่ 12") == ["ภาษาไทย", "ที่นี่"]
    assert langid.words_of("\u0301 12 e\u0301te\u0301") == ["e\u0301te\u0301"]


def test_edges(edge, clashing, empty):
    model = langid.fit(edge)
    out = langid.predict(edge.select("doc_id", "text"), model)
    got = {r["doc_id"]: r["lang_pred"] for r in out.filter("doc_id is not null").collect()}
    assert out.count() == len(EDGE_ROWS)
    assert {i for i, p in got.items() if p == "und"} == {3, 4, 5, 6}
    assert got[8] == "fr" and got[1] == "en"
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    left = langid.keep_identified(clashing)
    assert left.columns == clashing.columns
    expected = [r for r in clashing.collect() if r["text"] and any(c.isalpha() for c in r["text"])]
    at = clashing.columns.index("lang")
    bare = lambda rows: sorted((tuple(x for i, x in enumerate(r) if i != at) for r in rows), key=repr)
    assert bare(left.collect()) == bare(expected)
    assert left.filter("lang is null").count() == 0  # filled in
    assert langid.keep_identified(empty).count() == 0
    assert rows_of(langid.predict(edge.select("text"), langid.fit(empty)).distinct()) == [("und", 0.0)]
    clash = langid.predict(clashing, model)  # "score" is the prediction's
    assert clash.filter("score between 0 and 1").count() == len(EDGE_ROWS)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    out = op2_language_id(spark, sf).join(docs, "doc_id")
    assert out.count() == docs.count()
    assert out.filter(F.col("held_out") != fold(4, 2)).count() == 0
    right, all_ = out.filter("held_out").agg(F.count(F.when(F.col("lang") == F.col("lang_pred"), 1)), F.count("*")).first()
    assert all_ > 200 and right >= 0.99 * all_


def test_copies_and_a_hot_language_leave_rare_ones_whole(spark):
    """Many copies count once, and sample and model have room for each language."""
    hot = [(i, "en", " ".join(f"w{chr(97 + i % 26)}{chr(97 + j)}" for j in range(26))) for i in range(300)]
    hot += [(1000 + i, "en", "copy of copies") for i in range(600)]
    rare = [(5000 + i, "xx", f"qoq zaz {'yiy ' * (i + 1)}") for i in range(3)]
    docs = spark.createDataFrame(hot + rare, "doc_id long, lang string, text string")
    model = langid.fit(docs, fit_rows=30)
    assert model.langs == ["en", "xx"]
    model._open()
    words, parts = model.tables[:2]
    assert {"qoq", "zaz", "yiy"} <= set(words) and " qoq " in parts
    assert len([w for w in words if w.startswith("w")]) <= 26 * 26
    assert model.predict("zaz qoq")[0] == "xx"


def test_languages_are_filled_and_corrected(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter(F.length("text") > 400)
    other = F.when(F.col("lang") == "en", "de").otherwise("en")
    wrong = docs.withColumn("true", F.col("lang")).withColumn("lang", F.when(F.col("doc_id") % 10 == 1, other).when(F.col("doc_id") % 10 != 2, F.col("lang")))
    out, decision = langid.decided(wrong)
    by = {r[0]: (r[1], r[2]) for r in out.groupBy(decision).agg(F.count("*"), F.count(F.when(F.col("lang") == F.col("true"), 1))).collect()}
    assert by["filled"][0] > 50 and by["filled"][1] >= 0.97 * by["filled"][0]
    assert by["corrected"][0] > 20 and by["corrected"][1] >= 0.99 * by["corrected"][0]
    # a wrong label that the model has learned from may stand; a right one is never put wrong
    assert out.filter(F.col("lang") != F.col("true")).count() <= 0.8 * wrong.filter(F.col("lang") != F.col("true")).count()
    assert {r["decision"]: r["n"] for r in langid.decisions(wrong).collect()} == {k: v[0] for k, v in by.items()}


def test_low_shares_and_missing_labels_lose_no_document(spark):
    """Five languages know none of a clean text's letters; no row has a label."""
    known = [(i, name, f"{word} {word} {word}") for i, (name, word) in enumerate(zip("abcde", ("ko", "lu", "mi", "na", "pe")))]
    docs = spark.createDataFrame([*known, (7, None, "дом и сад"), (8, None, "12 !"), (9, None, None)], "doc_id long, lang string, text string")
    assert sorted(r["doc_id"] for r in langid.keep_identified(docs).collect()) == [0, 1, 2, 3, 4, 7]
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r["doc_id"] for r in langid.keep_identified(bare).collect()) == [0, 1, 2, 3, 4, 7]


def test_rows_of_items_that_share_a_hash(monkeypatch):
    """Items are told apart by their strings, and no string is held beside the Arrow column."""
    items = [f"w{i}" for i in range(40)]
    monkeypatch.setattr(langid._Rows, "hashes", staticmethod(lambda found: np.array([int(x[1:]) % 3 for x in found], dtype=np.uint64)))
    rows = langid._Rows(pa.chunked_array([items]), np.arange(0, 40, 2))
    assert rows.find([*items, "w99"]).tolist() == [i if i % 2 == 0 else -1 for i in range(40)] + [-1]
    assert rows.find([]).tolist() == [] and langid._Rows(pa.chunked_array([items]), np.arange(0)).find(items).tolist() == [-1] * 40
    assert all(isinstance(x, (np.ndarray, pa.Array)) for x in vars(rows).values())
