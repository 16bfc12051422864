import re
from collections import Counter
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.llm import mixing
from vellum.llm.queries import op3_mix_sources
from tests.llm.conftest import EDGE_ROWS, rows_of


def test_targets():
    sizes = {"a": 100, "b": 100, None: 100}
    # Shares 5, 2, 1 of 450: a stops at 200, the other 250 go 2 to 1.
    assert mixing.fill_targets(sizes) == pytest.approx({"a": 200, "b": 500 / 3, None: 250 / 3})
    assert mixing.fill_targets({}) == {}
    assert mixing.fill_targets({"a": 0}) == {"a": 0}
    assert mixing.source_order([None, "é", "b", "a", "Z"]) == ["Z", "a", "b", "é", None]


def test_flow_prefers_fresh_words_and_shares_overlaps():
    words = {("a",): 50, ("a", "b"): 100, ("b",): 10}
    flow = mixing.route(words, {"a": 100, "b": 60})
    assert sum(f.get("a", 0) for f in flow.values()) == 100
    assert sum(f.get("b", 0) for f in flow.values()) == 60
    # 160 words, 160 wanted: nothing is repeated.
    assert {p: sum(f.values()) for p, f in flow.items()} == words
    # More than there is: every pattern gives its two passes.
    assert {p: sum(f.values()) for p, f in mixing.route(words, {"a": 1000, "b": 1000}).items()} == {p: 2 * n for p, n in words.items()}


def best_flow(words, quota, passes=2):
    """(words routed, cost) of the best of all flows, one by one."""
    patterns, best = list(words), (0, 0)
    choices = []
    for p in patterns:
        room = [range(min(quota[s], passes * words[p]) + 1) for s in p]
        choices.append([g for g in product(*room) if sum(g) <= passes * words[p]])
    for given in product(*choices):
        by = Counter()
        for p, g in zip(patterns, given):
            for s, n in zip(p, g):
                by[s] += n
        if all(by[s] <= quota[s] for s in by):
            # the k-th pass over a pattern costs k a word
            cost = sum(min(max(sum(g) - k * words[p], 0), words[p]) * (k + 1) for p, g in zip(patterns, given) for k in range(passes))
            best = max(best, (sum(by.values()), -cost))
    return best[0], -best[1]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.sampled_from([("a",), ("b",), ("c",), ("a", "b"), ("b", "c")]), st.integers(0, 4), min_size=1, max_size=4),
       st.tuples(*[st.integers(0, 5)] * 3))
def test_flow_is_the_best_of_all(words, quotas):
    quota = {s: q for s, q in zip("abc", quotas) if any(s in p for p in words)}
    flow = mixing.route(words, quota)
    for s, q in quota.items():
        assert sum(f.get(s, 0) for f in flow.values()) <= q
    given = {p: sum(f.values()) for p, f in flow.items()}
    assert all(0 <= n <= 2 * words[p] for p, n in given.items())
    cost = sum(min(max(n - k * words[p], 0), words[p]) * (k + 1) for p, n in given.items() for k in range(2))
    assert (sum(given.values()), cost) == best_flow(words, quota)


def test_many_sources_of_their_own_need_no_flow():
    words = {(f"s{i}",): 100 + i for i in range(20_000)}
    flow = mixing.route(words, {f"s{i}": 150.0 for i in range(20_000)})
    assert all(f == {p[0]: min(2 * words[p], 150)} for p, f in flow.items())


def taken(df, sources):
    rows, size, copies, sizes, target = mixing.mix(df, sources)
    return rows.select("doc_id", "source", F.col(size).alias("words"), F.col(copies).alias("times")).collect(), sizes, target


def test_edges(edge, clashing, empty):
    got, sizes, target = taken(edge, F.array("source"))
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"] or -1, r["words"]) for r in got) == sorted((i or -1, count(t)) for i, t, *_ in EDGE_ROWS)
    assert sizes == Counter({s: sum(count(t) for _, t, _, x, _ in EDGE_ROWS if x == s) for s in "abcd"}) | {None: 1}
    assert all(0 <= r["times"] <= 2 and (r["words"] or not r["times"]) for r in got)
    again, _, _ = taken(edge.repartition(2), F.array("source"))
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    out = mixing.mixed(clashing, F.array("source"))
    assert out.columns == clashing.columns
    assert out.count() == sum(r["times"] for r in got)
    assert taken(empty, F.array("source")) == ([], {}, {})
    assert mixing.mixed(empty, F.array("source")).count() == 0


def test_sources_come_near_their_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
                                    F.repeat(F.lit("w "), (F.xxhash64("id") % 40 + 41).cast("int")).alias("text"))
    got, sizes, target = taken(docs, F.array("source"))
    words = Counter()
    for r in got:
        words[r["source"]] += r["words"] * r["times"]
    for s, t in target.items():
        assert abs(words[s] - t) <= 0.005 * t and t <= 2 * sizes[s]


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a", "b"] if i % 2 else ["a"]) for i in range(400)] + [(400, "w", None), (401, "w", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    out, size, copies, sizes, target = mixing.mix(docs, F.col("sources"))
    assert sizes == {"a": 4000, "b": 2000}
    total = out.agg(F.sum(F.col(size) * F.col(copies))).first()[0]
    # The budget is 150% of the 4000 different words; b's share is drawn from the documents of both.
    assert abs(total - 6000) <= 10
    assert rows_of(out.filter("doc_id >= 400").select("doc_id", copies)) == [(400, 0), (401, 0)]


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op3_mix_sources(spark, sf).collect()
    sizes, taken_, longest = Counter(), Counter(), Counter()
    for r in got:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or ""))
        s = docs[r.doc_id].source
        assert r["size"] == n and r.taken in (0, n, 2 * n)
        sizes[s] += n
        taken_[s] += r.taken
        longest[s] = max(longest[s], n)
    target = mixing.fill_targets(dict(sizes))
    for r in got:
        s = docs[r.doc_id].source
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(abs(taken_[s] - target[s]) <= longest[s] for s in sizes)
