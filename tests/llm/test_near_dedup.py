import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import near_dedup
from vellum.llm.queries import op5_minhash_near_dedup
from tests.llm.conftest import EDGE_ROWS, rows_of

words_of = re.compile(r"[^\x20\x09-\x0D]+").findall


def shingle_set(text, n):
    w = words_of((text or "").encode().lower().decode())
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows, n, threshold):
    """(id, set size, smallest id reached, kept), all pairs."""
    sets = [shingle_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_gram = {}
    for i, s in enumerate(sets):
        for g in s:
            by_gram.setdefault(g, []).append(i)
    for i, j in {p for m in by_gram.values() for p in combinations(m, 2)}:
        both = len(sets[i] & sets[j])
        if 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    out = [(d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]
    return sorted(((d, n_, c, d == c) for d, n_, c in out), key=repr)


def test_edges(edge, clashing, empty):
    expected = brute([r[:2] for r in EDGE_ROWS], 3, 85)
    assert rows_of(near_dedup.near_components(edge, words=3, threshold=85)) == expected
    left = near_dedup.drop_near(clashing, words=3, threshold=85)
    assert left.columns == clashing.columns
    assert sorted((r[0] for r in left.collect()), key=repr) == sorted((r[0] for r in expected if r[3]), key=repr)
    assert near_dedup.near_components(empty).count() == 0
    assert near_dedup.drop_near(empty).count() == 0


def test_groups_of_near_copies(spark):
    """A large group around one text, chains, and texts that only share a part."""
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, base = [], fresh(80)
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randrange(7)):
            t[rng.randrange(len(t))] = fresh(1)[0]
        rows.append(t)
    for _ in range(20):
        t = fresh(60)
        for _ in range(4):
            rows.append(t)
            t = t[:-1] + fresh(1) if rng.random() < 0.5 else t + fresh(2)
    rows += [base[:40] + fresh(40) for _ in range(40)]
    rng.shuffle(rows)
    docs = [(i, " ".join(t)) for i, t in enumerate(rows)]
    got = rows_of(near_dedup.near_components(spark.createDataFrame(docs, "doc_id long, text string"), words=3, threshold=85))
    expected = brute(docs, 3, 85)
    assert [r[:2] for r in got] == [r[:2] for r in expected]
    # Candidates are found by hashing; nearly every component is whole, none is too large.
    assert sum(a != b for a, b in zip(got, expected)) <= 2


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(op5_minhash_near_dedup(spark, sf)) == brute(docs, 3, 85)


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    every = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    one, two = every[:2000], every[1000:]
    low = near_dedup._minhashes([one, two], 600, 5)
    assert (low[0] == low[1]).mean() == pytest.approx(1 / 3, abs=0.06)


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    got = near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()
    roots = {r["node"]: r["root"] for r in got}
    assert len({roots[i] for i in range(41)}) == 1
    assert len({roots[i] for i in range(100, 160)}) == 1
    assert roots[200] == roots[201] and len(set(roots.values())) == 3
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def linked(spark, texts, buckets, threshold=85):
    """Roots that a linker gives the texts, numbered in order, in these buckets."""
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    signed = near_dedup.signatures(docs, "text", 1, near_dedup.WIDTH, near_dedup.ROWS, near_dedup.SEED)
    nodes = near_dedup.saved(signed.select("node", "more", "minhashes"), "test-nodes")
    sets = [near_dedup.shingles(t, 1) for t in texts]
    full = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, shingles binary")
    rows = spark.createDataFrame([(k, i) for k, b in enumerate(buckets) for i in b], "key long, node long")
    n = (2 * near_dedup.ROWS + near_dedup.MORE) * near_dedup.WIDTH
    return {r["node"]: r["root"] for r in near_dedup._Linker(nodes, full, rows, threshold, n).labels().collect()}


def test_all_links_of_a_large_bucket(spark):
    """Outlying pairs, chains that drift away, and a second centre, in one bucket
    where nearly nobody links to its pivot."""
    rng = random.Random(9)
    names = iter(f"n{i}" for i in range(10**6))
    base, texts = [f"b{i}" for i in range(100)], []

    def edited(t, n, new=True):
        t = list(t)
        for at in rng.sample(range(len(t)), n):
            t[at] = next(names) if new else None
        return [w for w in t if w]

    texts += [edited(base, rng.randrange(4)) for _ in range(30)]
    for _ in range(40):
        one = edited(base, rng.randrange(14, 24), rng.random() < 0.5)
        texts += [one, edited(one, 3)]
    step = base
    for _ in range(30):
        step = edited(step, 5)
        texts.append(step)
    second = edited(base, 20)
    texts += [edited(second, rng.randrange(9)) for _ in range(60)]
    texts += [edited(base, rng.randrange(9, 15), False) for _ in range(60)]
    texts = list(dict.fromkeys(" ".join(t) for t in texts))
    rng.shuffle(texts)
    # as many buckets as a link shares tables, on average, at the threshold
    got = linked(spark, texts, [range(len(texts))] * 30)
    expected = {i: c for i, _, c, _ in brute(list(enumerate(texts)), 1, 85)}
    same = [(i, c) for i, c in expected.items() if i != c]
    assert sum(got[i] == got[c] for i, c in same) >= 0.97 * len(same)
    assert all(expected[i] == expected[r] for i, r in got.items())


def test_null_ids_link(spark):
    """A null id's text that alone connects two others, and a near copy without an id."""
    word = lambda name, n: [f"{name}{i}" for i in range(n)]
    base, other = word("a", 60), word("z", 60)
    texts = [(1, base), (None, base + word("b", 8)), (2, base + word("b", 16)), (7, other), (None, other + ["end"]), (None, word("q", 9))]
    docs = [(i, " ".join(t)) for i, t in texts]
    expected = brute(docs, 3, 85)
    assert (2, 74, 1, False) in expected
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(near_dedup.near_components(table, words=3, threshold=85)) == expected
    left = near_dedup.drop_near(table, words=3, threshold=85).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == sorted([(0, docs[5][1]), (1, docs[0][1]), (7, docs[3][1])])


def test_odd_nodes_meet_others_once(spark):
    """Many keys that hold the same nodes: a row per key and node, and each pair once."""
    roots = {i: 0 if i < 30 else i for i in range(40)}
    rest = spark.createDataFrame([(k, i, k, roots[i]) for k in range(50) for i in roots], "key long, node long, origin long, root long")
    linker = near_dedup._Linker(None, None, None, 85, 102)
    odd = linker._odd(rest)
    assert odd.count() == 50
    assert {tuple(sorted(o["node"] for o in r["odd"])) for r in odd.collect()} == {tuple(range(30, 40))}
    met = [tuple(r) for r in linker._to_odd(rest, odd).collect()]
    assert sorted(met) == sorted((i, o) for i in roots for o in range(30, 40) if roots[i] != roots[o])


def test_a_task_leaves_no_words_behind(spark):
    """Words that a task remembers go when it ends: its worker lives on in later stages."""
    docs = spark.createDataFrame([(i, f"w{i} x{i} y{i}") for i in range(300)], "doc_id long, text string").coalesce(1)
    assert near_dedup.signatures(docs, "text", 3, 3, 9, 1).count() == 300

    def held(batches):
        for b in batches:
            yield b.slice(0, 1).set_column(0, "n", near_dedup.pa.array([len(near_dedup._known)]))

    # the same worker, idle since the first count, is taken again
    near_dedup.signatures(docs, "text", 3, 3, 9, 1).collect()
    rows = docs.select("doc_id").mapInArrow(held, "n long").collect()
    assert {r["n"] for r in rows} == {0}


def test_linked_nodes_only_go_on_where_they_meet_others(spark):
    """Of a component's thirty nodes only the one that agrees with an odd node, and both odd nodes."""
    more = [[100 + i] * near_dedup.MORE for i in range(30)] + [[103] * near_dedup.MORE, [999] * near_dedup.MORE]
    nodes = near_dedup.saved(spark.createDataFrame(list(enumerate(more)), "node long, more array<long>"), "test-nodes")
    rows = near_dedup.saved(spark.createDataFrame([(1, i, 1, 0 if i < 30 else i, 0) for i in range(32)],
                                                  "key long, node long, origin long, root long, main long"), "test-rest")
    out = [(r["node"], r["key"], r["apart"]) for r in near_dedup._Linker(nodes, None, None, 85, 102)._split(rows, 0).collect()]
    assert sorted((n, a) for n, _, a in out) == sorted((n, n >= 30) for n in (3, 30, 31) for _ in range(near_dedup.SPLITS))
    assert len({k for n, k, _ in out if n in (3, 30)}) == near_dedup.SPLITS


def outlying(n, words=40):
    """Texts that are far from each other but for a third of their words."""
    base = [f"b{i}" for i in range(words)]
    return [" ".join([*base, *(f"n{k}x{i}" for i in range(2 * words))]) for k in range(n)]


def test_a_crowd_meets_in_blocks(spark, monkeypatch):
    """A large mixed bucket goes on as a row per node and block of nodes, not as a row per pair, and loses no link."""
    texts = outlying(300)
    texts += [" ".join(t.split()[:-5] + ["other"]) for t in texts[:20]]
    met = []
    compared = near_dedup._Linker._compared

    def counted(self, near, hubs):
        met.append(near.select(F.explode("blocks")).count())
        return compared(self, near, hubs)

    monkeypatch.setattr(near_dedup._Linker, "_compared", counted)
    got = linked(spark, texts, [range(320)] * 2)
    assert all(got[300 + i] == got[i] for i in range(20)) and len(set(got.values())) == 300
    # two stars, and the crowd's nodes with a few blocks each; there are 51 000 pairs
    assert sum(met) <= 4 * 320


def test_huge_mixed_buckets_are_banded_again(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CROWD", 30)
    texts = outlying(60)
    texts += [" ".join(t.split()[:-5] + ["other"]) for t in texts[:20]]
    got = linked(spark, texts, [range(80)] * 12)
    assert sum(got[60 + i] == got[i] for i in range(20)) >= 19 and len(set(got.values())) <= 61


def test_a_cell_gives_links_that_join_all_that_are_linked():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64))
    sets = [np.unique(np.append(rng.choice(base, 100 - k % 12, replace=False), rng.integers(0, 1 << 63, k % 7, dtype=np.uint64))) for k in range(60)]
    table = lambda at: near_dedup.pa.table({"node": near_dedup.pa.array(at, near_dedup.pa.int64()), "shingles": [sets[i].tobytes() for i in at]})
    alike = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))

    def groups(links):
        root = list(range(60))
        for a, b in links:
            root = [root[a] if r == root[b] else r for r in root]
        return {frozenset(i for i in range(60) if root[i] == r) for r in root}

    left, right = list(range(60)), list(range(0, 60, 2))
    made = [tuple(r.values()) for r in near_dedup._linked(85)(table(left), table(right)).to_pylist()]
    assert all(alike(a, b) and a != b for a, b in made)
    assert groups(made) == groups([(a, b) for a in left for b in right if a != b and alike(a, b)])
    assert len(made) < 60 + 30
    assert near_dedup._linked(85)(table([]), table(right)).num_rows == near_dedup._linked(85)(table(left), table([])).num_rows == 0


@pytest.mark.parametrize("threshold, cut", [(85, 8), (80, 11)])
def test_a_huge_bucket_loses_no_link(spark, monkeypatch, threshold, cut):
    """Links just over the threshold that share a single, huge bucket: many agree in no further collection of minhashes."""
    monkeypatch.setattr(near_dedup, "CROWD", 30)
    texts = outlying(100, 20)
    texts += [" ".join([*t.split()[:-cut], "other"]) for t in texts[:80]]
    expected = brute(list(enumerate(texts)), 1, threshold)
    assert sum(not kept for *_, kept in expected) == 80
    got = linked(spark, texts, [range(180)], threshold)
    assert all(got[i] == got[c] for i, _, c, _ in expected) and len(set(got.values())) == 100


def test_a_huge_bucket_meets_by_prefixes(spark, monkeypatch):
    """Nodes of a huge bucket without a link only meet blocks where a prefix of theirs has a shingle in common."""
    monkeypatch.setattr(near_dedup, "CROWD", 30)
    met = []
    compared = near_dedup._Linker._compared

    def counted(self, near, hubs):
        met.append(near.select(F.explode("blocks")).count())
        return compared(self, near, hubs)

    texts = outlying(300)
    texts += [" ".join([*t.split()[:-5], "other"]) for t in texts[:20]]
    rest = spark.createDataFrame([(1, i, i) for i in range(320)], "key long, node long, root long")
    sets = spark.createDataFrame([(i, bytearray(near_dedup.shingles(t, 1).tobytes())) for i, t in enumerate(texts)], "node long, shingles binary")
    monkeypatch.setattr(near_dedup._Linker, "_compared", counted)
    links = near_dedup._Linker(None, sets, None, 85)._huge(rest).collect()
    assert {tuple(sorted(r)) for r in links} == {(i, 300 + i) for i in range(20)}
    # the twenty links' ends, each with its own block and the other's, and few others; all with all are 320 * 16
    assert sum(met) <= 200


@pytest.mark.parametrize("threshold", [80, 85, 100])
def test_links_share_a_shingle_of_their_prefixes(spark, threshold):
    rng = np.random.default_rng(threshold)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(np.append(rng.choice(base, n, replace=False), rng.integers(0, 1 << 63, k % 5, dtype=np.uint64)))
            for k, n in enumerate(rng.integers(1, 61, 150))]
    table = near_dedup.saved(spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, shingles binary"), "test-sets")
    counts = near_dedup._counts(table)
    assert counts.sum() == sum(map(len, sets))
    prefix = {}
    for r in near_dedup._prefixes(table, counts, threshold).collect():
        prefix.setdefault(r["node"], set()).add(r["token"])
    links = [(i, j) for i, j in combinations(range(150), 2)
             if 100 * len(np.intersect1d(sets[i], sets[j])) >= threshold * len(np.union1d(sets[i], sets[j]))]
    assert all(prefix[i] & prefix[j] for i, j in links) and (threshold == 100 or len(links) > 20)
