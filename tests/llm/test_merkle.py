import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGE_ROWS, rows_of
from vellum.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(nodes, fanout=3):
    """Levels from the nodes up to the one over them."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i:i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def path(levels, at, fanout=3):
    for nodes in levels[:-1]:
        first = at - at % fanout
        yield nodes[first:at], nodes[at + 1:first + fanout]
        at //= fanout


def brute(rows, fanout=3):
    """rows: (doc_id, text, lang, source, n_chars)."""
    by = {}
    for i, text, lang, source, n in rows:
        own = leaf_of([i, source, lang, n, text])
        even = zlib.crc32(str("" if i is None else i).encode()) % 2 == 0
        trial = leaf_of([i, source, lang, n, text.replace("\n", "") if even and text is not None else text])
        by.setdefault(source, []).append((i is not None, i or 0, own, trial, i))
    trees, order = {}, sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: x[:4])
        trees[s] = tree([x[2] for x in by[s]], fanout)
    top = tree([trees[s][-1][0] for s in order], fanout)
    out = []
    for k, s in enumerate(order):
        for at, (_, _, own, trial, i) in enumerate(by[s]):
            ways = [*path(trees[s], at, fanout), *path(top, k, fanout)]
            fold = trial
            for left, right in ways:
                fold = h([*left, fold, *right])
            out.append((s, i, own, trees[s][-1][0], top[-1][0], tuple(x for way in ways for side in way for x in side), fold))
    return sorted(out, key=repr)


def made(docs, **more):
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    trial = [*map(F.col, FIELDS[:-1]), F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))]
    out = merkle.manifest(docs, FIELDS, trial, **more)
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in out.collect()), key=repr)


def test_edges(edge, clashing, empty):
    expected = brute(EDGE_ROWS)
    assert made(edge) == expected and made(clashing) == expected
    assert made(empty) == []


@pytest.mark.parametrize("fanout, levels", [(3, 1), (2, 1), (3, 0), (4, 2)])
def test_small_blocks_take_many_rounds(spark, fanout, levels):
    # sources of 1 to 83 rows: blocks whose last subtree is short at every digit
    rows = [(s * 1000 + i, f"text {i}\nof {s}", "en", f"s{s}", i) for s, n in enumerate((1, 2, 3, 4, 9, 10, 28, 55, 83)) for i in range(n)]
    rows += [(None, "no id", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert made(docs, fanout=fanout, levels=levels) == brute(rows, fanout)


def test_one_row_is_its_own_root(spark):
    docs = spark.createDataFrame([(5, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    (source, doc_id, own, subroot, root, proof, fold), = made(docs)
    assert own == subroot == root == fold == leaf_of([5, "s", "en", 1, "a"]) and proof == ()


def test_rows_beyond_one_block(spark):
    docs = spark.range(2500).select(F.col("id").alias("doc_id"), F.concat(F.lit("line\n"), "id").alias("text"), F.lit("en").alias("lang"),
                                    F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"), F.col("id").alias("n_chars"))
    assert made(docs) == brute([tuple(r) for r in docs.collect()])


def test_no_trial_folds_to_the_root(edge):
    out = merkle.manifest(edge, FIELDS).select("root", "folded_root").distinct().collect()
    assert len(out) == 1 and out[0].root == out[0].folded_root
    assert rows_of(merkle.manifest(edge, FIELDS).select("leaf")) == sorted(((r[2],) for r in brute(EDGE_ROWS)), key=repr)
