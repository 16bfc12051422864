import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from vellum.llm import exact_dedup
from tests.llm.conftest import EDGE_ROWS, rows_of


def norm(text):
    return (text or "").encode().lower().decode()


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    out, seen = [], set()
    for i, t, *_ in rows:
        ids = groups[norm(t)]
        keep = max((x for x in ids if x is not None), default=None)
        first = (i, norm(t)) not in seen
        seen.add((i, norm(t)))
        out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edges(edge, clashing, empty):
    expected = brute(EDGE_ROWS)
    assert rows_of(exact_dedup.exact_groups(edge, digest=True)) == expected
    assert rows_of(exact_dedup.exact_groups(clashing, digest=True)) == expected
    assert exact_dedup.exact_groups(empty, digest=True).count() == 0


def test_texts_that_differ_after_the_prefix_stay_apart(spark):
    head = "x" * 400
    rows = [(1, head + "a"), (2, head + "b"), (3, head + "A"), (4, head + "É"), (5, head + "é"), (6, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1), 5: (5, 1), 6: (6, 1)}


def test_drop_keeps_one_row_of_each_text(edge, clashing, empty):
    for docs in (edge, clashing):
        left = exact_dedup.drop_exact(docs)
        assert left.columns == docs.columns
        kept = left.select("doc_id", "text").collect()
        assert sorted(norm(t) for _, t in kept) == sorted({norm(t) for _, t, *_ in EDGE_ROWS})
        assert {i for i, t in kept if norm(t) == norm(EDGE_ROWS[0][1])} == {2}
    assert exact_dedup.drop_exact(empty).count() == 0


def test_hot_group(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    out = exact_dedup.exact_groups(docs)
    assert out.filter("kept").count() == 6001
    assert out.filter("keep_id = 8997 and group_size = 3000").count() == 3000
