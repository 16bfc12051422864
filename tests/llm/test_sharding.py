import zlib

from pyspark.sql import functions as F

from vellum.llm import sharding
from tests.llm.conftest import EDGE_ROWS


def jump(key: int, buckets: int) -> int:
    """The published loop."""
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def key_of(doc_id) -> int:
    import hashlib

    return int.from_bytes(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).digest()[:8], "big")


def test_published_values():
    # Known results of the published algorithm.
    assert [jump(k, n) for k, n in ((1, 1), (42, 57), (0xDEAD10CC, 1), (0xDEAD10CC, 666), (256, 1024))] == [0, 43, 0, 361, 520]


def test_matches_loop_for_few_and_many_shards(spark):
    ids = spark.range(300).select("id", *[sharding.jump_shard(F.col("id"), n).alias(f"s{n}") for n in (1, 2, 16, 17, 1000)])
    for r in ids.collect():
        for n in (1, 2, 16, 17, 1000):
            assert r[f"s{n}"] == jump(key_of(r["id"]), n)


def test_growth_moves_rows_only_into_the_new_shard(spark):
    moved = spark.range(3000).select(sharding.jump_shard(F.col("id"), 16).alias("a"), sharding.jump_shard(F.col("id"), 17).alias("b"))
    rows = moved.collect()
    assert all(r["a"] == r["b"] or r["b"] == 16 for r in rows)
    assert 0.03 < sum(r["b"] == 16 for r in rows) / len(rows) < 0.09


def test_exact_rest_of_the_loop(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_draws", lambda shards: 2)
    rows = spark.range(200).select("id", sharding.jump_shard(F.col("id"), 100).alias("s")).collect()
    assert all(r["s"] == jump(key_of(r["id"]), 100) for r in rows)


def check(rows, expected):
    assert len(rows) == len(expected)
    for r in rows:
        assert r["shard"] == jump(key_of(r["doc_id"]), 16) and r["grown_shard"] == jump(key_of(r["doc_id"]), 17)
    for shard in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    sizes = sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in rows)
    assert sizes == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in expected)


def test_edges(edge, clashing, empty):
    check(sharding.assign_shards(edge, "doc_id", "text", 16).collect(), EDGE_ROWS)
    check(sharding.assign_shards(clashing, "doc_id", "text", 16).collect(), EDGE_ROWS)
    assert sharding.assign_shards(empty, "doc_id", "text", 16).count() == 0


def test_many_equal_rows_share_a_shard_without_gaps(spark):
    same = spark.range(10_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.assign_shards(same, "doc_id", "text", 16)
    assert rows.agg(F.count("*"), F.countDistinct("slot"), F.max("slot")).first() == (10_000, 10_000, 9_999)
