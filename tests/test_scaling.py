"""Steps that were mended to grow with the input: same results, and the shape that makes them scale."""

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from vellum.operators import pipeline as P
from vellum.operators import scoring as SC
from vellum.operators import trigram as TG
from vellum.session import scratch_path
from vellum.sources import ingest as I
from vellum.sources.snapshots import BLOCK_BITS, SnapshotTable


def test_bloom_filters_are_words_and_miss_no_key(spark):
    table = SnapshotTable(spark, scratch_path(spark, "snap"), ["run_id", "row_id"])
    rows = spark.range(9000).select(F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("run_id"), F.when(F.col("id") % 9 > 0, F.col("id") * 3).alias("row_id"))
    table.append(rows.unionByName(rows.limit(50)).repartition(3))
    blooms = spark.read.parquet(f"{table.root}/blooms/*")
    assert dict(blooms.dtypes)["bits"] == "array<bigint>"
    assert {r[0] for r in blooms.select(F.size("bits")).distinct().collect()} == {BLOCK_BITS // 64}
    keys = rows.select("row_id").filter("row_id % 2 = 0").distinct()
    assert table.lookup(keys, "row_id").select("row_id").distinct().count() == keys.filter("row_id is not null").count()
    miss = spark.range(200).select((F.col("id") * 3 + 1).alias("k"))
    assert table.candidates(miss.limit(2), "row_id").count() < 3


RESPONSES = ['{"a":{"b":[{"c":"x"},{"c":null}]}}', '{"a":{"b":{"0":{"c":5}}}}', '{"a":{"b":[[1,2]]}}', '{"a":[]}', "no json", "", None, '"s"', '{"a":{"b":[{"c":{"d":1}}]}}',
             '[{"a":1}]', '{"0":{"0":true}}', '{"a":null}']


def test_outputs_are_those_of_the_single_paths_and_parsed_once(spark):
    df = spark.createDataFrame([(i, r, "kept") for i, r in enumerate(RESPONSES)], "id int, response string, _parsed string")
    paths = {"p": ["a", "b", "0", "c"], "q": ["a", "b", "1", "c"], "r": ["0", "0"], "s": ["a"], "t": "a", "u": ["0", "a"], "w": ["a", "b", "0", "1"]}
    got = P.output_mapping(df, "response", paths, keys=["id", "_parsed"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert P.output_mapping(df, "response", paths, keys=["id"])._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 1, plan
    want = df.select("id", "_parsed", *[P.extract_path(F.col("response"), p)[0].alias(n) for n, p in paths.items()])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_bucket_of_many_bytes_is_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(SC, "PART_BYTES", 2000)
    calls = lambda chunk, attempt: pd.DataFrame({"response": ["ok"] * len(chunk), "error": [None] * len(chunk)})
    log = SC.ScoreLog(spark, scratch_path(spark, "scores"), buckets=2)
    rows = spark.range(400).select(F.lit("r").alias("run_id"), F.col("id").alias("row_id"), F.repeat(F.lit("x"), 100).alias("text"))
    assert log.score(rows.filter("row_id < 100"), calls).count() == 100
    assert log.score(rows, calls).count() == 400 and log.remaining(rows).count() == 0
    stored = spark.read.parquet(f"{log.root}/scores")
    per = stored.groupBy(F.col("_metadata.file_path").alias("f")).count().agg(F.max("count"), F.count("*")).first()
    assert stored.count() == 400 and per[0] < 100 and per[1] > 8


def test_parts_of_buckets_do_not_meet_in_one_task(spark, monkeypatch):
    def calls(chunk, attempt):
        return pd.DataFrame({"response": [str(TaskContext.get().partitionId())] * len(chunk), "error": [None] * len(chunk)})

    monkeypatch.setattr(SC, "PART_BYTES", 3200)
    rows = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.lit("r")).alias("run_id"), F.col("id").alias("row_id"), F.repeat(F.lit("x"), 100).alias("text"))
    log = SC.ScoreLog(spark, scratch_path(spark, "scores"), buckets=8)
    assert log._parts(rows) == 3
    log.score(rows, calls)
    stored = spark.read.parquet(f"{log.root}/scores")
    assert stored.count() == 600 and stored.select("response").distinct().count() == 8 * 3
    assert stored.groupBy("response").agg(F.count_distinct("bucket").alias("n")).filter("n > 1").count() == 0


CELLS = ["1", " -7 ", "+", "1.5", ".5", "1e3", "123e-5", "9" * 18, "9" * 19, "-9223372036854775808", "NaN", "Infinity", "-Infinity", "2024-01-02", "2024-13-02", "2024-1-2",
         "2024-01-02 10:11", "2024-01-02T10:11:12.5", "2024-01-02 99:11", "10:11", "1:11:12", "10:1", "true", "FALSE", "False ", "fals", "", None, "x", " 1", "\t5", "é", "12345-6", "0000000000000000000001"]


def test_cells_are_of_the_kind_that_the_patterns_say(spark):
    c = F.col("c")
    tests = [(1, c.rlike(I.INTEGER_CELL) & c.try_cast("bigint").isNotNull()), (2, c.rlike(I.DOUBLE_CELL)), (4, c.rlike(I.DATE_CELL) & c.try_cast("date").isNotNull()),
             (8, c.rlike(I.STAMP_CELL) & c.try_cast("timestamp_ntz").isNotNull()), (16, c.rlike(I.TIME_CELL)), (32, c.rlike(I.BOOLEAN_CELL))]
    plain = F.when(c.isNull(), 0)
    for bit, test in tests:
        plain = plain.when(test, bit)
    df = spark.createDataFrame([(x,) for x in CELLS], "c string")
    assert df.filter(I.cell_kind(c) != plain.otherwise(I.OTHER_CELL)).collect() == []
    # dates and stamps, told by one character, don't pass the number patterns first
    assert list(I.CELL_KINDS)[:2] == ["date", "stamp"]


def test_texts_are_cut_into_trigrams_once(spark, monkeypatch):
    seen, real = [], TG.saved
    monkeypatch.setattr(TG, "saved", lambda df, name: seen.append(name) or real(df, name))
    df = spark.createDataFrame([(1, "abcd", None), (2, "ABC", "xyz"), (3, None, "ab")], "id long, a string, b string")
    index = TG.build(df, "id", ["a", "b"], scratch_path(spark, "tri"))
    assert seen == ["trigram-rows"]
    assert sorted(map(tuple, index.postings.collect())) == [("a", "abc", 1), ("a", "abc", 2), ("a", "bcd", 1), ("b", "xyz", 2)]
    assert "regexp_extract_all" not in index.postings._jdf.queryExecution().toString()
