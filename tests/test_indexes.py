"""Snapshots and compaction, point lookups, trigram search and mergeable sketches beside plain scans."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import metrics as M
from vellum.functions import scalar as S
from vellum.operators import sketches as K
from vellum.operators import trigram as TG
from vellum.session import scratch_path
from vellum.sources import snapshots as SN


def rows(spark, a, b):
    return spark.range(a, b).select((F.col("id") % 7).alias("run_id"), F.col("id").alias("row_id"), F.concat(F.lit("v"), "id").alias("text"))


@pytest.fixture
def table(spark):
    t = SN.SnapshotTable(spark, scratch_path(spark, "snap"), ["run_id", "row_id"])
    for k in range(3):
        t.append(rows(spark, 1000 * k, 1000 * k + 1000).repartition(4))
    return t


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_add_up_and_stay_readable(spark, table):
    assert table.versions() == [1, 2, 3]
    assert table.read(1).count() == 1000 and table.read().count() == 3000
    before = values(table.read())
    assert table.compact(target_bytes=1 << 20) == 4
    assert values(table.read()) == before and table.manifest().count() < table.manifest(3).count()
    assert values(table.read(3)) == before  # a reader of the old snapshot isn't disturbed
    assert table.compact(target_bytes=1 << 20) is None  # one file is left


def test_a_crash_between_data_and_manifest_changes_nothing(spark, table, monkeypatch):
    before = values(table.read())

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(SN.SnapshotTable, "_commit", dies)
    for act in (lambda: table.append(rows(spark, 9000, 9100)), lambda: table.compact(1 << 20)):
        with pytest.raises(RuntimeError):
            act()
    monkeypatch.undo()
    assert table.versions() == [1, 2, 3] and values(table.read()) == before
    table.append(rows(spark, 9000, 9100))
    assert table.read().count() == 3100


def test_two_writers(spark, table, monkeypatch):
    """One commits while the other is between its files and its manifest."""
    other = SN.SnapshotTable(spark, table.root, table.index)
    staged = SN.SnapshotTable._staged

    def slow(self, df):
        out = staged(self, df)
        if self is table:
            monkeypatch.undo()
            other.append(rows(spark, 7000, 7010))
        return out

    monkeypatch.setattr(SN.SnapshotTable, "_staged", slow)
    with pytest.raises(SN.SnapshotConflict):
        table.compact(1 << 20)
    assert table.read().count() == 3010  # nothing lost
    assert table.compact(1 << 20) == 5 and table.read().count() == 3010


def test_vacuum_keeps_what_kept_snapshots_name(spark, table):
    table.compact(1 << 20)
    assert table.vacuum(keep=2) == 0 and table.versions() == [3, 4]
    assert table.read(3).count() == 3000
    assert table.vacuum(keep=1) == 3 and table.versions() == [4]
    assert table.read().count() == 3000


def test_lookups_open_few_files_and_miss_no_row(spark, table):
    keys = spark.createDataFrame([(5,), (2500,), (None,), (10 ** 6,), (2500,)], "k long")
    assert values(table.lookup(keys, "row_id")) == [(1, 2500, "v2500"), (5, 5, "v5")]
    near = table.candidates(keys.select("k"), "row_id")
    assert 2 <= near.count() <= 4 < table.manifest().count()
    opened = {f for f in table.lookup(keys, "row_id").inputFiles() if "/data/" in f}
    assert len(opened) == near.count()
    every = spark.range(0, 3000, 13).toDF("k")
    assert table.lookup(every, "row_id").count() == every.count()
    assert table.candidates(spark.createDataFrame([], "k long"), "row_id").count() == 0


def test_many_keys_go_to_the_scan(spark, table, monkeypatch):
    monkeypatch.setattr(SN, "LOOKUP_KEYS", 10)
    monkeypatch.setattr(SN.SnapshotTable, "candidates", lambda *_: pytest.fail("probed"))
    assert table.lookup(spark.range(100).toDF("k"), "row_id").count() == 100


def test_clustered_files_have_narrow_ranges_of_both_columns(spark):
    t = SN.SnapshotTable(spark, scratch_path(spark, "snap"), ["a", "b"])
    df = spark.range(20_000).select((F.xxhash64("id") % 1000).alias("a"), (F.xxhash64("id", F.lit(1)) % 1000).alias("b"))
    for k in range(2):
        t.append(df.filter(F.col("a") % 2 == k).repartition(8))
    size = t.manifest().agg(F.sum("bytes")).first()[0]
    t.compact(target_bytes=size // 16, small=100)
    spans = t.manifest().select(*[(F.col(f"max_{c}") - F.col(f"min_{c}")).alias(c) for c in "ab"]).agg(F.avg("a"), F.avg("b"), F.count("*")).first()
    assert spans[2] >= 8 and spans[0] < 1400 and spans[1] < 1400  # of about 2000: cut along both


def test_new_columns_are_null_in_older_files(spark, table):
    table.append(rows(spark, 5000, 5010).withColumn("more", F.lit(1)))
    got = table.read()
    assert got.columns[-1] == "more" and got.filter("more = 1").count() == 10 and got.count() == 3010


# ------------------------------------------------------------- trigrams

NAMES = ["Customer#01", "customer#011", "CUSTOMER", None, "", "ab", "tom", "a%b_c\\d", "Straße", "STRASSE", "ÉTÉ", "été là", "😀😀 smile", "xx tom xx", "İstanbul"]


@pytest.fixture(scope="module")
def named(spark):
    df = spark.createDataFrame([(i, n, (n or "")[::-1] or None) for i, n in enumerate(NAMES)], "id long, name string, description string")
    return df, TG.build(df, "id", ["name", "description"], scratch_path(spark, "tri"), file_postings=10)


@pytest.mark.parametrize("keyword", ["tom", "TOM", "customer#01", "a%b", "b_c", "\\d", "to", "", "straße", "STRASSE", "été", "😀😀", "smile", "zzz", "stanbul", "İst", "mot"])
def test_trigram_search_is_the_scan(named, keyword):
    df, index = named
    scan = df.filter(F.coalesce(S.ilike("name", f"%{keyword}%"), F.lit(False)) | F.coalesce(S.ilike("description", f"%{keyword}%"), F.lit(False)))
    assert values(TG.search(df, index, keyword).select("id")) == values(scan.select("id"))


def test_many_keywords_and_hot_trigrams(spark):
    texts = [f"the quick {w} number {i}" for i, w in enumerate(["fox", "dog", "cat"] * 200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    index = TG.build(df, "id", ["text"], scratch_path(spark, "tri"), file_postings=500)
    hot = index.postings.filter("gram = 'the'")
    assert hot.select(F.input_file_name()).distinct().count() > 1  # split
    words = spark.createDataFrame([("quick fox",), ("number 17",), ("dog",), ("at",), ("no such",), (None,), ("DOG",), ("%um",)], "keyword string")
    got = values(TG.search_many(df, index, words, columns=["text"]))
    assert got == sorted((w, i) for w in ("quick fox", "number 17", "dog", "DOG") for i, t in enumerate(texts) if w.lower() in t)


# ------------------------------------------------------------- sketches

def test_ranges_of_days_within_the_rank_error(spark):
    rng = random.Random(3)
    data = [(r % 3, f"2024-01-{1 + r % 20:02d} 10:00:00", 500 if r % 9 == 0 else 200, rng.expovariate(0.01)) for r in range(30_000)]
    df = spark.createDataFrame(data, "run_id long, ts string, status_code int, response_time_ms double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    figures = K.day_figures(df)
    assert figures.count() == 60
    for first, last in (("2024-01-03", "2024-01-11"), (None, None)):
        part = df.filter((F.col("ts") >= (first or "2000-01-01")) & (F.col("ts") < (last or "2100-01-01")))
        s = K.range_summary(figures, first, last)
        assert {r["run_id"]: r["rows"] for r in s.collect()} == {r["run_id"]: r["count"] for r in part.groupBy("run_id").count().collect()}
        for q, c in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
            assert K.rank_errors(part, s, q, c).agg(F.max("rank_error")).first()[0] <= 0.02


def test_summaries_of_nulls(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", 200, None), (None, "2024-01-01 00:00:00", 500, 2.0)],
                               "run_id long, ts string, status_code int, response_time_ms double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r["run_id"]: (r["rows"], r["failed"], r["mean"], r["p95"]) for r in K.range_summary(K.day_figures(df)).collect()}
    assert got == {1: (1, 0, None, None), None: (1, 1, 2.0, 2.0)}


def test_profiles_of_uploads_merge(spark):
    df = spark.range(40_000).select(F.concat(F.lit("u"), F.col("id") % 4).alias("upload"), F.col("id").alias("k"), (F.col("id") % 50).alias("few"),
                                    F.when(F.col("id") % 2 == 0, F.lit("x")).alias("half"))
    profiles = K.upload_profiles(df)
    assert profiles.count() == 12
    got = {r["column_name"]: r for r in K.merged_profile(profiles, ["k", "few"]).collect()}
    assert got["few"]["distinct_values"] == 50 and got["half"]["distinct_values"] == 1 and got["half"]["non_null"] == 20_000
    assert abs(got["k"]["distinct_values"] - 40_000) < 0.03 * 40_000
    assert (float(got["k"]["least"]), float(got["k"]["greatest"])) == (0, 39_999)
    over = {r["column_name"]: r for r in K.value_overlap(profiles, "u0", "u2").collect()}
    assert over["few"]["values_common"] == 25 and over["few"]["known_share"] == 1.0
    assert over["k"]["values_common"] <= 200 and over["k"]["values_both"] == pytest.approx(20_000, rel=0.03)


# ------------------------------------------------------------- metrics with nulls, in one pass a family

def test_nulls_in_labels_and_values(spark):
    labels = spark.createDataFrame([("a", "a"), (None, "a"), ("b", None)], "y_true string, y_pred string")
    assert M.accuracy(labels).first()["accuracy"] == pytest.approx(1 / 3)
    vals = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0), (None, 9.0), (100.0, None)], "y_true double, y_pred double")
    got = M.regression_metrics(vals).first()
    assert got["n"] == 3 and got["r2"] == pytest.approx(1 - 2 / 8)
    none = spark.createDataFrame([(1, None, 2.0)], "run_id int, y_true double, y_pred double")
    assert [tuple(r) for r in M.regression_metrics(none, group="run_id").collect()] == [(1, 0, None, None, None, None, None)]


def test_null_runs_and_queries_count(spark):
    rank = spark.createDataFrame([(None, None, 1, 0.9, 2), (None, None, 2, 0.1, 0), (1, 5, 3, 0.5, 0), (1, 5, 4, 0.4, 2)],
                                 "run_id long, query_id long, item_id long, score double, grade int")
    got = {(r["run_id"], r["metric_name"]): r["metric_value"] for r in M.run_metrics(rank, ["mrr", "ndcg"], "run_id").collect()}
    assert got[None, "mrr"] == 1.0 and got[1, "mrr"] == 0.5 and got[None, "ndcg"] == 1.0 and len(got) == 4


def test_a_family_takes_one_pass(spark, sf_small):
    import contextlib
    import io

    src = spark.read.parquet(f"{sf_small}/lineitem.parquet").select(F.col("l_linenumber").alias("run_id"), F.col("l_quantity").alias("y_true"), F.col("l_tax").alias("y_pred"))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        M.run_metrics(src, ["mae", "mse", "rmse", "r2", "mape"], "run_id").explain()
    assert buf.getvalue().count("FileScan") == 1
