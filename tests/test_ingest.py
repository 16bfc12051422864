"""CSV ingest, upload log, exactly-once streams: cases that the fixtures don't show."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from vellum.operators import hooks as H
from vellum.operators import registry as R
from vellum.operators import schema as C
from vellum.session import scratch_path
from vellum.sources import ingest as I
from vellum.streaming import runs as ST

CLOCK = dt.datetime(2024, 2, 1, 9, 0, 0)


def csv(spark, name, text):
    path = scratch_path(spark, "csv").removeprefix("file:")
    os.makedirs(path)
    with open(f"{path}/{name}", "w", newline="") as f:
        f.write(text)
    return f"file:{path}/{name}"


def types(spark, text):
    return I.CsvSource(spark, csv(spark, "x.csv", text)).types


def test_types_look_at_every_row(spark):
    assert types(spark, "k,a\n" + "".join(f"{i},\n" for i in range(20_001)) + "1,2024-01-01 10:00:00\n") == {"k": "BIGINT", "a": "TIMESTAMP"}
    assert types(spark, "k,a\n" + "1,10:11:12\n" * 20_001 + "1,2024-01-01 10:00:00\n") == {"k": "BIGINT", "a": "VARCHAR"}
    assert types(spark, "a,b,c,d,e,f,g\n1,1.5,true,2024-01-02,2024-01-02T03:04:05.678,10:11,x\n,,,,,,\n") == {
        "a": "BIGINT", "b": "DOUBLE", "c": "BOOLEAN", "d": "DATE", "e": "TIMESTAMP", "f": "TIME", "g": "VARCHAR"}
    assert types(spark, "a,b,c\n1,x,99999999999999999999\n2.5,1,1\n") == {"a": "DOUBLE", "b": "VARCHAR", "c": "DOUBLE"}
    assert types(spark, "a,b\n") == {"a": "VARCHAR", "b": "VARCHAR"}


def test_quoted_breaks_and_doubled_quotes(spark):
    df, schema, _ = I.infer_csv(spark, csv(spark, "q.csv", 'id,t\n1,"two\nlines, and a comma"\n2,"he said ""no"""\n3," kept "\n'))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "two\nlines, and a comma"), (2, 'he said "no"'), (3, " kept ")]
    assert [r["type"] for r in schema.orderBy("ordinal").collect()] == ["BIGINT", "VARCHAR"]
    rows = [(1, 'a "b", c\nd'), (2, None), (3, ""), (4, "  x "), (5, "back\\slash")]
    path = I.export_rows(spark.createDataFrame(rows, "id int, t string"), scratch_path(spark, "out") + "/o.csv")
    # an empty cell is null, quoted or not
    assert sorted(tuple(r) for r in I.infer_csv(spark, path)[0].collect()) == [(i, t or None) for i, t in rows]


def test_ragged_rows_are_refused_with_their_number(spark):
    path = csv(spark, "r.csv", "id,b\n1,x\n2,y,EXTRA\n3\n")
    store = I.DatasetStore(spark, scratch_path(spark, "store"))
    rep = store.upload_csv("d", path, now=CLOCK)
    assert not rep["accepted"] and rep["errors"] == ["2 rows with too many or too few cells"]
    with pytest.raises(ValueError, match="2 rows"):
        I.infer_csv(spark, path)


def test_eleven_uploads_in_one_second_stay_in_order(spark):
    store = I.DatasetStore(spark, scratch_path(spark, "store"))
    for i in range(11):
        extra = "".join(f",c{j}" for j in range(i))
        rep = store.upload_csv("d", csv(spark, "u.csv", f"id{extra}\n{i}{',1' * i}\n"), now=CLOCK)
        assert rep["accepted"]
    assert rep["upload"] == "20240201_090000_11" and store.current_schema("d").count() == 11
    listed = [r["filename"] for r in I.dataset_history(spark, store.data_dir("d")).collect()]
    assert listed == ["20240201_090000"] + [f"20240201_090000_{n}" for n in range(2, 12)]
    assert I.dataset_history(spark, store.data_dir("d")).collect()[-1]["timestamp"] == "2024-02-01T09:00:00"


def test_uploads_that_are_not_logged_are_not_read(spark):
    store = I.DatasetStore(spark, scratch_path(spark, "store"))
    store.upload_csv("d", csv(spark, "a.csv", "id\n1\n"), now=CLOCK)
    spark.createDataFrame([(9,)], "id long").write.parquet(f"{store.data_dir('d')}/upload=20240201_090001")  # a write that died before its log
    assert [r["id"] for r in store.read_all("d").collect()] == [1]
    rep = store.upload_csv("d", csv(spark, "b.csv", "id\n2\n"), now=CLOCK + dt.timedelta(seconds=1))
    assert rep["upload"] == "20240201_090001"
    assert sorted(r["id"] for r in store.read_all("d").collect()) == [1, 2]


def test_a_damaged_file_raises(spark):
    store = I.DatasetStore(spark, scratch_path(spark, "store"))
    store.upload_csv("d", csv(spark, "a.csv", "id\n1\n"), now=CLOCK)
    spark.range(1).select(F.lit("junk").alias("v")).write.mode("append").text(f"{store.data_dir('d')}/upload=20240201_090000")
    with pytest.raises(Exception):
        store.read_all("d").collect()


def test_drift_lists_say_what_the_table_says(spark):
    old, new = {"a": "BIGINT", "b": "DOUBLE", "z": "DATE"}, {"a": "DOUBLE", "c": "VARCHAR", "b": "DOUBLE"}
    table = lambda s: spark.createDataFrame([(i, c, t, True) for i, (c, t) in enumerate(s.items())], C.SCHEMA_TABLE)
    v = C.drift_verdict(C.schema_drift(table(new), table(old))).first()
    assert C.drift_lists(new, old) == (v["errors"], v["warnings"])
    assert C.drift_lists(new, None) == ([], [])


def test_profile_samples_are_values(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "a int, b string")
    got = {r["column_name"]: r["samples"] for r in C.profile(df).collect()}
    assert set(got["a"]) <= {"1", "2", "3"} and set(got["b"]) <= {"x", "y"} and got["a"] and got["b"]


def test_page_after_walks_the_whole_listing(spark):
    rows = [(i, None if i % 7 == 0 else CLOCK + dt.timedelta(days=i % 5), False) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, created_at timestamp_ntz, is_deleted boolean")
    listing = [r["id"] for r in df.orderBy(*R.newest_first()).collect()]
    seen, last = [], df.orderBy(*R.newest_first()).first()
    seen.append(last["id"])
    while page := R.page_after(df, last["created_at"], last["id"], 9).collect():
        seen += [r["id"] for r in page]
        last = page[-1]
    assert seen == listing


# ------------------------------------------------------------- streams

def test_a_batch_that_runs_again_replaces_itself(spark):
    out = scratch_path(spark, "sink")
    sink = ST.epoch_sink(out)
    first, second = [spark.createDataFrame([(1, n)], "k int, n int") for n in (5, 7)]
    sink(first, 0)
    sink(second, 1)
    sink(second, 1)
    assert ST.read_result(spark, out, "append").count() == 2
    assert [tuple(r) for r in ST.read_result(spark, out, "update", ["k"]).collect()] == [(1, 7)]
    assert [tuple(r) for r in ST.read_result(spark, out, "complete").collect()] == [(1, 7)]


def test_a_stream_goes_on_from_its_checkpoint(spark):
    folder, out, ckpt = (scratch_path(spark, x) for x in ("in", "out", "ckpt"))
    rows = lambda a, b: spark.range(a, b).selectExpr("id", "id % 2 as run_id", "200 as status_code")
    rows(0, 10).write.parquet(folder)
    run = lambda: ST.run_to_table(ST.stream_progress(ST.file_stream(spark, folder, rows(0, 1).schema)), out, ckpt, "update")
    run()
    rows(10, 20).write.mode("append").parquet(folder)
    run()
    run()
    got = {r["run_id"]: r["processed"] for r in ST.read_result(spark, out, "update", ["run_id"]).collect()}
    assert got == {0: 10, 1: 10}


def test_stream_ingest_takes_each_source_once_and_reports_refused_names(spark):
    drop = scratch_path(spark, "drop")
    I.stage_csv(spark.range(20).repartition(3), f"{drop}/a.csv")
    spark.range(1).selectExpr("cast(id as string) v").write.text(f"{drop}/b.txt")
    store = I.DatasetStore(spark, scratch_path(spark, "store"))
    run = lambda ckpt, rep: ST.ingest_stream(spark, drop, store, "d", ckpt, rep, max_files=1)
    reports = scratch_path(spark, "reports")
    run(scratch_path(spark, "c1"), reports)
    run(scratch_path(spark, "c2"), reports)  # a checkpoint that was lost: every batch comes again
    assert sorted(tuple(r) for r in spark.read.parquet(reports).select("source", "accepted", "row_count").collect()) == [
        ("a.csv", True, 20), ("b.txt", False, None)]
    assert store.read_all("d").count() == 20


def test_retry_families_and_longest_delay(spark, monkeypatch):
    import pandas as pd

    def scorer(chunk, attempt):
        codes = {0: None, 1: "503", 2: "http 429", 3: "bad1503x"}
        return pd.DataFrame({"response": ["r"] * len(chunk), "error": [codes[i % 4] if attempt == 1 else None for i in chunk["id"]]})

    out = H.score_batches(spark.range(8), scorer, retry_on=("5xx",), base_delay=0.001, max_delay=0.002).collect()
    assert {r["id"] % 4: (r["status"], r["attempts"]) for r in out} == {
        0: ("ok", 1), 1: ("ok", 2), 2: ("dead_letter", 1), 3: ("dead_letter", 1)}


# ------------------------------------------------------------- late parts, files written again

def drop_and_store(spark):
    return scratch_path(spark, "drop"), I.DatasetStore(spark, scratch_path(spark, "store"))


def taken(spark, drop, store, ckpt, **more):
    reports = scratch_path(spark, "reports")
    ST.ingest_stream(spark, drop, store, "d", ckpt, reports, **more)
    try:
        return sorted((r["source"], r["accepted"], r["row_count"], len(r["warnings"])) for r in spark.read.schema(I.REPORT_SCHEMA).parquet(reports).collect())
    except Exception:  # noqa: BLE001 -- nothing was taken
        return []


def test_a_part_that_comes_later_is_stored(spark):
    drop, store = drop_and_store(spark)
    part = lambda a: spark.range(a, a + 100).selectExpr("id", "'x' as name")
    I.stage_csv(part(0).coalesce(1), f"{drop}/a.csv")
    ckpt = scratch_path(spark, "c")
    assert taken(spark, drop, store, ckpt) == [("a.csv", True, 100, 0)]
    part(100).coalesce(1).write.mode("append").option("header", True).csv(f"{drop}/a.csv")
    assert taken(spark, drop, store, ckpt) == [("a.csv", True, 100, 1)]  # reported as late
    assert sorted(r["id"] for r in store.read_all("d").collect()) == list(range(200))
    assert taken(spark, drop, store, ckpt) == []
    assert taken(spark, drop, store, scratch_path(spark, "lost")) == []  # nothing twice after a lost checkpoint


def test_a_file_of_the_same_name_on_another_day_is_stored(spark):
    drop, store = drop_and_store(spark)
    at = drop.removeprefix("file:")
    os.makedirs(at)
    ckpt = scratch_path(spark, "c")
    for day, body in enumerate(("1\n2\n", "3\n4\n5\n")):
        with open(f"{at}/a.csv", "w") as f:
            f.write("id\n" + body)
        os.utime(f"{at}/a.csv", (1_700_000_000 + 86_400 * day,) * 2)
        assert taken(spark, drop, store, ckpt)[0][:3] == ("a.csv", True, len(body) // 2)
    assert sorted(r["id"] for r in store.read_all("d").collect()) == [1, 2, 3, 4, 5]


def test_a_source_waits_until_it_settles(spark):
    drop, store = drop_and_store(spark)
    I.stage_csv(spark.range(3).coalesce(1), f"{drop}/a.csv")
    ckpt = scratch_path(spark, "c")
    assert taken(spark, drop, store, ckpt, settle="1 hour") == []
    assert taken(spark, drop, store, ckpt, settle="0 seconds") == [("a.csv", True, 3, 0)]


def test_a_refused_source_is_reported_once_and_again_when_it_changes(spark):
    drop, store = drop_and_store(spark)
    I.stage_csv(spark.range(3).coalesce(1), f"{drop}/a.csv")
    I.stage_csv(spark.range(3).selectExpr("id as other").coalesce(1), f"{drop}/b.csv")
    ckpt = scratch_path(spark, "c")
    assert [r[:2] for r in taken(spark, drop, store, ckpt)] == [("a.csv", True), ("b.csv", False)]
    assert taken(spark, drop, store, ckpt) == []
    I.stage_csv(spark.range(3, 5).coalesce(1), f"{drop}/b.csv")  # put right
    assert [r[:3] for r in taken(spark, drop, store, ckpt)] == [("b.csv", True, 2)]


def test_a_failure_before_the_log_loses_and_doubles_nothing(spark, monkeypatch):
    drop, store = drop_and_store(spark)
    I.stage_csv(spark.range(30).repartition(3), f"{drop}/a.csv")
    real = I.DatasetStore._upload

    def dies(self, *a, **k):
        raise RuntimeError("lost")

    monkeypatch.setattr(I.DatasetStore, "_upload", dies)
    with pytest.raises(RuntimeError):
        store.upload_new("d", drop)
    monkeypatch.setattr(I.DatasetStore, "_upload", real)
    assert [r["row_count"] for r in store.upload_new("d", drop)] == [30]
    assert store.upload_new("d", drop) == [] and store.read_all("d").count() == 30


def test_line_breaks_are_looked_for_in_every_line(spark):
    plain, broken = csv(spark, "a.csv", "a,b\n1,x\n2,\"y \"\"q\"\" z\"\n"), csv(spark, "b.csv", "a,b\n1,\"x\ny\"\n")
    assert not I.spans_lines(spark, plain) and I.spans_lines(spark, broken)
    assert [tuple(r) for r in I.CsvSource(spark, broken).typed().collect()] == [(1, "x\ny")]
    assert [tuple(r) for r in I.CsvSource(spark, plain).typed().collect()] == [(1, "x"), (2, 'y "q" z')]


# ------------------------------------------------------------- live progress

def progress(spark, asked, done, out, ckpt, **more):
    from vellum.streaming import progress as SP

    schema = "run_id long, row_id long, ts timestamp, status_code int"
    streams = [ST.file_stream(spark, f, spark.createDataFrame([], schema).schema, max_files=1) for f in (asked, done)]
    ST.run_to_table(SP.live_progress(*streams, **more), out, ckpt, "update")
    report = SP.progress_report(ST.read_result(spark, out, "update", ["run_id", "bucket"]))
    return {r["run_id"]: r for r in report.collect()}


def put(spark, folder, rows):
    spark.createDataFrame([(a, b, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), s) for a, b, m, s in rows],
                          "run_id long, row_id long, ts timestamp, status_code int").coalesce(1).write.mode("append").parquet(folder)


def test_progress_goes_on_after_a_restart_and_counts_a_row_once(spark):
    asked, done, out, ckpt = (scratch_path(spark, x) for x in ("asked", "done", "out", "ckpt"))
    put(spark, asked, [(1, i, 0, None) for i in range(10)] + [(None, i, 0, None) for i in range(2)])
    put(spark, done, [(1, i, 10 + i, 500 if i == 0 else 200) for i in range(4)] + [(1, 99, 5, 200)])  # 99 wasn't asked for
    got = progress(spark, asked, done, out, ckpt, buckets=3)
    assert (got[1]["expected"], got[1]["processed"], got[1]["failed"], got[1]["remaining"]) == (10, 4, 1, 6)
    assert got[1]["percent"] == 40.0 and got[1]["eta_seconds"] == pytest.approx(3 * 60 / 4 * 6)
    assert (got[None]["expected"], got[None]["processed"], got[None]["eta_seconds"]) == (2, 0, None)
    put(spark, done, [(1, 0, 20, 200), (1, 1, 21, 200), (1, 5, 25, 503)])  # 0 and 1 again; 0 is mended
    put(spark, asked, [(1, 10, 30, None), (1, 3, 30, None)])  # one more row, and one asked for again
    got = progress(spark, asked, done, out, ckpt, buckets=3)
    assert (got[1]["expected"], got[1]["processed"], got[1]["failed"], got[1]["remaining"]) == (11, 5, 1, 6)
    assert got[1]["eta_seconds"] == pytest.approx(15 * 60 / 5 * 6)


def test_a_silent_run_is_closed_and_late_rows_change_nothing(spark):
    asked, done, out, ckpt = (scratch_path(spark, x) for x in ("asked", "done", "out", "ckpt"))
    put(spark, asked, [(1, i, 0, None) for i in range(5)])
    put(spark, done, [(1, 0, 1, 200)])
    how = dict(buckets=1, watermark="3 days", idle="1 hour")
    progress(spark, asked, done, out, ckpt, **how)
    week = 7 * 24 * 60
    put(spark, asked, [(2, 0, week, None)])
    put(spark, done, [(2, 0, week, 200)])
    got = progress(spark, asked, done, out, ckpt, **how)
    assert got[1]["closed"] and not got[2]["closed"] and got[1]["processed"] == 1
    # within the watermark, but after the run was closed
    put(spark, asked, [(1, 7, week - 60, None)])
    put(spark, done, [(1, 1, week - 30, 200)])
    got = progress(spark, asked, done, out, ckpt, **how)
    assert (got[1]["expected"], got[1]["processed"], got[1]["late"]) == (5, 1, 2)
