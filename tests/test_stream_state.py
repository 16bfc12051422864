"""Keyed stream state: its keys don't grow with the number of runs, its figures are those of plain loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.session import scratch_path
from vellum.streaming import anomalies as SA
from vellum.streaming import progress as SP
from vellum.streaming import runs as ST

SCHEMA = "run_id string, row_id long, ts timestamp, status_code int"
RUNS = 200


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return ST.file_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, max_files=1)


def run_stream(spark, stream, mode):
    """The written table and the entries of the state: of several states, the least."""
    out = scratch_path(spark, "out")
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", scratch_path(spark, "ckpt"))
         .foreachBatch(ST.epoch_sink(out)).trigger(availableNow=True).start())
    q.awaitTermination()
    return out, min(s["numRowsTotal"] for s in q.lastProgress["stateOperators"])


def test_many_runs_of_progress_share_few_keys_of_state(spark):
    names = [*(f"r{i}" for i in range(RUNS)), "", None]
    at = dt.datetime(2024, 1, 1)
    asked = put(spark, scratch_path(spark, "asked"), [(r, k, at, None) for r in names for k in range(2)])
    done = put(spark, scratch_path(spark, "done"), [(r, 0, at, 500) for r in names])
    out, entries = run_stream(spark, SP.live_progress(asked, done, buckets=1, shards=4), "update")
    assert entries <= 30  # rows, sums and timers of four shards
    got = {r["run_id"]: (r["expected"], r["processed"], r["failed"]) for r in SP.progress_report(ST.read_result(spark, out, "update", ["run_id", "bucket"])).collect()}
    assert got == {r: (2, 1, 1) for r in names}


def test_many_runs_of_anomalies_share_few_keys_of_state(spark):
    rows = [(f"r{i}", k, dt.datetime(2024, 1, 1 + d), 500 if k < i % 3 and d == 3 else 200) for i in range(RUNS) for d in range(6) for k in range(3)]
    out, entries = run_stream(spark, SA.stream_anomalies(put(spark, scratch_path(spark, "in"), rows), shards=4), "append")
    assert entries <= 4
    closed = ST.read_result(spark, out, "append").filter(F.col("period") == "2024-01-04").collect()
    assert {r["run_id"]: round(r["failure_rate"], 6) for r in closed} == {f"r{i}": round(i % 3 / 3, 6) for i in range(RUNS)}


def test_z_scores_are_those_of_a_loop():
    rng = np.random.default_rng(7)
    of = np.sort(rng.integers(0, 5, 60))
    rates, trail, held = rng.random(60).round(2), np.zeros((5, 7)), np.zeros(5, np.int64)
    got = np.concatenate([SA.score_periods(of[at], rates[at], trail, held) for at in (np.arange(0, 60, 2), np.arange(1, 60, 2))])
    wanted, past = [], {}
    for i in [*range(0, 60, 2), *range(1, 60, 2)]:
        before = past.setdefault(of[i], [])
        spread = np.std(before, ddof=1) if len(before) > 1 else 0
        wanted.append((rates[i] - np.mean(before)) / spread if spread > 1e-9 else np.nan)
        past[of[i]] = [*before, rates[i]][-7:]
    assert got == pytest.approx(wanted, nan_ok=True)
