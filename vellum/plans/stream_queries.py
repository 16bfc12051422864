"""Streaming queries (ST1-ST5), each run with ``availableNow`` over a stream
folder written from ``run_outputs`` (ts as TIMESTAMP, several files), and
checked against the batch SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.plans.fixtures import Fixtures, with_fixtures
from vellum.session import scratch_path
from vellum.sources import ingest as I
from vellum.streaming import anomalies as SA
from vellum.streaming import progress as SP
from vellum.streaming import runs as ST
from vellum.streaming.tables import EpochTable, run_to_keyed_table

Q: dict = {}
O: dict[str, str] = {}


def query(name, sql=None, fixtures=()):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            O[name] = with_fixtures(sql, *fixtures)
        return fn
    return deco


def _stream_rows(fx: Fixtures):
    return fx.run_outputs.drop("payload").withColumn("ts", F.col("ts").cast("timestamp"))


# Part files of a slice; a micro-batch takes one slice.
FILES_PER_SLICE = 2


def write_stream_folder(fx: Fixtures, copies: int = 1, late: bool = False) -> str:
    """Rows arrive in event-time order: one append per 4-day slice, so file
    modification times follow event time.  A second copy models a re-run
    that sends every row again."""
    folder = scratch_path(fx.spark, "stream-in")
    rows = _stream_rows(fx).withColumn("_slice", F.floor((F.dayofmonth("ts") - 1) / 4))
    n_slices = 8
    for _ in range(copies):
        for k in range(n_slices):
            _slice(rows, k).write.mode("append").parquet(folder)
    if late:  # the first slice once more, long after its time
        _slice(rows, 0).write.mode("append").parquet(folder)
    return folder


def _slice(rows, k: int):
    return rows.filter(F.col("_slice") == k).drop("_slice").repartition(FILES_PER_SLICE)


def _run(fx: Fixtures, build, mode: str, copies: int = 1, transform=None, keys=(), late: bool = False):
    spark = fx.spark
    folder = write_stream_folder(fx, copies, late)
    src = ST.file_stream(spark, folder, _stream_rows(fx).schema, max_files=FILES_PER_SLICE)
    out = ST.run_to_table(build(src), scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt"),
                          mode, transform)
    return ST.read_result(spark, out, mode, list(keys))


@query("stream_progress", """
select run_id, count(*) as processed, count(*) filter (where status_code >= 400) as failed from run_outputs group by run_id
""", ["run_outputs"])
def stream_progress(fx: Fixtures):
    return _run(fx, ST.stream_progress, "update", keys=["run_id"])


PROGRESS_AS_OF = "2024-01-20 00:00:00"


@query("stream_live_progress", f"""
with d as (select run_id, row_id, min(ts) as ts, arg_max(status_code, ts) as status_code from run_outputs where ts < timestamp '{PROGRESS_AS_OF}' group by all),
j as (select i.run_id, i.row_id, d.ts, d.status_code from (select distinct run_id, row_id from run_outputs) i left join d using (run_id, row_id))
select run_id, count(*) as expected, count(ts) as processed, count(*) filter (where status_code >= 400) as failed,
 count(*) - count(ts) as remaining, round(100.0 * count(ts) / count(*), 6) as percent,
 round(case when count(ts) > 0 then date_diff('microsecond', min(ts), timestamp '{PROGRESS_AS_OF}') / 1e6 / count(ts) * (count(*) - count(ts)) end, 3) as eta_seconds
from j group by run_id
""", ["run_outputs"])
def stream_live_progress(fx: Fixtures):
    """Two streams, of rows asked for and of outputs; the second has come as far as ``PROGRESS_AS_OF`` and sends each slice twice."""
    spark = fx.spark
    asked, done = write_stream_folder(fx), write_stream_folder(fx, copies=2)
    schema = _stream_rows(fx).schema
    inputs = ST.file_stream(spark, asked, schema, max_files=FILES_PER_SLICE)
    outputs = ST.file_stream(spark, done, schema, max_files=FILES_PER_SLICE).filter(F.col("ts") < F.lit(PROGRESS_AS_OF).cast("timestamp"))
    out = ST.run_to_table(SP.live_progress(inputs, outputs, buckets=4, watermark="60 days"), scratch_path(spark, "progress-out"),
                          scratch_path(spark, "progress-ckpt"), "update")
    report = SP.progress_report(ST.read_result(spark, out, "update", ["run_id", "bucket"]), PROGRESS_AS_OF)
    return report.select("run_id", "expected", "processed", "failed", "remaining", F.round("percent", 6).alias("percent"),
                         F.round("eta_seconds", 3).alias("eta_seconds"))


def _fmt(df):
    return df.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                     F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"),
                     "requests", "failures",
                     # the mean times the count: exact 2-decimal totals compare without rounding ties
                     F.round(F.col("mean_response_ms") * F.col("requests"), 2).alias("total_response_ms"))


@query("stream_throughput", """
select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start,
 strftime(date_trunc('day', ts) + interval 1 day, '%Y-%m-%d %H:%M:%S') as window_end,
 count(*) as requests, count(*) filter (where status_code >= 400) as failures, round(sum(response_time_ms), 2) as total_response_ms
from run_outputs group by 1, 2
""", ["run_outputs"])
def stream_throughput(fx: Fixtures):
    return _fmt(_run(fx, lambda s: ST.stream_throughput(s, "1 day"), "complete"))


@query("stream_throughput_sliding", """
with b as (select *, time_bucket(interval 12 hour, ts) as b12 from run_outputs),
a as (select b12 as ws, * from b union all select b12 - interval 12 hour, * from b)
select strftime(ws, '%Y-%m-%d %H:%M:%S') as window_start, strftime(ws + interval 1 day, '%Y-%m-%d %H:%M:%S') as window_end,
 count(*) as requests, count(*) filter (where status_code >= 400) as failures, round(sum(response_time_ms), 2) as total_response_ms
from a group by ws
""", ["run_outputs"])
def stream_throughput_sliding(fx: Fixtures):
    return _fmt(_run(fx, lambda s: ST.stream_throughput(s, "1 day", "12 hours"), "complete"))


@query("stream_throughput_append", """
select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start,
 strftime(date_trunc('day', ts) + interval 1 day, '%Y-%m-%d %H:%M:%S') as window_end,
 count(*) as requests, count(*) filter (where status_code >= 400) as failures, round(sum(response_time_ms), 2) as total_response_ms
from run_outputs group by 1, 2, date_trunc('day', ts)
having date_trunc('day', ts) + interval 1 day <= (select max(ts) - interval 1 hour from run_outputs)
""", ["run_outputs"])
def stream_throughput_append(fx: Fixtures):
    """Closed windows only; the rows of a slice that comes again too late are
    dropped by the watermark."""
    return _fmt(_run(fx, lambda s: ST.stream_throughput(s, "1 day"), "append", late=True))


ALERT_LIMIT = 0.4


@query("stream_alerts", f"""
select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, count(*) as requests,
 count(*) filter (where status_code >= 400) as failures,
 round(count(*) filter (where status_code >= 400) / count(*), 6) as failure_rate
from run_outputs group by 1 having count(*) filter (where status_code >= 400) / count(*) > {ALERT_LIMIT}
""", ["run_outputs"])
def stream_alerts(fx: Fixtures):
    out = _run(fx, lambda s: ST.stream_throughput(s, "1 hour"), "complete",
               transform=lambda b: ST.alerts(b, ALERT_LIMIT))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      "requests", "failures", F.round("failure_rate", 6).alias("failure_rate"))


@query("stream_resume_dedup", """
select run_id, count(*) as rows from (select distinct run_id, row_id from run_outputs) group by run_id
""", ["run_outputs"])
def stream_resume_dedup(fx: Fixtures):
    rows = _run(fx, lambda s: ST.dedup_reruns(s, ["run_id", "row_id"], "3 days"), "append", copies=2)
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"))


@query("stream_progress_folded", """
select run_id, count(*) as processed, count(*) filter (where status_code >= 400) as failed from run_outputs group by run_id
""", ["run_outputs"])
def stream_progress_folded(fx: Fixtures):
    """The counts of ``stream_progress`` kept by run, folded every third epoch."""
    spark, folder = fx.spark, write_stream_folder(fx)
    src = ST.file_stream(spark, folder, _stream_rows(fx).schema, max_files=FILES_PER_SLICE)
    table = EpochTable(spark, scratch_path(spark, "progress-table"), ["run_id"], fold_every=3)
    return run_to_keyed_table(ST.stream_progress(src), table, scratch_path(spark, "stream-ckpt"), "update").read()


@query("stream_first_outputs", """
with one as (select run_id, row_id, min(ts) as ts, arg_min(status_code, ts) as status_code from run_outputs group by all)
select run_id, count(*) as rows, count(*) filter (where status_code >= 400) as failed from one group by 1
""", ["run_outputs"])
def stream_first_outputs(fx: Fixtures):
    """Every row is sent twice, weeks apart in event time; no watermark, the table knows the keys for good."""
    spark, folder = fx.spark, write_stream_folder(fx, copies=2)
    src = ST.file_stream(spark, folder, _stream_rows(fx).schema, max_files=FILES_PER_SLICE)
    table = EpochTable(spark, scratch_path(spark, "first-outputs"), ["run_id", "row_id"], keep="first", order="ts", fold_every=5)
    rows = run_to_keyed_table(src, table, scratch_path(spark, "stream-ckpt")).read()
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status_code") >= 400).alias("failed"))


@query("stream_anomalies", """
with per as (select run_id, date_trunc('day', ts) as period, count(*) as n, count(*) filter (where status_code >= 400) as failures
 from run_outputs group by all),
r as (select *, failures / n as failure_rate from per),
w as (select *, avg(failure_rate) over (partition by run_id order by period rows between 7 preceding and 1 preceding) as mu,
 stddev_samp(failure_rate) over (partition by run_id order by period rows between 7 preceding and 1 preceding) as sd from r)
select run_id, strftime(period, '%Y-%m-%d') as period, n, failures, round(failure_rate, 6) as failure_rate,
 coalesce(abs(round(case when sd > 1e-9 then (failure_rate - mu) / sd end, 9)) > 2.0, false) as anomalous
from w where period + interval 1 day <= (select max(ts) - interval 1 hour from run_outputs)
""", ["run_outputs"])
def stream_anomalies(fx: Fixtures):
    """W4's flags on the days that the stream has closed."""
    rows = _run(fx, SA.stream_anomalies, "append")
    return rows.select("run_id", F.date_format("period", "yyyy-MM-dd").alias("period"), "n", "failures", F.round("failure_rate", 6).alias("failure_rate"), "anomalous")


def write_upload_stream(fx: Fixtures) -> str:
    """One CSV upload (a folder of parts) per order priority, and a text file;
    the '4-NOT SPECIFIED' upload lacks the amount column."""
    folder = scratch_path(fx.spark, "upload-stream")
    o = fx.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"),
                         F.col("o_totalprice").alias("amt"), F.to_date("o_orderdate").alias("d"))
    for i, p in enumerate(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]):
        part = o.filter(F.col("name") == p).repartition(2)
        if p.startswith("4"):
            part = part.drop("amt")
        I.stage_csv(part, f"{folder}/{i + 1:02d}_{p[2:].replace(' ', '_').lower()}.csv")
    o.select("name").distinct().write.text(f"{folder}/06_names.txt")
    return folder


@query("stream_ingest", """
select lpad(substr(p, 1, 1), 2, '0') || '_' || replace(lower(substr(p, 3)), ' ', '_') || '.csv' as source, p not like '4%' as accepted,
 case when p not like '4%' then n end as row_count, case when p like '4%' then 3 else 4 end as n_columns,
 case when p like '4%' then 'absent: amt' else '' end as errors, '' as warnings
from (select o_orderpriority as p, count(*) as n from orders group by 1)
union all select '06_names.txt', false, null, null, 'not a .csv source', ''
""")
def stream_ingest(fx: Fixtures):
    spark = fx.spark
    folder = write_upload_stream(fx)
    store = I.DatasetStore(spark, scratch_path(spark, "stream-store"))
    out = ST.ingest_stream(spark, folder, store, "orders_stream", scratch_path(spark, "ingest-ckpt"),
                           scratch_path(spark, "ingest-reports"), max_files=5)
    rows = spark.read.parquet(out)
    return rows.select("source", "accepted", "row_count", "n_columns", *[F.array_join(c, "; ").alias(c) for c in ("errors", "warnings")])
