"""Queries over tables kept for reading: snapshots and compaction of run tables (S8, S12), point lookups
by a file index (P2-P5, S6), keyword search by trigrams (P6, P8, P15), and mergeable sketches (A7, A8, C6)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from vellum.functions import metrics as M
from vellum.functions.tables import calibration
from vellum.operators import registry as R
from vellum.operators import runs as RU
from vellum.operators import schema as C
from vellum.operators import sketches as K
from vellum.operators import trigram as TG
from vellum.operators.scoring import ScoreLog
from vellum.plans.fixtures import Fixtures, with_fixtures
from vellum.plans.pipeline_queries import _SCORE_SQL, demo_scorer
from vellum.session import scratch_path
from vellum.sources import ingest as I
from vellum.sources.datasource import register
from vellum.sources.snapshots import SnapshotTable
from vellum.streaming import runs as ST

Q: dict = {}
O: dict[str, str] = {}


def query(name, sql=None, fixtures=()):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            O[name] = with_fixtures(sql, *fixtures)
        return fn
    return deco


# --------------------------------------------------------------- snapshots

APPENDS = 4


def run_table(fx: Fixtures) -> SnapshotTable:
    """``run_outputs`` stored in several appends of several files each."""
    table = SnapshotTable(fx.spark, scratch_path(fx.spark, "run-table"), ["run_id", "row_id"])
    rows = fx.run_outputs
    for k in range(APPENDS):
        table.append(rows.filter(F.dayofmonth("ts") % APPENDS == k).repartition(3))
    return table


@query("run_table_compacted", """
select run_id, count(*) as rows, min(row_id) as first_row, max(row_id) as last_row, count(distinct row_id) as row_ids,
 count(*) filter (where status_code >= 400) as failed, round(sum(response_time_ms), 2) as total_response_ms from run_outputs group by 1
""", ["run_outputs"])
def run_table_compacted(fx: Fixtures):
    table = run_table(fx)
    table.compact(target_bytes=1 << 20)
    return table.read().groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"), F.count_distinct("row_id").alias("row_ids"),
        F.count_if(F.col("status_code") >= 400).alias("failed"), F.round(F.sum("response_time_ms"), 2).alias("total_response_ms"))


@query("run_table_lookup", """
select row_id, run_id, status_code, round(response_time_ms, 6) as response_time_ms from run_outputs
where row_id in (select distinct o_orderkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'P')
""", ["run_outputs"])
def run_table_lookup(fx: Fixtures):
    """Rows whose number is the key of some order: urgent ones still in progress."""
    keys = fx.orders.filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select("o_orderkey")
    return run_table(fx).lookup(keys, "row_id").select("row_id", "run_id", "status_code", F.round("response_time_ms", 6).alias("response_time_ms"))


# --------------------------------------------------------------- trigrams

KEYWORD = "customer#00000001"


@query("keyword_search_indexed", f"""
select id, name, status from reg_suites where not is_deleted and (name ilike '%{KEYWORD}%' or description ilike '%{KEYWORD}%')
""", ["reg_suites"])
def keyword_search_indexed(fx: Fixtures):
    rows = R.live(fx.reg_suites)
    index = TG.build(rows, "id", ["name", "description"], scratch_path(fx.spark, "trigrams"), file_postings=100_000)
    return TG.search(rows, index, KEYWORD).select("id", "name", "status")


OPENING = 24


@query("benchmark_openings_in_documents", f"""
with k as (select distinct lower(substr(text, 1, {OPENING})) as keyword from benchmark)
select keyword, doc_id as id from k join documents d on contains(lower(d.text), k.keyword)
where length(keyword) >= 3 and not regexp_matches(keyword, '[%_\\\\]')
""")
def benchmark_openings_in_documents(fx: Fixtures):
    """Which documents hold the first words of a benchmark item."""
    keywords = fx.benchmark.select(F.lower(F.substring("text", 1, OPENING)).alias("keyword"))
    index = TG.build(fx.documents, "doc_id", ["text"], scratch_path(fx.spark, "trigrams"))
    return TG.search_many(fx.documents, index, keywords, id_col="doc_id")


# --------------------------------------------------------------- sketches

RANGE = ("2024-01-05", "2024-01-20")
# A KLL sketch of k = 400 may be off by this share of the ranks once in a hundred times; merged ones alike.
RANK_BOUND = 0.02


@query("run_summary_range", f"""
select run_id, count(*) as rows, count(*) filter (where status_code >= 400) as failed, round(avg(response_time_ms), 6) as mean, round(stddev_samp(response_time_ms), 4) as stddev,
 min(response_time_ms) as least, max(response_time_ms) as greatest, true as p50_in_bound, true as p95_in_bound, true as p99_in_bound
from run_outputs where ts >= timestamp '{RANGE[0]}' and ts < timestamp '{RANGE[1]}' group by 1
""", ["run_outputs"])
def run_summary_range(fx: Fixtures):
    figures = scratch_path(fx.spark, "day-figures")
    K.day_figures(fx.run_outputs).write.parquet(figures)
    s = K.range_summary(fx.spark.read.parquet(figures), *RANGE)
    rows = fx.run_outputs.filter((F.col("ts") >= RANGE[0]) & (F.col("ts") < RANGE[1]))
    out = s.select("run_id", "rows", "failed", F.round("mean", 6).alias("mean"), F.round("stddev", 4).alias("stddev"), "least", "greatest")
    for q, c in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
        errors = K.rank_errors(rows, s, q, c).select(F.col("run_id").alias("_run"), (F.col("rank_error") <= RANK_BOUND).alias(f"{c}_in_bound"))
        out = out.join(errors, F.col("run_id").eqNullSafe(F.col("_run")), "left").drop("_run")
    return out


_PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]


def _upload_profiles(fx: Fixtures):
    path = scratch_path(fx.spark, "profiles")
    K.upload_profiles(fx.orders.select(F.col("o_orderpriority").alias("upload"), *_PROFILED)).write.parquet(path)
    return fx.spark.read.parquet(path)


@query("profile_of_uploads", "select * from (" + " union all ".join(
    f"select '{c}' as column_name, count(*) as rows, count({c}) as non_null, true as distinct_in_bound from orders" for c in _PROFILED) + ")")
def profile_of_uploads(fx: Fixtures):
    """All uploads' profile from a row per upload and column; its distinct counts lie within 3 % of the rows'."""
    merged = K.merged_profile(_upload_profiles(fx), _NUMBERS)
    exact = fx.orders.agg(*[F.count_distinct(c).alias(c) for c in _PROFILED]).unpivot([], _PROFILED, "of", "exact")
    return merged.join(exact, F.col("column_name") == F.col("of")).select(
        "column_name", "rows", "non_null", (F.abs(F.col("distinct_values") - F.col("exact")) <= 0.03 * F.col("exact")).alias("distinct_in_bound"))


@query("upload_value_overlap", """
with a as (select * from orders where o_orderpriority = '1-URGENT'), b as (select * from orders where o_orderpriority = '2-HIGH')
select 'o_orderstatus' as column_name, (select count(distinct o_orderstatus) from a) as values_a, (select count(distinct o_orderstatus) from b) as values_b,
 (select count(distinct o_orderstatus) from a where o_orderstatus in (select o_orderstatus from b)) as values_common
union all select 'o_orderdate', (select count(distinct o_orderdate) from a), (select count(distinct o_orderdate) from b),
 (select count(distinct o_orderdate) from a where o_orderdate in (select o_orderdate from b))
""")
def upload_value_overlap(fx: Fixtures):
    overlap = K.value_overlap(_upload_profiles(fx), "1-URGENT", "2-HIGH")
    # columns of fewer distinct values than a sketch keeps hashes: exact
    return overlap.filter(F.col("column_name").isin("o_orderstatus", "o_orderdate")).select("column_name", "values_a", "values_b", "values_common")


# --------------------------------------------------------------- table functions, scoring that resumes, the store as a source

@query("calibration_by_run", """
with k as (select row_id % 4 as run_id, y_true, least(greatest(score / 20000.0, 0), 1) as s from pred_binary where y_true is not null and score is not null),
b as (select *, least(cast(floor(s * 10) as bigint), 9) as bin from k)
select run_id, bin, count(*) as rows, round(avg(s), 6) as mean_score, round(avg(y_true), 6) as positive_share from b group by all
""", ["pred_binary"])
def calibration_by_run(fx: Fixtures):
    rows = fx.pred_binary.select((F.col("row_id") % 4).alias("run_id"), "y_true", F.least(F.greatest(F.col("score") / 20000.0, F.lit(0.0)), F.lit(1.0)).alias("score"))
    out = calibration(fx.spark, ["run_id"]).over(rows)
    return out.select("run_id", "bin", "rows", F.round("mean_score", 6).alias("mean_score"), F.round("positive_share", 6).alias("positive_share"))


@query("score_resumed", _SCORE_SQL)
def score_resumed(fx: Fixtures):
    """A run of which a part was scored before: the second call scores the rest."""
    docs = fx.documents.select(F.lit("r1").alias("run_id"), F.col("doc_id").alias("row_id"), "text")
    log = ScoreLog(fx.spark, scratch_path(fx.spark, "scores"), buckets=8)
    log.score(docs.filter("row_id % 3 = 0"), demo_scorer, batch_size=50, max_attempts=3)
    return log.score(docs, demo_scorer, batch_size=50, max_attempts=3).select(F.col("row_id").alias("doc_id"), "response", "error", "attempts", "status")


def _stored_orders(fx: Fixtures) -> I.DatasetStore:
    store = I.DatasetStore(fx.spark, scratch_path(fx.spark, "source-store"))
    for k, status in enumerate("FOP"):
        part = fx.orders.filter(F.col("o_orderstatus") == status).select("o_orderkey", "o_totalprice", "o_orderstatus")
        store.upload_csv("orders", I.stage_csv(part, scratch_path(fx.spark, "orders") + f"/{status}.csv"), now=dt.datetime(2024, 2, 1, 9, 0, k))
    return store


@query("store_as_source", """
select 'read' as how, o_orderstatus, count(*) as rows, min(o_orderkey) as first_key, max(o_orderkey) as last_key from orders where o_orderstatus <> 'O' group by 2
union all select 'stream', o_orderstatus, count(*), min(o_orderkey), max(o_orderkey) from orders group by 2
""")
def store_as_source(fx: Fixtures):
    """Uploads read through the data source (all but the second, a filter that the source takes over) and as a stream."""
    spark, store = fx.spark, _stored_orders(fx)
    register(spark)
    options = {"root": store.root, "dataset": "orders"}
    read = spark.read.format("vellum").options(**options).load().filter(F.col("upload").isin("20240201_090000", "20240201_090002"))
    out = ST.run_to_table(spark.readStream.format("vellum").options(**options).load(), scratch_path(spark, "source-out"), scratch_path(spark, "source-ckpt"))
    streamed = ST.read_result(spark, out, "append")
    both = read.withColumn("how", F.lit("read")).unionByName(streamed.withColumn("how", F.lit("stream")))
    return both.groupBy("how", "o_orderstatus").agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("schema_round_trip", """
select 'd' as dataset_id, 'v1' as upload, * from (values (0, 'o_orderkey', 'BIGINT', true), (1, 'o_totalprice', 'DOUBLE', true), (2, 'o_orderstatus', 'VARCHAR', true),
 (3, 'o_orderdate', 'TIMESTAMP', true)) t(ordinal, column_name, type, nullable) where (select count(*) from orders) > 0
""")
def schema_round_trip(fx: Fixtures):
    """The schema of a table exported as a JSON document and loaded again."""
    described = C.schema_table(fx.spark, fx.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate").schema) \
        .withColumns({"dataset_id": F.lit("d"), "upload": F.lit("v1")})
    documents = C.schema_documents(described)
    path = scratch_path(fx.spark, "schema-documents")
    documents.select("document").write.text(path)
    return C.load_schema_documents(fx.spark.read.text(path).withColumnRenamed("value", "document"))


@query("compare_many_runs", """
with m as (select l_linenumber as run_id, round(avg(abs(y_true - y_pred)), 4) as mae, round(avg(y_true), 4) as mean_true from pred_reg group by 1),
long as (select * from (unpivot m on mae, mean_true into name metric_name value metric_value))
select metric_name, max(metric_value) filter (where run_id = 1) as run_1, max(metric_value) filter (where run_id = 2) as run_2, max(metric_value) filter (where run_id = 3) as run_3,
 round(max(metric_value) filter (where run_id = 2) - max(metric_value) filter (where run_id = 1), 4) as delta_2,
 round(max(metric_value) filter (where run_id = 3) - max(metric_value) filter (where run_id = 1), 4) as delta_3,
 cast(arg_max(run_id, metric_value) filter (where run_id <= 3) as varchar) as best from long group by 1
""", ["pred_reg"])
def compare_many_runs(fx: Fixtures):
    rows = fx.pred_reg.withColumnRenamed("l_linenumber", "run_id")
    wide = rows.groupBy("run_id").agg(F.round(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))), 4).alias("mae"), F.round(F.avg("y_true"), 4).alias("mean_true"))
    out = RU.compare_many(M.metrics_long(wide, ["run_id"], ["mae", "mean_true"]), [2, 3], 1)
    return out.select("metric_name", "run_1", "run_2", "run_3", *[F.round(c, 4).alias(c) for c in ("delta_2", "delta_3")], "best")
