"""Metric-library queries (M1-M19, A11, J3, W3) on the prediction fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import metrics as M
from vellum.operators import runs as RU
from vellum.plans.fixtures import Fixtures, with_fixtures

Q: dict = {}
O: dict[str, str] = {}


def query(name, sql=None, fixtures=()):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            O[name] = with_fixtures(sql, *fixtures)
        return fn
    return deco


@query("cosine_similarity", """
select vec_id, round(case when sqrt(list_dot_product(o, o)) * sqrt(list_dot_product(t, t)) > 0
  then list_dot_product(o, t) / (sqrt(list_dot_product(o, o)) * sqrt(list_dot_product(t, t))) else 0.0 end, 6) as cosine_similarity
from (select vec_id, output_vec::double[] as o, truth_vec::double[] as t from pred_vec)
""", ["pred_vec"])
def cosine_similarity(fx: Fixtures):
    return fx.pred_vec.select("vec_id", F.round(M.cosine_similarity("output_vec", "truth_vec"), 6)
                              .alias("cosine_similarity"))


@query("accuracy", """
select round(avg(cast(y_true = y_pred as double)), 6) as accuracy, count(*) as n from pred_class
""", ["pred_class"])
def accuracy(fx: Fixtures):
    return M.accuracy(fx.pred_class).select(F.round("accuracy", 6).alias("accuracy"), "n")


_REPORT_SQL = """
with pc as (select y_true, y_pred, count(*) as n from pred_class group by all),
bt as (select y_true as label, sum(n) as support, sum(case when y_true = y_pred then n else 0 end) as tp from pc group by 1),
bp as (select y_pred as label, sum(n) as predicted from pc group by 1),
per0 as (select coalesce(bt.label, bp.label) as label, coalesce(support, 0) as support, coalesce(tp, 0) as tp,
  coalesce(predicted, 0) as predicted from bt full join bp on bt.label = bp.label),
per1 as (select *, case when predicted <> 0 then tp / predicted else 0.0 end as precision,
  case when support <> 0 then tp / support else 0.0 end as recall from per0),
per as (select *, case when precision + recall <> 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1 from per1),
tot as (select sum(support) as s, sum(tp) as tp, count(*) as k, sum(precision) as sp, sum(recall) as sr, sum(f1) as sf,
  sum(precision * support) as wp, sum(recall * support) as wr, sum(f1 * support) as wf from per),
rep as (
 select label, precision, recall, f1, support from per
 union all select 'macro avg', sp / k, sr / k, sf / k, s from tot
 union all select 'micro avg', tp / s, tp / s, tp / s, s from tot
 union all select 'weighted avg', wp / s, wr / s, wf / s, s from tot)
select label, round({m}, 6) as {m}, cast(support as bigint) as support from rep
"""


def _report(fx: Fixtures, m: str):
    r = M.classification_report(fx.pred_class)
    return r.select("label", F.round(m, 6).alias(m), F.col("support").cast("bigint").alias("support"))


@query("precision", _REPORT_SQL.format(m="precision"), ["pred_class"])
def precision(fx: Fixtures):
    return _report(fx, "precision")


@query("recall", _REPORT_SQL.format(m="recall"), ["pred_class"])
def recall(fx: Fixtures):
    return _report(fx, "recall")


@query("f1_score", _REPORT_SQL.format(m="f1"), ["pred_class"])
def f1_score(fx: Fixtures):
    return _report(fx, "f1")


@query("confusion_matrix", """
with l as (select unnest(['A', 'N', 'R']) as label),
c as (select y_true, y_pred, count(*) as n from pred_class group by all)
select a.label as y_true, b.label as y_pred, coalesce(c.n, 0) as n
from l a cross join l b left join c on c.y_true = a.label and c.y_pred = b.label
""", ["pred_class"])
def confusion_matrix(fx: Fixtures):
    return M.confusion_matrix(fx.pred_class, labels=["A", "N", "R"])


@query("auc_roc", """
with r as (select y_true, rank() over (order by score) as rk, count(*) over (partition by score) as c from pred_binary
  where y_true is not null and score is not null),
a as (select sum(case when y_true = 1 then rk + (c - 1) / 2.0 end) as rs, count(*) filter (where y_true = 1) as p,
  count(*) filter (where y_true <> 1) as n from r)
select round(case when p * n <> 0 then (rs - p * (p + 1) / 2.0) / (p * n) else 0.0 end, 6) as auc, p as positives, n as negatives from a
""", ["pred_binary"])
def auc_roc(fx: Fixtures):
    return M.auc_roc(fx.pred_binary).select(F.round("auc", 6).alias("auc"), "positives", "negatives")


# Rounding per regression metric: scale of the value decides the decimals.
_REG_ROUND = {"mae": 4, "mse": 2, "rmse": 4, "r2": 6, "mape": 4}
_REG_SQL = {
    "mae": "avg(abs(y_true - y_pred))",
    "mse": "avg((y_true - y_pred) * (y_true - y_pred))",
    "rmse": "sqrt(avg((y_true - y_pred) * (y_true - y_pred)))",
    "r2": "case when var_pop(y_true) * count(*) > 0 then 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) end",
    "mape": "100.0 * avg(abs((y_true - y_pred) / nullif(y_true, 0)))",
}


def _reg_query(m: str):
    sql = f"select round({_REG_SQL[m]}, {_REG_ROUND[m]}) as {m}, count(*) as n from pred_reg"

    @query(m, sql, ["pred_reg"])
    def run(fx: Fixtures):
        return M.regression_metrics(fx.pred_reg).select(F.round(m, _REG_ROUND[m]).alias(m), "n")
    run.__name__ = m
    return run


for _m in ("mae", "mse", "rmse", "r2", "mape"):
    _reg_query(_m)


_TOKENS_SQL = r"""
t as (select conv_id, turn, list_filter(regexp_split_to_array(reference, '[ \t\n\r\f]+'), lambda x: x <> '') as r,
  list_filter(regexp_split_to_array(output, '[ \t\n\r\f]+'), lambda x: x <> '') as o from pred_text),
ns as (select unnest({orders}) as n),
g as (
 select conv_id, turn, n, 'r' as side, unnest(list_transform(range(0, len(r) - n + 1), lambda i: array_to_string(r[i + 1:i + n], ' '))) as gram
 from t, ns where len(r) >= n
 union all
 select conv_id, turn, n, 'o', unnest(list_transform(range(0, len(o) - n + 1), lambda i: array_to_string(o[i + 1:i + n], ' ')))
 from t, ns where len(o) >= n),
c as (select conv_id, turn, n, gram, count(*) filter (where side = 'r') as cr, count(*) filter (where side = 'o') as co from g group by all),
ov0 as (select conv_id, turn, n, sum(least(cr, co)) as m, sum(co) as ot, sum(cr) as rt from c group by all),
ov as (select t.conv_id, t.turn, ns.n, len(t.r) as ref_len, len(t.o) as out_len, coalesce(m, 0) as m, coalesce(ot, 0) as ot, coalesce(rt, 0) as rt
 from t cross join ns left join ov0 on ov0.conv_id = t.conv_id and ov0.turn = t.turn and ov0.n = ns.n)
"""


@query("bleu", "with " + _TOKENS_SQL.format(orders="[1, 2, 3, 4]") + """,
s as (select sum(m) filter (where n = 1) as m1, sum(m) filter (where n = 2) as m2, sum(m) filter (where n = 3) as m3, sum(m) filter (where n = 4) as m4,
  sum(ot) filter (where n = 1) as t1, sum(ot) filter (where n = 2) as t2, sum(ot) filter (where n = 3) as t3, sum(ot) filter (where n = 4) as t4,
  sum(out_len) filter (where n = 1) as hyp_len, sum(ref_len) filter (where n = 1) as ref_len from ov),
p as (select case when t1 <> 0 then m1 / t1 else 0.0 end as p1, case when t2 <> 0 then m2 / t2 else 0.0 end as p2,
  case when t3 <> 0 then m3 / t3 else 0.0 end as p3, case when t4 <> 0 then m4 / t4 else 0.0 end as p4,
  cast(hyp_len as bigint) as hyp_len, cast(ref_len as bigint) as ref_len from s),
b as (select *, case when hyp_len = 0 then 0.0 when hyp_len < ref_len then exp(1 - ref_len / hyp_len) else 1.0 end as bp from p)
select round(case when p1 > 0 and p2 > 0 and p3 > 0 and p4 > 0 then bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) else 0.0 end, 6) as bleu,
 round(bp, 6) as brevity_penalty, round(p1, 6) as p1, round(p2, 6) as p2, round(p3, 6) as p3, round(p4, 6) as p4, hyp_len, ref_len from b
""", ["pred_text"])
def bleu(fx: Fixtures):
    b = M.bleu(fx.pred_text)
    return b.select(*[F.round(c, 6).alias(c) for c in ("bleu", "brevity_penalty", "p1", "p2", "p3", "p4")],
                    "hyp_len", "ref_len")


@query("rouge_n", "with " + _TOKENS_SQL.format(orders="[1, 2]") + """,
per as (select n, case when rt <> 0 then m / rt else 0.0 end as r, case when ot <> 0 then m / ot else 0.0 end as p from ov),
per2 as (select *, case when r + p <> 0 then 2 * r * p / (r + p) else 0.0 end as f from per)
select n, round(avg(r), 6) as recall, round(avg(p), 6) as precision, round(avg(f), 6) as f1, count(*) as pairs from per2 group by n
""", ["pred_text"])
def rouge_n(fx: Fixtures):
    r = M.rouge_n(fx.pred_text)
    return r.select("n", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"),
                    F.round("f1", 6).alias("f1"), "pairs")


_NDCG_SQL = """
with d as (select query_id, grade, row_number() over (partition by query_id order by score desc, item_id) as rk from pred_rank),
i as (select query_id, grade, row_number() over (partition by query_id order by grade desc, item_id) as rk from pred_rank),
dcg as (select query_id, sum((pow(2, grade) - 1) / log2(rk + 1)) as dcg from d where rk <= 10 group by 1),
idcg as (select query_id, sum((pow(2, grade) - 1) / log2(rk + 1)) as idcg from i where rk <= 10 group by 1),
q as (select query_id, case when idcg > 0 then dcg / idcg else 0.0 end as ndcg from dcg join idcg using (query_id))
"""


@query("ndcg_per_query", _NDCG_SQL + "select query_id, round(ndcg, 6) as ndcg from q", ["pred_rank"])
def ndcg_per_query(fx: Fixtures):
    return M.ndcg_per_query(fx.pred_rank, k=10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query("ndcg_at_k", _NDCG_SQL + "select round(avg(ndcg), 6) as ndcg_at_10, count(*) as n_queries from q", ["pred_rank"])
def ndcg_at_k(fx: Fixtures):
    return M.mean_of(M.ndcg_per_query(fx.pred_rank, k=10), "ndcg", "ndcg_at_10") \
        .select(F.round("ndcg_at_10", 6).alias("ndcg_at_10"), "n_queries")


_AP_SQL = """
with r as (select query_id, case when grade >= 2 then 1 else 0 end as rel,
  row_number() over (partition by query_id order by score desc, item_id) as rk from pred_rank),
c as (select *, sum(rel) over (partition by query_id order by rk rows between unbounded preceding and current row) as relcum from r),
q as (select query_id, case when sum(rel) > 0 then sum(case when rel = 1 then relcum / rk end) / sum(rel) else 0.0 end as ap,
  coalesce(1.0 / min(rk) filter (where rel = 1), 0.0) as rr from c group by query_id)
"""


@query("average_precision_per_query", _AP_SQL + "select query_id, round(ap, 6) as ap from q", ["pred_rank"])
def average_precision_per_query(fx: Fixtures):
    return M.average_precision_per_query(fx.pred_rank).select("query_id", F.round("ap", 6).alias("ap"))


@query("mean_average_precision", _AP_SQL + "select round(avg(ap), 6) as map, count(*) as n_queries from q", ["pred_rank"])
def mean_average_precision(fx: Fixtures):
    return M.mean_of(M.average_precision_per_query(fx.pred_rank), "ap", "map") \
        .select(F.round("map", 6).alias("map"), "n_queries")


@query("mrr", _AP_SQL + "select round(avg(rr), 6) as mrr, count(*) as n_queries from q", ["pred_rank"])
def mrr(fx: Fixtures):
    return M.mean_of(M.reciprocal_rank_per_query(fx.pred_rank), "rr", "mrr") \
        .select(F.round("mrr", 6).alias("mrr"), "n_queries")


# --------------------------------------------------------------- run-level (l_linenumber = run)

_METRIC_NAMES = ["accuracy", "mae", "mse", "rmse", "r2", "mape"]


def _run_metrics_long(fx: Fixtures):
    """M18 input: every metric of every run (run = line number) as long rows."""
    acc = M.accuracy(fx.pred_class, group="l_linenumber").select(
        F.col("l_linenumber").alias("run_id"), F.round("accuracy", 6).alias("accuracy"))
    reg = M.regression_metrics(fx.pred_reg, group="l_linenumber").select(
        F.col("l_linenumber").alias("run_id"), *[F.round(m, _REG_ROUND[m]).alias(m) for m in _REG_ROUND])
    return M.metrics_long(acc.join(reg, "run_id", "full"), ["run_id"], _METRIC_NAMES)


def _row_metrics_long(fx: Fixtures):
    """Row-level metric values (run_id, metric_name, metric_value)."""
    c = fx.pred_class.select(F.col("l_linenumber").alias("run_id"), F.lit("correct").alias("metric_name"),
                             (F.col("y_true") == F.col("y_pred")).cast("double").alias("metric_value"))
    d = F.col("y_true") - F.col("y_pred")
    r = fx.pred_reg.select(F.col("l_linenumber").alias("run_id"),
                           F.explode(F.array(F.struct(F.lit("abs_error").alias("metric_name"), F.abs(d).alias("metric_value")),
                                             F.struct(F.lit("squared_error").alias("metric_name"), (d * d).alias("metric_value")))).alias("m")) \
        .select("run_id", "m.metric_name", "m.metric_value")
    return c.unionByName(r)


_LONG_SQL = """
with a as (select l_linenumber as run_id, round(avg(cast(y_true = y_pred as double)), 6) as accuracy from pred_class group by 1),
r as (select l_linenumber as run_id, round(avg(abs(y_true - y_pred)), 4) as mae, round(avg((y_true - y_pred) * (y_true - y_pred)), 2) as mse,
  round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 4) as rmse,
  round(case when var_pop(y_true) * count(*) > 0 then 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) end, 6) as r2,
  round(100.0 * avg(abs((y_true - y_pred) / nullif(y_true, 0))), 4) as mape from pred_reg group by 1),
w as (select coalesce(a.run_id, r.run_id) as run_id, accuracy, mae, mse, rmse, r2, mape from a full join r on a.run_id = r.run_id),
long as (unpivot w on accuracy, mae, mse, rmse, r2, mape into name metric_name value metric_value)
"""


@query("metrics_long", _LONG_SQL + "select cast(run_id as int) as run_id, metric_name, cast(metric_value as double) as metric_value from long",
       ["pred_class", "pred_reg"])
def metrics_long(fx: Fixtures):
    return _run_metrics_long(fx)


# Pass thresholds of the threshold report (a parameter table).
THRESHOLDS = {"accuracy": 0.3, "r2": 0.0, "mape": 50.0}


@query("threshold_check", _LONG_SQL + """,
th as (select * from (values ('accuracy', 0.3), ('r2', 0.0), ('mape', 50.0)) v(metric_name, threshold))
select cast(run_id as int) as run_id, metric_name, cast(metric_value as double) as metric_value, cast(threshold as double) as threshold,
 metric_value >= threshold as passed from long join th using (metric_name)
""", ["pred_class", "pred_reg"])
def threshold_check(fx: Fixtures):
    spark = fx.spark
    th = spark.createDataFrame([(k, float(v)) for k, v in THRESHOLDS.items()], "metric_name string, threshold double")
    return M.threshold_check(_run_metrics_long(fx), th) \
        .select("run_id", "metric_name", "metric_value", "threshold", "passed")


@query("metric_summary", """
with rows as (
 select l_linenumber as run_id, 'correct' as metric_name, cast(y_true = y_pred as double) as v from pred_class
 union all select l_linenumber, 'abs_error', abs(y_true - y_pred) from pred_reg
 union all select l_linenumber, 'squared_error', (y_true - y_pred) * (y_true - y_pred) from pred_reg)
select cast(run_id as int) as run_id, metric_name, count(v) as n,
 case when metric_name = 'squared_error' then round(avg(v), 1) else round(avg(v), 6) end as mean,
 case when metric_name = 'squared_error' then round(min(v), 1) else round(min(v), 6) end as min,
 case when metric_name = 'squared_error' then round(max(v), 1) else round(max(v), 6) end as max,
 case when metric_name = 'squared_error' then round(stddev_samp(v), 1) else round(stddev_samp(v), 6) end as stddev
from rows group by run_id, metric_name
""", ["pred_class", "pred_reg"])
def metric_summary(fx: Fixtures):
    return RU.metric_summary(_row_metrics_long(fx), coarse=["squared_error"])


@query("compare_runs", _LONG_SQL + """
select coalesce(a.metric_name, b.metric_name) as metric_name, a.metric_value as run_a, b.metric_value as run_b,
 b.metric_value - a.metric_value as delta,
 case when a.metric_value <> 0 then (b.metric_value - a.metric_value) / abs(a.metric_value) end as relative_delta
from (select * from long where run_id = 1) a full join (select * from long where run_id = 2) b on a.metric_name = b.metric_name
""", ["pred_class", "pred_reg"])
def compare_runs(fx: Fixtures):
    return RU.compare_runs(_run_metrics_long(fx), 1, 2)


# Runs of suites for the trend: run = line number, suite = whether it is odd, started a day per run, latest first.
@query("metric_trend", _LONG_SQL + """,
runs as (select cast(run_id as int) as run_id, cast(run_id % 2 as int) as suite_id, date '2024-02-01' - cast(run_id as int) as started,
  metric_name, metric_value from long)
select suite_id, run_id, strftime(started, '%Y-%m-%d') as started, metric_name, metric_value,
 lag(metric_value) over (partition by suite_id, metric_name order by started, run_id) as previous_value,
 round(avg(metric_value) over (partition by suite_id, metric_name order by started, run_id rows between 2 preceding and current row), 4) as rolling_mean
from runs
""", ["pred_class", "pred_reg"])
def metric_trend(fx: Fixtures):
    run = F.col("run_id").cast("int")
    runs = _run_metrics_long(fx).withColumns({"suite_id": run % 2, "started": F.date_sub(F.lit("2024-02-01").cast("date"), run)})
    out = RU.metric_trend(runs, window=3, suite="suite_id", order="started")
    return out.withColumn("started", F.date_format("started", "yyyy-MM-dd"))


# --------------------------------------------------------------- metrics of every run, by name

# One report per run: precision, recall and F1 are macro averages over the run's labels.
@query("run_metrics_classification", """
with pc as (select l_linenumber as run_id, y_true, y_pred, count(*) as n from pred_class group by all),
sides as (select run_id, y_true as label, n as support, case when y_true = y_pred then n else 0 end as tp, 0 as predicted from pc
  union all select run_id, y_pred, 0, 0, n from pc),
per0 as (select run_id, label, sum(support) as support, sum(tp) as tp, sum(predicted) as predicted from sides group by all),
per1 as (select *, case when predicted <> 0 then tp / predicted else 0.0 end as p, case when support <> 0 then tp / support else 0.0 end as r from per0),
per as (select *, case when p + r <> 0 then 2 * p * r / (p + r) else 0.0 end as f from per1),
w as (select run_id, sum(tp) / sum(support) as accuracy, avg(p) as precision, avg(r) as recall, avg(f) as f1_score from per group by 1),
long as (unpivot w on accuracy, precision, recall, f1_score into name metric_name value metric_value)
select run_id, metric_name, round(metric_value, 6) as metric_value from long
union all select run_id, 'confusion_matrix[' || y_true || ',' || y_pred || ']', cast(n as double) from pc
""", ["pred_class"])
def run_metrics_classification(fx: Fixtures):
    rows = fx.pred_class.withColumnRenamed("l_linenumber", "run_id")
    names = ["accuracy", "precision", "recall", "f1_score", "confusion_matrix", "no such metric"]
    return M.run_metrics(rows, names, "run_id").withColumn("metric_value", F.round("metric_value", 6))


@query("run_metrics_regression", f"""
with w as (select l_linenumber as run_id, {", ".join(f"round({_REG_SQL[m]}, {_REG_ROUND[m]}) as {m}" for m in _REG_SQL)} from pred_reg group by 1)
select * from (unpivot w on mae, mse, rmse, r2, mape into name metric_name value metric_value)
""", ["pred_reg"])
def run_metrics_regression(fx: Fixtures):
    rows = fx.pred_reg.withColumnRenamed("l_linenumber", "run_id")
    long = M.run_metrics(rows, list(_REG_ROUND), "run_id")
    value = F.lit(None).cast("double")
    for m, digits in _REG_ROUND.items():
        value = F.when(F.col("metric_name") == m, F.round("metric_value", digits)).otherwise(value)
    return long.withColumn("metric_value", value)


@query("run_metrics_ranking", _AP_SQL.rstrip() + _NDCG_SQL.strip().replace("with d as", ",\nd as").replace("\nq as", "\nqn as") + """,
w as (select q.query_id % 3 as run_id, round(avg(ndcg), 6) as ndcg, round(avg(ap), 6) as map, round(avg(rr), 6) as mrr
  from q join qn using (query_id) group by 1)
select * from (unpivot w on ndcg, map, mrr into name metric_name value metric_value)
""", ["pred_rank"])
def run_metrics_ranking(fx: Fixtures):
    rows = fx.pred_rank.withColumn("run_id", F.col("query_id") % 3)
    return M.run_metrics(rows, ["ndcg", "map", "mrr"], "run_id").withColumn("metric_value", F.round("metric_value", 6))


@query("run_metrics_text", "with " + _TOKENS_SQL.format(orders="[1, 2, 3, 4]") + """,
s as (select conv_id % 4 as run_id, sum(m) filter (where n = 1) as m1, sum(m) filter (where n = 2) as m2, sum(m) filter (where n = 3) as m3,
  sum(m) filter (where n = 4) as m4, sum(ot) filter (where n = 1) as t1, sum(ot) filter (where n = 2) as t2, sum(ot) filter (where n = 3) as t3,
  sum(ot) filter (where n = 4) as t4, sum(out_len) filter (where n = 1) as c, sum(ref_len) filter (where n = 1) as r from ov group by 1),
b as (select run_id, case when m1 * m2 * m3 * m4 > 0 then case when c < r then exp(1 - r / c) else 1.0 end
  * exp((ln(m1 / t1) + ln(m2 / t2) + ln(m3 / t3) + ln(m4 / t4)) / 4) else 0.0 end as bleu from s),
per as (select conv_id % 4 as run_id, n, case when rt <> 0 then m / rt else 0.0 end as rr, case when ot <> 0 then m / ot else 0.0 end as pp from ov),
f as (select run_id, avg(case when rr + pp <> 0 then 2 * rr * pp / (rr + pp) else 0.0 end) as rouge_1 from per where n = 1 group by 1)
select run_id, 'bleu' as metric_name, round(bleu, 6) as metric_value from b
union all select run_id, 'rouge_1', round(rouge_1, 6) from f
""", ["pred_text"])
def run_metrics_text(fx: Fixtures):
    rows = fx.pred_text.withColumn("run_id", F.col("conv_id") % 4)
    return M.run_metrics(rows, ["bleu", "rouge_1"], "run_id").withColumn("metric_value", F.round("metric_value", 6))


@query("run_metrics_auc", """
with r as (select row_id % 4 as run_id, y_true, rank() over (partition by row_id % 4 order by score) as rk,
  count(*) over (partition by row_id % 4, score) as c from pred_binary where y_true is not null and score is not null),
a as (select run_id, sum(case when y_true = 1 then rk + (c - 1) / 2.0 end) as rs, count(*) filter (where y_true = 1) as p,
  count(*) filter (where y_true <> 1) as n from r group by 1)
select run_id, 'auc_roc' as metric_name, round(case when p * n <> 0 then (rs - p * (p + 1) / 2.0) / (p * n) else 0.0 end, 6) as metric_value from a
""", ["pred_binary"])
def run_metrics_auc(fx: Fixtures):
    rows = fx.pred_binary.withColumn("run_id", F.col("row_id") % 4)
    return M.run_metrics(rows, ["auc_roc"], "run_id").withColumn("metric_value", F.round("metric_value", 6))


# --------------------------------------------------------------- nulls: labels, values, runs and queries

@query("accuracy_null_labels", """
select run_id, 'accuracy' as metric_name, round(avg(case when y_true is not distinct from y_pred then 1.0 else 0.0 end), 6) as metric_value from gap_class group by 1
""", ["gap_class"])
def accuracy_null_labels(fx: Fixtures):
    return M.run_metrics(fx.gap_class, ["accuracy"], "run_id").withColumn("metric_value", F.round("metric_value", 6))


@query("regression_null_values", f"""
select run_id, {", ".join(f"round({_REG_SQL[m]}, {_REG_ROUND[m]}) as {m}" for m in _REG_SQL)}, count(*) as n
from gap_reg where y_true is not null and y_pred is not null group by 1
""", ["gap_reg"])
def regression_null_values(fx: Fixtures):
    r = M.regression_metrics(fx.gap_reg, group="run_id")
    return r.select("run_id", *[F.round(m, d).alias(m) for m, d in _REG_ROUND.items()], "n")


_GAP_KEYS = "row_number() over (partition by run_id, query_id order by"


@query("ranking_null_keys", f"""
with d as (select *, {_GAP_KEYS} score desc, item_id) as rk, {_GAP_KEYS} grade desc, item_id) as ik from gap_rank),
q as (select run_id, query_id, sum((pow(2, grade) - 1) / log2(rk + 1)) filter (where rk <= 10) as dcg, sum((pow(2, grade) - 1) / log2(ik + 1)) filter (where ik <= 10) as idcg,
  coalesce(1.0 / min(rk) filter (where grade >= 2), 0.0) as rr from d group by all),
w as (select run_id, round(avg(case when idcg > 0 then dcg / idcg else 0.0 end), 6) as ndcg, round(avg(rr), 6) as mrr from q group by 1)
select * from (unpivot w on ndcg, mrr into name metric_name value metric_value)
""", ["gap_rank"])
def ranking_null_keys(fx: Fixtures):
    return M.run_metrics(fx.gap_rank, ["ndcg", "mrr"], "run_id").withColumn("metric_value", F.round("metric_value", 6))
