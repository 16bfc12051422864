"""Run analytics queries (A8-A10, W4, W5) on run_outputs / conversations / events."""

from __future__ import annotations

from pyspark.sql import functions as F

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


@query("run_summary", """
select run_id, count(*) as rows, count(*) filter (where status_code >= 400) as failed,
 round(count(*) filter (where status_code >= 400) / count(*), 6) as error_rate,
 round(avg(response_time_ms), 6) as mean_response_ms, round(quantile_cont(response_time_ms, 0.95), 6) as p95_response_ms
from run_outputs group by run_id
""", ["run_outputs"])
def run_summary(fx: Fixtures):
    s = RU.run_summary(fx.run_outputs)
    return s.select("run_id", "rows", "failed", *[F.round(c, 6).alias(c) for c in
                                                  ("error_rate", "mean_response_ms", "p95_response_ms")])


AS_OF = "2024-01-20 00:00:00"


@query("run_progress", f"""
with d as (select * from run_outputs where ts < timestamp '{AS_OF}'),
j as (select i.run_id, i.row_id, d.ts, d.status_code from run_outputs i left join d on d.run_id = i.run_id and d.row_id = i.row_id)
select run_id, count(*) as expected, count(ts) as processed, count(*) filter (where status_code >= 400) as failed,
 count(*) - count(ts) as remaining, round(case when count(*) > 0 then 100.0 * count(ts) / count(*) else 0.0 end, 6) as percent,
 round(case when count(ts) > 0 then date_diff('microsecond', min(ts), timestamp '{AS_OF}') / 1e6 / count(ts) * (count(*) - count(ts)) end, 3) as eta_seconds
from j group by run_id
""", ["run_outputs"])
def run_progress(fx: Fixtures):
    o = fx.run_outputs
    p = RU.run_progress(o, o, AS_OF)
    return p.select("run_id", "expected", "processed", "failed", "remaining",
                    F.round("percent", 6).alias("percent"), F.round("eta_seconds", 3).alias("eta_seconds"))


# Token prices of the cost report (per token).
RATE_IN, RATE_OUT = 0.0005, 0.0015


@query("run_cost", rf"""
with t as (select conv_id, role, len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> '')) as n from conversations),
a as (select conv_id, sum(case when role = 'user' then n else 0 end) as input_tokens, sum(case when role = 'assistant' then n else 0 end) as output_tokens
 from t group by conv_id)
select conv_id, cast(input_tokens as bigint) as input_tokens, cast(output_tokens as bigint) as output_tokens,
 round(cast(input_tokens * {RATE_IN} + output_tokens * {RATE_OUT} as double), 6) as cost from a
""")
def run_cost(fx: Fixtures):
    c = RU.run_cost(fx.conversations, RATE_IN, RATE_OUT)
    return c.select("conv_id", "input_tokens", "output_tokens", F.round("cost", 6).alias("cost"))


@query("run_anomalies", """
with per as (select run_id, date_trunc('day', ts) as period, count(*) as n, count(*) filter (where status_code >= 400) as failures
 from run_outputs group by all),
r as (select *, failures / n as failure_rate from per),
w as (select *, avg(failure_rate) over (partition by run_id order by period rows between 7 preceding and 1 preceding) as mu,
 stddev_samp(failure_rate) over (partition by run_id order by period rows between 7 preceding and 1 preceding) as sd from r)
select run_id, strftime(period, '%Y-%m-%d') as period, n, failures, round(failure_rate, 6) as failure_rate,
 round(case when sd > 1e-9 then (failure_rate - mu) / sd end, 6) + 0.0 as z,
 coalesce(abs(round(case when sd > 1e-9 then (failure_rate - mu) / sd end, 9)) > 2.0, false) as anomalous
from w
""", ["run_outputs"])
def run_anomalies(fx: Fixtures):
    a = RU.run_anomalies(fx.run_outputs)
    return a.select("run_id", F.date_format("period", "yyyy-MM-dd").alias("period"), "n", "failures",
                    F.round("failure_rate", 6).alias("failure_rate"), (F.round("z", 6) + F.lit(0.0)).alias("z"), "anomalous")


@query("dataset_growth", """
with per as (select event_type as dataset_id, date_trunc('day', ts) as period, count(*) as rows_added from events group by all)
select dataset_id, strftime(period, '%Y-%m-%d') as period, rows_added,
 sum(rows_added) over (partition by dataset_id order by period rows between unbounded preceding and current row) as cumulative_rows
from per
""")
def dataset_growth(fx: Fixtures):
    g = RU.dataset_growth(fx.events.withColumnRenamed("event_type", "dataset_id"), "dataset_id", "ts")
    return g.select("dataset_id", F.date_format("period", "yyyy-MM-dd").alias("period"), "rows_added",
                    F.col("cumulative_rows").cast("bigint").alias("cumulative_rows"))
