"""Registry queries (P, L, J, A2-A5) wired to the fixture views, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import scalar as S
from vellum.operators import registry as R
from vellum.plans.fixtures import Fixtures, with_fixtures
from vellum.plans.sqltext import iso_sql, strip_sql

Q: dict = {}
O: dict[str, str] = {}


def query(name, sql=None, fixtures=()):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            O[name] = with_fixtures(sql, *fixtures)
        return fn
    return deco


_EVAL_STATS_SQL = """
select {keys} count(*) as total_evaluations,
 count(*) filter (where status='pending') as n_pending, count(*) filter (where status='running') as n_running,
 count(*) filter (where status='completed') as n_completed, count(*) filter (where status='failed') as n_failed,
 cast(coalesce(sum(total_requests),0) as bigint) as total_requests,
 cast(coalesce(sum(successful_requests),0) as bigint) as successful_requests,
 cast(coalesce(sum(failed_requests),0) as bigint) as failed_requests,
 round(case when coalesce(sum(total_requests),0) > 0 then cast(100.0 as double)*sum(successful_requests)/sum(total_requests) else 0.0 end, 2) as success_rate,
 round(coalesce(avg(total_requests), 0.0), 2) as average_requests_per_eval,
 round(avg(case when status='completed' and started_at is not null and completed_at is not null
   then date_diff('microsecond', started_at, completed_at)/1e6 end), 2) as average_completion_time_seconds
from reg_evals where not is_deleted {group}
"""


@query("eval_stats", _EVAL_STATS_SQL.format(keys="", group=""), ["reg_evals"])
def eval_stats(fx: Fixtures):
    return R.eval_stats(fx.reg_evals)


@query("eval_stats_by_suite", _EVAL_STATS_SQL.format(keys="suite_id,", group="group by suite_id"), ["reg_evals"])
def eval_stats_by_suite(fx: Fixtures):
    return R.eval_stats_by_suite(fx.reg_evals)


@query("dataset_stats", """
select count(*) as total_datasets, cast(coalesce(sum(total_rows),0) as bigint) as total_rows,
 case when count(*) > 0 then coalesce(sum(total_rows),0) / count(*) else 0.0 end as average_rows_per_dataset
from reg_datasets where not is_deleted
""", ["reg_datasets"])
def dataset_stats(fx: Fixtures):
    return R.dataset_stats(fx.reg_datasets)


@query("suite_stats", """
select count(*) as total_suites, count(dataset_id) as suites_with_dataset, count(*) - count(dataset_id) as suites_without_dataset,
 count(*) filter (where status='ready') as total_ready, count(*) filter (where status='running') as total_running,
 count(*) filter (where status='failed') as total_failed, cast(coalesce(sum(total_evals),0) as bigint) as total_evals,
 case when count(*) > 0 then round(coalesce(sum(total_evals),0) / count(*), 2) else 0.0 end as average_evals_per_suite
from reg_suites where not is_deleted
""", ["reg_suites"])
def suite_stats(fx: Fixtures):
    return R.suite_stats(fx.reg_suites)


@query("soft_delete_filter", f"""
select cast(id as varchar) as id, name, description, total_rows, {iso_sql('created_at')} as created_at, is_deleted
from reg_datasets where not is_deleted
""", ["reg_datasets"])
def soft_delete_filter(fx: Fixtures):
    return R.to_record(R.live(fx.reg_datasets), "dataset")


@query("get_by_id", """
select id, name from reg_suites where not is_deleted and id in (select suite_id from reg_evals where status = 'failed')
""", ["reg_suites", "reg_evals"])
def get_by_id(fx: Fixtures):
    keys = fx.reg_evals.filter(F.col("status") == "failed").select(F.col("suite_id").alias("id"))
    return R.get_by_id(fx.reg_suites, keys).select("id", "name")


@query("get_by_name", f"""
select id, name from reg_suites where not is_deleted and name in
 (select {strip_sql("concat(' ', c_name, chr(9))")} from customer where c_acctbal < 0)
""", ["reg_suites"])
def get_by_name(fx: Fixtures):
    args = fx.customer.filter(F.col("c_acctbal") < 0).select(
        F.concat(F.lit(" "), F.col("c_name"), F.lit("\t")).alias("name"))
    return R.get_by_name(fx.reg_suites, args).select("id", "name")


@query("exists_by_id", """
select k.id, coalesce(s.hit, false) as "exists"
from (select distinct suite_id as id from reg_evals) k
left join (select distinct id, true as hit from reg_suites where not is_deleted) s on s.id = k.id
""", ["reg_suites", "reg_evals"])
def exists_by_id(fx: Fixtures):
    keys = fx.reg_evals.select(F.col("suite_id").alias("id"))
    return R.exists_by(fx.reg_suites, keys, "id")


@query("exists_by_name", """
select k.name, coalesce(s.hit, false) as "exists"
from (select n_name as name from nation union select lower(n_name) from nation) k
left join (select distinct name, true as hit from reg_datasets where not is_deleted) s on s.name = k.name
""", ["reg_datasets"])
def exists_by_name(fx: Fixtures):
    keys = fx.nation.select(F.col("n_name").alias("name")).union(
        fx.nation.select(F.lower("n_name").alias("name")))
    return R.exists_by(fx.reg_datasets, keys, "name")


@query("keyword_search", """
select id, name, description from reg_suites where not is_deleted
 and (coalesce(name ilike '%mer#0000_1%', false) or coalesce(description ilike '%mer#0000_1%', false))
""", ["reg_suites"])
def keyword_search(fx: Fixtures):
    return R.keyword_search(fx.reg_suites, "mer#0000_1").select("id", "name", "description")


@query("status_filter", """
select id, name, description, status from reg_evals where not is_deleted
 and (coalesce(name ilike '%urgent%', false) or coalesce(description ilike '%urgent%', false)) and status = 'completed'
""", ["reg_evals"])
def status_filter(fx: Fixtures):
    return R.keyword_search(fx.reg_evals, "urgent", status="completed").select("id", "name", "description", "status")


@query("search_conjunctive", """
select id, name, description, suite_id, dataset_id from reg_evals where not is_deleted
 and name ilike '%eval 1%' and description ilike '%high%' and dataset_id = 3
""", ["reg_evals"])
def search_conjunctive(fx: Fixtures):
    return R.search_conjunctive(fx.reg_evals, name=" eval 1 ", description="high", dataset_id=3) \
        .select("id", "name", "description", "suite_id", "dataset_id")


@query("metadata_equals", """
select event_id, props from events where props->>'k' = '69'
""")
def metadata_equals(fx: Fixtures):
    return R.metadata_equals(fx.events, "props", "k", "69").select("event_id", "props")


@query("metadata_contains", """
select event_id, props from events where props->>'k' ilike '%9%'
""")
def metadata_contains(fx: Fixtures):
    return R.metadata_contains(fx.events, "props", "k", "9").select("event_id", "props")


def _varied_metadata(fx: Fixtures):
    # metadata strings with a JSON-null key, empty objects and the raw props
    return fx.events.select(
        "event_id",
        F.when(F.col("event_type") == "view", F.lit('{"n": null}'))
        .when(F.col("event_type") == "error", F.lit("{}"))
        .otherwise(F.col("props")).alias("meta"))


@query("metadata_has_key", """
select event_id, meta from (
 select event_id, case when event_type='view' then '{"n": null}' when event_type='error' then '{}' else props end as meta from events)
where list_contains(json_keys(meta), 'n')
""")
def metadata_has_key(fx: Fixtures):
    return R.metadata_has_key(_varied_metadata(fx), "meta", "n")


@query("by_foreign_key", """
select id, suite_id,
 row_number() over (partition by suite_id order by created_at desc nulls first, id) as position,
 count(*) over (partition by suite_id) as n_children
from reg_evals where not is_deleted and suite_id is not null
""", ["reg_evals"])
def by_foreign_key(fx: Fixtures):
    return R.by_foreign_key(fx.reg_evals, "suite_id").select("id", "suite_id", "position", "n_children")


@query("to_record", f"""
select cast(id as varchar) as id, name, description, cast(suite_id as varchar) as suite_id, cast(dataset_id as varchar) as dataset_id,
 total_requests, successful_requests, failed_requests, coalesce(lower(status), 'pending') as status,
 {iso_sql('created_at')} as created_at, {iso_sql('started_at')} as started_at, {iso_sql('completed_at')} as completed_at, is_deleted
from reg_evals where not is_deleted
""", ["reg_evals"])
def to_record(fx: Fixtures):
    return R.to_record(R.live(fx.reg_evals), "eval")


@query("normalise_filter_args", f"""
select conv_id, turn, nullif({strip_sql('text')}, '') as text from conversations
""")
def normalise_filter_args(fx: Fixtures):
    return R.normalise_args(fx.conversations.select("conv_id", "turn", "text"), "text")


@query("row_search", """
select doc_id, n_chars from documents
where coalesce(text ilike '%license%', false) or coalesce(lang ilike '%license%', false) or coalesce(source ilike '%license%', false)
""")
def row_search(fx: Fixtures):
    return R.row_search(fx.documents, "license").select("doc_id", "n_chars")


@query("paginate", f"""
with live as (select * from reg_suites where not is_deleted),
 tot as (select count(*) as total_count from live)
select p.id, p.name, {iso_sql('p.created_at')} as created_at, tot.total_count, 3 as page, 20 as page_size,
 cast((tot.total_count + 19) // 20 as bigint) as total_pages, 3 < (tot.total_count + 19) // 20 as has_next, true as has_prev
from (select * from live order by created_at desc nulls first, id limit 20 offset 40) p, tot
""", ["reg_suites"])
def paginate(fx: Fixtures):
    out = R.paginate(fx.reg_suites, page=3, page_size=20, clamp=True)
    return out.select("id", "name", S.isoformat("created_at").alias("created_at"), "total_count",
                      "page", "page_size", "total_pages", "has_next", "has_prev")


@query("page_after", f"""
select id, name, {iso_sql('created_at')} as created_at from reg_suites where not is_deleted order by created_at desc nulls first, id limit 20 offset 40
""", ["reg_suites"])
def page_after(fx: Fixtures):
    """L1 by key: the third page, found from the last row of the second."""
    last = R.paginate(fx.reg_suites, page=2, page_size=20).select("created_at", "id").tail(1)[0]
    out = R.page_after(fx.reg_suites, last["created_at"], last["id"], 20)
    return out.select("id", "name", S.isoformat("created_at").alias("created_at"))


@query("recent_n", f"""
select id, name, {iso_sql('created_at')} as created_at from reg_datasets where not is_deleted
order by created_at desc nulls first, id limit 5
""", ["reg_datasets"])
def recent_n(fx: Fixtures):
    return R.recent_n(fx.reg_datasets, 5).select("id", "name", S.isoformat("created_at").alias("created_at"))


@query("sort_by", """
select id, total_evals from reg_suites where not is_deleted order by total_evals desc, id
""", ["reg_suites"])
def sort_by(fx: Fixtures):
    return R.sort_by(fx.reg_suites, "total_evals", descending=True).select("id", "total_evals")


@query("suite_frozen", """
select s.id, s.name, coalesce(e.n, 0) as n_live_evals, coalesce(e.n, 0) > 0 as frozen
from reg_suites s left join (select suite_id, count(*) as n from reg_evals where not is_deleted group by suite_id) e on e.suite_id = s.id
where not s.is_deleted
""", ["reg_suites", "reg_evals"])
def suite_frozen(fx: Fixtures):
    return R.suite_frozen(fx.reg_suites, fx.reg_evals)


@query("suite_with_dataset", """
select s.dataset_id, s.id, s.name, d.name as dataset_name
from reg_suites s left join (select id, name from reg_datasets where not is_deleted) d on d.id = s.dataset_id
where not s.is_deleted
""", ["reg_suites", "reg_datasets"])
def suite_with_dataset(fx: Fixtures):
    return R.suite_with_dataset(fx.reg_suites, fx.reg_datasets)
