"""Validation (V1-V8) and scalar-function (F1-F14) queries, with oracles.

Inputs with deliberately broken values are derived from the base tables by
``case`` expressions, so every rule fires on real rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import scalar as S
from vellum.operators import registry as R
from vellum.operators import validate as V
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


# ------------------------------------------------------------------ V1 - V8

def _part_names(fx: Fixtures):
    p = F.col("p_size")
    return fx.part.select(
        F.col("p_partkey").alias("id"),
        F.when(p == 1, F.lit("   ")).when(p == 2, F.lit(None).cast("string"))
        .when(p == 3, F.repeat("p_name", 30)).when(p == 4, F.concat("p_name", F.lit("#")))
        .when(p == 5, F.concat("p_name", F.lit("\u00a0x"))).otherwise(F.col("p_name")).alias("name"))


_NAME_CLASS_SQL = V.NAME_CLASS


@query("check_name", f"""
with n as (select p_partkey as id, case when p_size=1 then '   ' when p_size=2 then null when p_size=3 then repeat(p_name, 30)
  when p_size=4 then concat(p_name, '#') when p_size=5 then concat(p_name, chr(160), 'x') else p_name end as name from part)
select id, rule from (select id, case when name is null or name = '' then 'name_missing' when {strip_sql('name')} = '' then 'name_blank'
  when length(name) > 255 then 'name_too_long' when not regexp_matches(name, '^[{_NAME_CLASS_SQL}]+$') then 'name_invalid_chars' end as rule from n)
where rule is not null
""")
def check_name(fx: Fixtures):
    return V.check_name(_part_names(fx))


@query("check_description", """
select doc_id as id, 'description_too_long' as rule from documents where length(text) > 10000
""")
def check_description(fx: Fixtures):
    return V.check_description(fx.documents, "doc_id", "text")


def _metadata_input(fx: Fixtures):
    t = F.col("event_type")
    return fx.events.select(
        F.col("event_id").alias("id"),
        F.when(t == "error", F.lit("[1, 2]")).when(t == "view", F.concat(F.lit("not json {"), "props"))
        .when((t == "signup") & (F.col("value") > 49), F.concat(F.lit('{"pad": "'), F.repeat(F.lit("x"), 100000), F.lit('"}')))
        .otherwise(F.col("props")).alias("metadata"))


@query("check_metadata", """
with m as (select event_id as id, case when event_type='error' then '[1, 2]' when event_type='view' then concat('not json {', props)
  when event_type='signup' and value > 49 then concat('{"pad": "', repeat('x', 100000), '"}') else props end as metadata from events)
select id, rule from (select id, case when metadata is null then null when not json_valid(metadata) then 'metadata_not_json'
  when json_type(metadata) <> 'OBJECT' then 'metadata_not_object' when length(metadata) > 100000 then 'metadata_too_long' end as rule from m)
where rule is not null
""")
def check_metadata(fx: Fixtures):
    return V.check_metadata(_metadata_input(fx))


def _counts_input(fx: Fixtures):
    e = fx.reg_evals
    return e.select(
        "id",
        F.when(F.col("status") == "failed", F.concat(F.col("total_requests").cast("string"), F.lit(".5")))
        .otherwise(F.col("total_requests").cast("string")).alias("total_requests"),
        (F.col("failed_requests") - F.col("successful_requests")).alias("failed_requests"),
        "successful_requests")


@query("check_counts", """
with c as (select id, case when status='failed' then concat(cast(total_requests as varchar), '.5') else cast(total_requests as varchar) end as total_requests,
  failed_requests - successful_requests as failed_requests, successful_requests from reg_evals),
v as (
 select id, case when not regexp_matches(trim(total_requests), '^[+-]?[0-9]+$') or try_cast(trim(total_requests) as bigint) is null then 'total_requests_not_integer'
  when try_cast(trim(total_requests) as bigint) < 0 then 'total_requests_negative' end as rule from c where total_requests is not null
 union all
 select id, case when failed_requests < 0 then 'failed_requests_negative' end from c where failed_requests is not null
 union all
 select id, case when successful_requests < 0 then 'successful_requests_negative' end from c where successful_requests is not null)
select id, rule from v where rule is not null
""", ["reg_evals"])
def check_counts(fx: Fixtures):
    return V.check_counts(_counts_input(fx), ["total_requests", "failed_requests", "successful_requests"])


def _uuid_input(fx: Fixtures):
    h = F.md5("c_name")
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                         F.substring(h, 17, 4), F.substring(h, 21, 12))
    seg = F.col("c_mktsegment")
    return fx.customer.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") < 0, F.substring(dashed, 1, 35))
        .when(seg == "BUILDING", F.concat(F.lit("{"), F.upper(dashed), F.lit("}")))
        .when(seg == "MACHINERY", F.concat(F.lit("urn:uuid:"), h))
        .when(seg == "FURNITURE", F.concat(dashed, F.lit("g")))
        .otherwise(dashed).alias("uuid"))


@query("check_uuid", """
with u0 as (select c_custkey as id, c_acctbal, c_mktsegment as seg, md5(c_name) as h from customer),
u1 as (select *, concat_ws('-', substr(h,1,8), substr(h,9,4), substr(h,13,4), substr(h,17,4), substr(h,21,12)) as dashed from u0),
u as (select id, case when c_acctbal < 0 then substr(dashed, 1, 35) when seg='BUILDING' then concat('{', upper(dashed), '}')
  when seg='MACHINERY' then concat('urn:uuid:', h) when seg='FURNITURE' then concat(dashed, 'g') else dashed end as uuid from u1)
select id, 'not_uuid' as rule from u
where not regexp_matches(replace(trim(replace(replace(uuid, 'urn:', ''), 'uuid:', ''), '{}'), '-', ''), '^[0-9a-fA-F]{32}$')
""")
def check_uuid(fx: Fixtures):
    return V.check_uuid(_uuid_input(fx), "id", "uuid")


@query("check_unique_name", """
select p_partkey as id, 'name_not_unique' as rule from part
where p_name in (select p_name from part group by p_name having count(*) > 1)
""")
def check_unique_name(fx: Fixtures):
    parts = fx.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return V.check_unique_name(parts)


@query("check_status", """
select id, 'status_invalid' as rule from (
 select id, case when description = 'MACHINERY' then upper(status) else status end as status from reg_suites)
where status is null or status not in ('ready', 'running', 'failed')
""", ["reg_suites"])
def check_status(fx: Fixtures):
    s = fx.reg_suites.select("id", F.when(F.col("description") == "MACHINERY", F.upper("status"))
                             .otherwise(F.col("status")).alias("status"))
    return V.check_status(s, R.SUITE_STATUSES)


@query("check_references", """
select s.id, case when d.id is null then 'suite_dataset_missing' else 'suite_dataset_deleted' end as rule
from reg_suites s left join reg_datasets d on d.id = s.dataset_id
where s.dataset_id is not null and (d.id is null or d.is_deleted)
union all
select e.id, case when s.id is null then 'eval_suite_missing' else 'eval_suite_deleted' end
from reg_evals e left join reg_suites s on s.id = e.suite_id
where e.suite_id is not null and (s.id is null or s.is_deleted)
""", ["reg_datasets", "reg_suites", "reg_evals"])
def check_references(fx: Fixtures):
    return V.check_references(fx.reg_suites, "dataset_id", fx.reg_datasets, "suite_dataset").unionByName(
        V.check_references(fx.reg_evals, "suite_id", fx.reg_suites, "eval_suite"))


# ------------------------------------------------------------------ F1 - F14

@query("fn_ilike", """
select c_custkey, coalesce(c_name ilike '%mer#0000_2%', false) as hit from customer
""")
def fn_ilike(fx: Fixtures):
    return fx.customer.select("c_custkey", F.coalesce(S.ilike("c_name", "%mer#0000_2%"), F.lit(False)).alias("hit"))


@query("fn_strip", f"""
select conv_id, turn, md5({strip_sql('text')}) as h, length({strip_sql('text')}) as n from conversations
""")
def fn_strip(fx: Fixtures):
    st = S.strip("text")
    return fx.conversations.select("conv_id", "turn", F.md5(st).alias("h"), F.length(st).alias("n"))


@query("fn_isoformat", f"""
select event_id, {iso_sql('ts')} as iso from events
""")
def fn_isoformat(fx: Fixtures):
    return fx.events.select("event_id", S.isoformat("ts").alias("iso"))


def _stamps(fx: Fixtures):
    t = F.col("event_type")
    return fx.events.select(
        "event_id",
        F.when(t == "error", F.concat(F.lit("batch-"), F.col("event_id").cast("string")))
        .when(t == "view", F.date_format("ts", "yyyyMMdd"))
        .otherwise(S.format_upload_stamp("ts")).alias("stamp"))


@query("fn_parse_stamp", f"""
with s as (select event_id, case when event_type='error' then concat('batch-', cast(event_id as varchar))
  when event_type='view' then strftime(ts, '%Y%m%d') else strftime(ts, '%Y%m%d_%H%M%S') end as stamp from events)
select event_id, stamp, case when regexp_matches(stamp, '^[0-9]{{8}}_[0-9]{{6}}$') and try_strptime(stamp, '%Y%m%d_%H%M%S') is not null
  then {iso_sql("try_strptime(stamp, '%Y%m%d_%H%M%S')")} else stamp end as parsed from s
""")
def fn_parse_stamp(fx: Fixtures):
    s = _stamps(fx)
    return s.select("event_id", "stamp", S.parse_upload_stamp("stamp").alias("parsed"))


@query("fn_format_stamp", """
select event_id, strftime(ts, '%Y%m%d_%H%M%S') as stamp from events
""")
def fn_format_stamp(fx: Fixtures):
    return fx.events.select("event_id", S.format_upload_stamp("ts").alias("stamp"))


@query("fn_epoch_diff", """
select l_orderkey, l_linenumber, date_diff('microsecond', o_orderdate, l_shipdate) / 1e6 as seconds
from lineitem join orders on o_orderkey = l_orderkey
""")
def fn_epoch_diff(fx: Fixtures):
    o = fx.orders.select("o_orderkey", "o_orderdate")
    return (fx.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate")
            .join(o, F.col("o_orderkey") == F.col("l_orderkey"))
            .select("l_orderkey", "l_linenumber", S.epoch_seconds_between("o_orderdate", "l_shipdate").alias("seconds")))


@query("fn_round2", """
select l_orderkey, l_linenumber, cast(round(cast(cast(l_extendedprice * l_discount as varchar) as decimal(38,20)), 2) as double) as v from lineitem
""")
def fn_round2(fx: Fixtures):
    return fx.lineitem.select("l_orderkey", "l_linenumber",
                              S.round2(F.col("l_extendedprice") * F.col("l_discount")).alias("v"))


@query("fn_ceil_div", """
select o_custkey, count(*) as n, cast((count(*) + 6) // 7 as bigint) as pages from orders group by o_custkey
""")
def fn_ceil_div(fx: Fixtures):
    return (fx.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
            .select("o_custkey", "n", S.ceil_div("n", 7).alias("pages")))


@query("fn_json_get", """
select event_id, props->>'k' as k from events
""")
def fn_json_get(fx: Fixtures):
    return fx.events.select("event_id", S.json_text("props", "k").alias("k"))


@query("fn_basename", """
select page_id, regexp_replace(split_part(regexp_replace(url, '[?#].*$', ''), '/', -1), '\\.[^.]*$', '') as base from pages
""")
def fn_basename(fx: Fixtures):
    return fx.pages.select("page_id", S.basename_no_ext("url").alias("base"))


@query("fn_format_bytes", """
with b as (select page_id, cast(length(html) * (page_id % 5) * 977 as double) as bytes from pages),
i as (select page_id, bytes, least(greatest(cast(floor(ln(bytes) / ln(1024)) as int), 0), 3) as idx from b where bytes > 0)
select page_id, '0 Bytes' as size from b where bytes = 0
union all
select page_id, concat(regexp_replace(format('{:.2f}', round(bytes / pow(1024.0, idx), 2)), '\\.?0+$', ''), ' ',
  (['Bytes', 'KB', 'MB', 'GB'])[idx + 1]) from i
""")
def fn_format_bytes(fx: Fixtures):
    b = (F.length("html") * (F.col("page_id") % 5) * 977).cast("double")
    return fx.pages.select("page_id", S.format_bytes(b).alias("size"))


@query("fn_format_number", """
select l_orderkey, format('{:,}', cast(floor(sum(l_quantity) * 1000) as bigint)) as qty from lineitem group by l_orderkey
""")
def fn_format_number(fx: Fixtures):
    return (fx.lineitem.groupBy("l_orderkey").agg((F.sum("l_quantity") * 1000).alias("q"))
            .select("l_orderkey", S.format_number(F.floor("q")).alias("qty")))


@query("fn_percent", """
select id, case when total_requests > 0 then cast(100.0 as double) * successful_requests / total_requests else 0.0 end as pct from reg_evals
""", ["reg_evals"])
def fn_percent(fx: Fixtures):
    return fx.reg_evals.select("id", S.percent("successful_requests", "total_requests").alias("pct"))


@query("fn_json_path", """
select row_id, cast(json_extract(response, '$.content.choices[0]') as varchar) as value from responses
""", ["responses"])
def fn_json_path(fx: Fixtures):
    from vellum.operators.pipeline import extract_path
    value, _ = extract_path(F.col("response"), ["content", "choices", "0"])
    return fx.responses.select("row_id", value.alias("value"))
